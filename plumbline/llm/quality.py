"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics come from the whole text alone (character classes, words, lines, repetition). The trees are fitted on
at most ``max_rows`` labelled documents: those with the smallest hash of the id, a documented bound. Features are cut
into at most ``bins`` quantile bins; every tree level adds up gradients and curvatures per node, feature and bin and
splits where the gain is largest. The fitted trees are flattened into arrays (feature, threshold, leaf value) of
complete binary trees, and all documents of a batch walk down all trees at once in numpy.

Cases: a null or empty text has all statistics zero and gets the score that the trees give for that. A document whose
id is null is scored and counts as not held out (CRC-32 of empty text is 0). Repeated rows get one score each. A label that is null is not used; several
labels of one id count by their majority (ties: 1). With no usable label every score is 0.5; with one class only,
the score is the smoothed share. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm import common

MAX_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 60, 4, 64, 0.2, 1.0, 20

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOWER, _UPPER, _DIGIT = np.arange(97, 123), np.arange(65, 91), np.arange(48, 58)
_SPACES = np.array([9, 10, 11, 12, 13, 32])


def features(text: bytes) -> np.ndarray:
    """Statistics of one text; shares are of bytes, words or lines."""
    size = len(text)
    if not size:
        return np.zeros(N_FEATURES)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = seen / size
    words = common.WORDS.findall(text)
    count = max(1, len(words))
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    held = share[share > 0]
    parts = [
        np.log1p(size), np.log1p(len(words)), np.log1p(len(lines)),
        share[_LOWER].sum(), share[_UPPER].sum(), share[_DIGIT].sum(), share[_SPACES].sum(), share[128:].sum(),
        share[:9].sum() + share[14:32].sum() + share[127], share[list(_MARKS)].sum(), -(held * np.log2(held)).sum(),
        lengths.mean(), lengths.std(), lengths.max(), (lengths <= 2).mean(), (lengths >= 15).mean(),
        len(set(words)) / count, len(set(zip(words, words[1:]))) / max(1, count - 1), len(set(zip(words, words[1:], words[2:]))) / max(1, count - 2),
        len(set(full)) / max(1, len(full)), len(full) / len(lines), size / len(lines), max(map(len, lines)) / size,
        sum(x.rstrip()[-1:] in b".!?" for x in full) / max(1, len(full)),
        sum(w.isupper() for w in words) / count, sum(w.isalpha() for w in words) / count,
    ]
    return np.concatenate([parts, share[list(_MARKS)]])


N_FEATURES = 26 + len(_MARKS)


@dataclass(frozen=True)
class Trees:
    """Complete binary trees as arrays of one row per tree; ``right`` of node ``i`` is ``2 * i + 2``."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and node[0:1].size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Boost ``trees`` trees on the log-loss."""
    inner = 2**depth - 1
    prior = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    base = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    n, width = len(y), bins + 1
    raw = np.full(n, base)
    all_feature, all_threshold, all_leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, curve = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(depth):
            first, many = 2**level - 1, 2**level
            cell = (node - first) * width
            best = np.full(many, 1e-6)
            pick = np.zeros((many, 2), int)
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                at = cell + binned[:, f]
                g, h, c = (np.bincount(at, w, many * width).reshape(many, width).cumsum(axis=1) for w in (grad, curve, None))
                left_g, left_h, left_n = g[:, :-1], h[:, :-1], c[:, :-1]
                right_g, right_h, right_n = g[:, -1:] - left_g, h[:, -1:] - left_h, c[:, -1:] - left_n
                gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - g[:, -1:] ** 2 / (h[:, -1:] + RIDGE)
                gain[(left_n < LEAST) | (right_n < LEAST)] = 0
                gain = gain[:, : len(cuts[f])]
                cut = gain.argmax(axis=1)
                top = gain[np.arange(many), cut]
                better = top > best
                best[better] = top[better]
                pick[better, 0], pick[better, 1] = f, cut[better] + 1
            for i in np.flatnonzero(pick[:, 1]):
                feature[first + i], threshold[first + i] = pick[i, 0], cuts[pick[i, 0]][pick[i, 1] - 1]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        g, h = (np.bincount(node - inner, w, inner + 1) for w in (grad, curve))
        leaf = -rate * g / (h + RIDGE)
        raw += leaf[node - inner]
        all_feature.append(feature)
        all_threshold.append(threshold)
        all_leaf.append(leaf)
    return Trees(base, np.array(all_feature), np.array(all_threshold), np.array(all_leaf))


def held_out(doc_id: str = "doc_id") -> Column:
    return common.crc32_of(doc_id) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          max_rows: int = MAX_ROWS) -> Trees:
    """Fit on at most ``max_rows`` labelled documents that are not held out."""
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    # Bounded by max_rows, so it may be broadcast.
    known = common.stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))

    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([features(bytes(t) if t is not None else b"") for t in texts])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("t"))
    chosen = chosen.join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    rows = chosen.select("doc_id", "y", stats("t").alias("x")).orderBy("doc_id").collect()
    x = np.array([r.x for r in rows], float).reshape(-1, N_FEATURES)
    return fit(x, np.array([r.y for r in rows], float))


def scored(docs: DataFrame, model: Trees, text: str = "text") -> Column:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(bytes(t) if t is not None else b"") for t in texts], float)
        return pd.Series(model.score(x.reshape(-1, N_FEATURES)))

    return score(F.col(text).cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
             max_rows: int = MAX_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted``: one row per input row."""
    model = train(docs, labels, doc_id, text, label, max_rows)
    rated = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), scored(docs, model, text).alias("score"))
    return rated.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


QUERIES = {"op8_quality": (op8_quality, None)}
