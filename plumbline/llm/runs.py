"""Periodic word runs by seed and extend: ``a b c a b c a b c a b c`` is one run of period three.

A run is a stretch of consecutive words with smallest period ``q`` and at least ``max(least, repeats * q)`` words that no
neighbouring word extends. Words ``q`` apart are equal along it, so it lies on the diagonal of lag ``q`` with at least
``max(least - q, (repeats - 1) * q)`` equal pairs.

* Index: lags are taken in classes ``2^j <= q < 2^(j+1)``; ``k`` is the smallest overlap that a run of the class
  or a later one guarantees. The ``k``-grams of a text are sorted; equal neighbours of one document are its occurrence pairs. As ``k``
  is at least ``q - 1``, a gram inside a run comes back exactly one period later and not before (two periods would make
  a smaller one), so that pairs of *consecutive* occurrences are enough and there are never more pairs than words.
  A gram that occurs once in its document ends there: longer grams over it are not looked at.
* Extend: a pair whose lag is in the class is extended word by word to both sides. A table holds, per document and lag,
  how far the last extension reached; a pair below that point belongs to the same stretch and is passed over.

A document is one row and is worked on in one task; nothing is shuffled. Work is ``words * log(words)`` at most, also
for one word repeated a million times.

Cases: a null or blank text has no words and no runs, and collapses to empty text. Repeated rows and ids are rows of their
own; a null id is returned as null. An empty table gives an empty result. Further columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm import common

LEAST, REPEATS = 6, 4
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def guaranteed(j: int, least: int = LEAST, repeats: int = REPEATS) -> int:
    """Smallest number of equal pairs on the diagonal of a run whose period is ``2^j`` or more."""
    return min(max(least - q, (repeats - 1) * q) for q in range(1 << j, (1 << j) + least + 1))


def seeds(words: np.ndarray, doc: np.ndarray, ends: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray]:
    """Positions and lags of consecutive occurrences, one class of lags after the other. ``words`` are the numbered words
    of several documents, ``doc`` the document of each and ``ends`` the end of that document."""
    total, size, j = len(words), guaranteed(0, least, repeats), 0
    found_at, found_lag = [], []
    place = np.arange(total)
    at = place[place + size <= ends]
    names = np.zeros(total, np.uint64)
    if total >= size:
        own = common.grams(words.astype(np.uint64), size)
        names[: len(own)] = common.mix(own, doc[: len(own)].astype(np.uint64), 1)
    while len(at):
        order = np.argsort(names[at], kind="stable")
        spots = at[order]
        same = (names[spots[1:]] == names[spots[:-1]]) & (doc[spots[1:]] == doc[spots[:-1]])
        first, second = spots[:-1][same], spots[1:][same]
        lag = second - first
        fits = (lag >= 1 << j) & (lag < 2 << j)
        found_at.append(first[fits])
        found_lag.append(lag[fits])
        again = np.zeros(total + 1, bool)
        again[first] = again[second] = True
        j += 1
        longer = guaranteed(j, least, repeats)
        shift, at = longer - size, np.flatnonzero(again)
        at = at[at + longer <= ends[at]]
        at = at[again[at + shift]]
        grown = common.mix(names[at], names[at + shift], j + 1)
        names[at], size = grown, longer
    return np.concatenate([*found_at, np.empty(0, np.int64)]), np.concatenate([*found_lag, np.empty(0, np.int64)])


def _differs(left: np.ndarray, right: np.ndarray) -> int:
    """How many leading values are equal; compared in growing pieces."""
    at, step, total = 0, 64, len(left)
    while at < total:
        unlike = left[at : at + step] != right[at : at + step]
        first = int(unlike.argmax())
        if unlike[first]:
            return at + first
        at += step
        step *= 2
    return total


def found(words: np.ndarray, starts: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int, int]]:
    """``(document, start, length, period)`` of every run, in that order; ``starts`` has one entry more than documents."""
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at, lag = seeds(words, doc, starts[1:][doc], least, repeats)
    order = np.argsort(at, kind="stable")
    at, lag = at[order], lag[order]
    reached: dict[tuple[int, int], int] = {}
    runs = []
    for i, q, d in zip(at.tolist(), lag.tolist(), doc[at].tolist()):
        if reached.get((d, q), -1) > i:
            continue
        low, high = int(starts[d]), int(starts[d + 1])
        right = i + _differs(words[i : high - q], words[i + q : high])
        left = i - _differs(words[low:i][::-1], words[low + q : i + q][::-1])
        reached[d, q] = right
        length = right + q - left
        if length >= max(least, repeats * q):
            runs.append((d, left - low, length, q))
    runs.sort()
    return runs


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: the runs by start and period, and the words without what repeats.

    ``collapsed`` keeps the first period of each run: a word is left out if any run contains it after that run's first
    period. ``repeats`` must be at least three.
    """
    if repeats < 3 or least < 2:
        raise ValueError("a run needs at least three periods and two words")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in common.chunks(batches):
            texts = [(t or b"").split() for t in part.column("text").cast(pa.binary()).to_pylist()]
            starts = np.cumsum([0, *map(len, texts)])
            numbered = pa.array(chain.from_iterable(texts), pa.binary(), size=int(starts[-1])).dictionary_encode().indices
            runs: list[list] = [[] for _ in texts]
            for d, *run in found(numbered.to_numpy().astype(np.int64), starts, least, repeats):
                runs[d].append(run)
            collapsed = [b" ".join(_kept(words, held) if held else words).decode() for words, held in zip(texts, runs)]
            held = pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs], _RUNS)
            ids = part.column("doc_id").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(starts)), held, pa.array(collapsed, pa.string())],
                                             names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(search, SCHEMA)


def _kept(words: list[bytes], runs: list) -> list[bytes]:
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def longest(runs: Column) -> Column:
    """The longest run of an array that is ordered by start and period; the first of several, null of none."""
    ranked = F.transform(runs, lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("small")))
    best = F.array_max(ranked)
    return F.when(best.isNotNull(), F.struct((-best.back).alias("start"), best.length.alias("length"), (-best.small).alias("period")))


def repeated_from(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text`` where every tenth document, by the CRC-32 of its id, runs in circles from one of its words on."""
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    crc = common.crc32_of("doc_id")
    g = F.floor(crc / 10)
    a = F.pmod(g, F.col("n"))
    p = F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.pmod(g, F.lit(8)) + 3))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))
    turned = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get(F.col("words"), source(i).cast("int")))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("words", F.when(F.pmod(crc, F.lit(10)) == 0, words))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", p)
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op11_runs(spark, sf_dir: str) -> DataFrame:
    done = find(repeated_from(common.table(spark, sf_dir, "documents"))).withColumn("best", longest("runs"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    return done.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op11_runs": (op11_runs, None)}
