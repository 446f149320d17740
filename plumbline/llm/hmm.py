"""Language-model scoring with a hidden Markov model over words.

Training tokens are counted over all training documents: each chunk of documents sends its distinct words to shards and
gets their counts back. The model's alphabet is bounded: the ``FREQUENT`` most frequent tokens are symbols of their
own; every other word belongs to a class by frequency band and word ending, and its probability is that of the class
times its share in it. Own symbols occur at least twice. In each state, the words not seen in training get as
much probability as those seen once with the same ending, spread over one type more than those are: an unseen word never
scores above one seen once with its ending.

Baum-Welch: each pass runs scaled forward and backward recursions over all training documents; the expected counts are
summed per task, then across partitions, and at most ``states * (symbols + states + 1)`` sums come to the driver, which
normalises them. The score is the exact log-likelihood from the scaled forward recursion.

Words are compared by 64-bit hashes: among ``V`` words two share a hash with probability about ``V * V / 2 ** 65``.

Cases: a null or empty text is the end token alone. Repeated rows count as often as they occur; a row with a null id is
a training document (the CRC-32 of empty text is 0). Without any training document every token has probability 1. Texts of
any length are scored whole. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm import common

STATES, PASSES, FREQUENT = 8, 3, 2000
ENDINGS, BANDS = 64, 6
END = np.uint64(xxhash.xxh64_intdigest(b"\n"))  # no word holds a line break
_PRIOR = 2.0  # pseudo-counts spread over a state's symbols
_STATE = "chunk long, ids array<long>, held array<boolean>, sizes binary, words binary, endings binary, seen binary, tokens binary, n long"


def held_out(doc_id: str = "doc_id") -> Column:
    return common.crc32_of(doc_id) % 7 == 2


def ending(word: bytes) -> int:
    return zlib.crc32(word.rstrip(b".,;:!?\"')")[-3:]) % ENDINGS


# --- counting --------------------------------------------------------------------------------------------------------


def _chunked(docs: DataFrame) -> DataFrame:
    """Chunks of ``doc_id, text, held``: distinct words (sorted hashes), their endings and training counts, and the
    tokens as numbers of those words. Texts are not needed after this."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in common.chunks(batches):
            held = np.array(part.column("held").to_pylist(), bool)
            known: dict[bytes, int] = {}
            sizes, numbers = [], []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                words = common.WORDS.findall((text or b"").lower())
                numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
                sizes.append(len(words) + 1)
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
            ends = np.fromiter(map(ending, known), np.uint8, len(known))
            hashes, ends = np.append(hashes, END), np.append(ends, np.uint8(0))
            unique, first, place = np.unique(hashes, return_index=True, return_inverse=True)
            tokens = place[np.concatenate([x for n in numbers for x in (n, [len(known)])]).astype(np.int64)]
            sizes = np.array(sizes, np.int64)
            seen = np.bincount(tokens[np.repeat(~held, sizes)], minlength=len(unique))
            row = [[number], [part.column("doc_id").to_pylist()], [held.tolist()], [sizes.tobytes()], [unique.tobytes()],
                   [ends[first].tobytes()], [seen.astype(np.int64).tobytes()], [tokens.astype(np.uint32).tobytes()], [len(unique)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_())] + [pa.binary()] * 5 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], names=[x.split()[0] for x in _STATE.split(", ")])

    return docs.mapInArrow(read, _STATE)


def _asked(state: DataFrame, shards: int) -> DataFrame:
    """One request per chunk and shard: distinct words, endings and training counts in the shard's range."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in common.rows_of(batches):
            keys, seen = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["seen"], np.int64)
            cuts = common.shard_cuts(keys, shards)
            full = np.flatnonzero(np.diff(cuts))
            parts = [(cuts[s], cuts[s + 1]) for s in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([row["chunk"]] * len(full), pa.int64()),
                 pa.array([keys[a:b].tobytes() for a, b in parts], pa.binary()),
                 pa.array([row["endings"][a:b] for a, b in parts], pa.binary()),
                 pa.array([seen[a:b].tobytes() for a, b in parts], pa.binary())],
                names=["shard", "chunk", "words", "endings", "seen"])

    return state.select("chunk", "words", "endings", "seen").mapInArrow(ask, "shard int, chunk long, words binary, endings binary, seen binary")


def band(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted([1, 2, 4, 16, 256], counts, side="right")


_ANSWER = "chunk long, shard int, counts binary, totals array<double>, top_words binary, top_counts binary"


def _answered(asked: DataFrame, frequent: int) -> DataFrame:
    """Per shard the training counts, back to each chunk; and one row (chunk -1) of totals and most frequent words."""

    def answer(group: pa.Table) -> pa.Table:
        keys, cuts = common.from_blobs(group.column("words"), np.uint64)
        ends, _ = common.from_blobs(group.column("endings"), np.uint8)
        seen, _ = common.from_blobs(group.column("seen"), np.int64)
        unique, first, place = np.unique(keys, return_index=True, return_inverse=True)
        total = np.zeros(len(unique), np.int64)
        np.add.at(total, place, seen)
        back = total[place]
        classes = band(total) * ENDINGS + ends[first]
        known = total > 0
        size = BANDS * ENDINGS
        sums = np.concatenate([np.bincount(classes[known], total[known] + 1, size), np.bincount(classes[known], total[known], size), [known.sum()]])
        top = np.lexsort((unique, -total))[:frequent]
        top = top[total[top] > 1]
        chunks, rows = group.column("chunk").to_pylist(), len(cuts) - 1
        return pa.table({
            "chunk": pa.array([*chunks, -1], pa.int64()), "shard": pa.array([group.column("shard")[0].as_py()] * (rows + 1), pa.int32()),
            "counts": pa.array([back[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])] + [None], pa.binary()),
            "totals": pa.array([None] * rows + [sums.tolist()], pa.list_(pa.float64())),
            "top_words": pa.array([None] * rows + [unique[top].tobytes()], pa.binary()),
            "top_counts": pa.array([None] * rows + [total[top].tobytes()], pa.binary()),
        })

    return asked.groupBy("shard").applyInArrow(answer, _ANSWER)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class and task instead of one per class and shard."""
    total = 0.0
    for batch in batches:
        for row in batch.column(0).to_pylist():
            total = total + np.array(row)
    if np.ndim(total):
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["pos", "n"])


class Alphabet:
    """Symbols: frequent tokens first (sorted by hash), then the classes by band and ending."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, plus: np.ndarray, plain: np.ndarray, types: int):
        order = np.argsort(words)
        self.words, self.tokens, self.types = words[order], int(plain.sum()), types
        self.counts = counts[order]
        self.size = len(words) + BANDS * ENDINGS
        # (c + 1) of the words that stay in each class, and their tokens
        self.plus, self.plain = plus, plain

    def unseen_types(self) -> np.ndarray:
        """Per ending, over how many types the unseen words' probability is spread: one more than were seen once."""
        return self.plain[ENDINGS : 2 * ENDINGS] + 1

    def look_up(self, words: np.ndarray, ends: np.ndarray, counts: np.ndarray):
        """Symbol of each word, and the log10 of its share in that symbol."""
        classes = band(counts) * ENDINGS + ends
        symbol = len(self.words) + classes
        share = np.where(counts > 0, (counts + 1) / np.maximum(self.plus[classes], 1), 1 / self.unseen_types()[ends])
        if len(self.words):
            at = np.searchsorted(self.words, words)
            at[at == len(self.words)] = 0
            own = self.words[at] == words
            symbol, share = np.where(own, at, symbol), np.where(own, 1.0, share)
        return symbol, np.log10(share)


_SCORED = "ids array<long>, held array<boolean>, sizes binary, symbols binary, known binary, base binary, share binary"


def _symbols(state: DataFrame, answers: DataFrame, alphabet: Alphabet) -> DataFrame:
    """Chunks as symbols, with the unigram sums per document."""
    divisor = alphabet.tokens + alphabet.types + 1

    def read(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        counts, _ = common.from_blobs(right.sort_by("shard").column("counts"), np.int64)
        words, ends = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["endings"], np.uint8)
        tokens, sizes = np.frombuffer(row["tokens"], np.uint32), np.frombuffer(row["sizes"], np.int64)
        symbol, share = alphabet.look_up(words, ends, counts)
        starts = np.cumsum(sizes) - sizes
        per_doc = [np.add.reduceat(v[tokens], starts).astype(k).tobytes()
                   for v, k in (((counts > 0).astype(np.int64), np.int64), (np.log10((counts + 1) / divisor), float), (share, float))]
        row = [row["ids"], row["held"], row["sizes"], symbol[tokens].astype(np.uint16).tobytes(), *per_doc]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_())] + [pa.binary()] * 5
        return pa.table([pa.array([c], k) for c, k in zip(row, kinds)], names=[x.split()[0] for x in _SCORED.split(", ")])

    return state.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(read, _SCORED)


# --- the hidden Markov model -----------------------------------------------------------------------------------------


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # (K), (K, K), (S, K)

    def forward(self, symbols: np.ndarray, sizes: np.ndarray, keep: bool = False):
        """Natural log-likelihood per sequence. All sequences advance together, the longest first in each step, so
        that the ones still running are always the first rows. ``keep`` returns the scaled states for the backward run."""
        order = np.argsort(-sizes, kind="stable")
        length = sizes[order]
        starts = np.cumsum(sizes) - sizes
        longest = int(length[0]) if len(length) else 0
        running = np.searchsorted(-length, -np.arange(longest), side="left")  # sequences longer than t
        base = starts[order]
        if keep:
            begin = np.concatenate([[0], np.cumsum(running)])
            states, scales = np.empty((begin[-1], len(self.start))), np.empty(begin[-1])
            flat = np.empty(begin[-1], np.int64)
        like, now = np.zeros(len(sizes)), None
        for t in range(longest):
            n = running[t]
            now_symbols = symbols[base[:n] + t]
            now = (self.start if t == 0 else now[:n] @ self.move) * self.emit[now_symbols]
            scale = now.sum(axis=1)
            now /= scale[:, None]
            like[:n] += np.log(scale)
            if keep:
                at = slice(begin[t], begin[t + 1])
                states[at], scales[at], flat[at] = now, scale, now_symbols
        out = np.empty(len(sizes))
        out[order] = like
        return (out, running, begin, states, scales, flat) if keep else out

    def expected(self, symbols: np.ndarray, sizes: np.ndarray):
        """Expected counts of starts, moves and emissions, and the summed log-likelihood."""
        like, running, begin, states, scales, flat = self.forward(symbols, sizes, keep=True)
        k = len(self.start)
        moves, behind = np.zeros((k, k)), None
        for t in range(len(running) - 1, -1, -1):
            n, at = running[t], slice(begin[t], begin[t + 1])
            weight = np.ones((n, k))
            if behind is not None:
                m = len(behind)
                moves += states[at][:m].T @ behind
                weight[:m] = behind @ self.move.T
            behind = self.emit[flat[at]] * weight / scales[at][:, None]
            states[at] *= weight
        emits = np.stack([np.bincount(flat, states[:, j], len(self.emit)) for j in range(k)], axis=1)
        starts = states[: running[0]].sum(axis=0) if len(running) else np.zeros(k)
        return starts, moves * self.move, emits, float(like.sum())


def first_model(prior: np.ndarray, states: int) -> Model:
    """States that differ by fixed pseudo-random factors and tend to stay."""
    noise = np.random.default_rng(11).normal(size=(len(prior), states))
    emit = prior[:, None] * np.exp(0.5 * noise)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def next_model(starts, moves, emits, prior) -> Model:
    states = len(starts)
    emit = emits + _PRIOR * prior[:, None]
    move = moves + 1 / states
    start = starts + 1 / states
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def with_unseen(model: Model, alphabet: Alphabet) -> Model:
    """Gives unseen words, per state and ending, as much probability as the words seen once have."""
    first, types = len(alphabet.words), alphabet.unseen_types()[:, None]
    each = model.emit[first + ENDINGS : first + 2 * ENDINGS] / types
    some = types[:, 0] > 1
    # An ending without a word seen once: as little a type as in any other.
    each[~some] = each[some].min(axis=0) if some.any() else 1 / (alphabet.tokens + 2) / ENDINGS
    emit = model.emit.copy()
    emit[first : first + ENDINGS] = each * types
    return Model(model.start, model.move, emit / emit.sum(axis=0))


def _pass(chunks: DataFrame, model: Model):
    """Expected counts over all training documents."""
    k, s = len(model.start), len(model.emit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k + s * k + 1)
        for row in common.rows_of(batches):
            sizes, held = np.frombuffer(row["sizes"], np.int64), np.array(row["held"], bool)
            symbols = np.frombuffer(row["symbols"], np.uint16)[np.repeat(~held, sizes)]
            if not held.all():
                starts, moves, emits, like = model.expected(symbols, sizes[~held])
                total += np.concatenate([starts, moves.ravel(), emits.ravel(), [like]])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], names=["at", "value"])

    sums = np.zeros(k + k * k + s * k + 1)
    for row in chunks.select("sizes", "held", "symbols").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        sums[row["at"]] = row["value"]
    return sums[:k], sums[k : k + k * k].reshape(k, k), sums[k + k * k : -1].reshape(s, k), sums[-1]


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", states: int = STATES, passes: int = PASSES,
          frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row per input row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(doc_id).alias("held"))
    state = common.stored(_chunked(rows))
    keys = state.agg(F.sum("n")).first()[0] or 0
    answers = common.stored(_answered(_asked(state, common.shards_for(docs.sparkSession, keys)), frequent))
    about = answers.where("chunk = -1")
    size = BANDS * ENDINGS
    sums = np.zeros(2 * size + 1)
    for row in about.select("totals").coalesce(16).mapInArrow(_summed, "pos int, n double").groupBy("pos").agg(F.sum("n").alias("n")).collect():
        sums[row["pos"]] = row["n"]
    words, counts, ends = _top(about, state, frequent)
    plus, plain, types = sums[:size].copy(), sums[size : 2 * size], int(sums[-1])
    classes = band(counts) * ENDINGS + ends
    np.subtract.at(plus, classes, counts + 1)
    left = plain.copy()
    np.subtract.at(left, classes, counts)
    alphabet = Alphabet(words, counts, plus, plain, types)
    prior = np.concatenate([alphabet.counts, left]).astype(float) + 1e-9
    prior /= prior.sum()
    coded = common.stored(_symbols(state, answers.where("chunk >= 0").select("chunk", "shard", "counts"), alphabet))
    model = first_model(prior, states)
    for _ in range(passes):
        starts, moves, emits, _ = _pass(coded, model)
        model = next_model(starts, moves, emits, prior)
    model = with_unseen(model, alphabet) if alphabet.tokens else _certain(alphabet, states)
    total = alphabet.tokens
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in common.rows_of(batches):
            sizes = np.frombuffer(row["sizes"], np.int64)
            like = model.forward(np.frombuffer(row["symbols"], np.uint16), sizes) / np.log(10)
            columns = [row["ids"], row["held"], sizes, np.frombuffer(row["known"], np.int64), np.full(len(sizes), total),
                       np.frombuffer(row["base"]), like + np.frombuffer(row["share"])]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return coded.mapInArrow(read, schema)


def _certain(alphabet: Alphabet, states: int) -> Model:
    return Model(np.full(states, 1 / states), np.full((states, states), 1 / states), np.ones((alphabet.size, states)))


def _top(about: DataFrame, state: DataFrame, frequent: int):
    """The most frequent tokens over all shards, their counts and endings."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The most frequent tokens of all shards that a task reads, so that rows follow the tasks, not the shards."""
        words, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            words = np.concatenate([words, common.from_blobs(batch.column("top_words"), np.int64)[0]])
            counts = np.concatenate([counts, common.from_blobs(batch.column("top_counts"), np.int64)[0]])
            first = np.lexsort((words, -counts))[:frequent]
            words, counts = words[first], counts[first]
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(counts)], names=["word", "n"])

    best = about.select("top_words", "top_counts").coalesce(16).mapInArrow(rows, "word long, n long").orderBy(F.desc("n"), "word").limit(frequent).collect()
    words = np.array([r.word for r in best], np.int64).view(np.uint64)
    counts = np.array([r.n for r in best], np.int64)
    order = np.argsort(words)
    words, counts = words[order], counts[order]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in common.rows_of(batches):
            keys = np.frombuffer(row["words"], np.uint64)
            at = np.searchsorted(keys, words)
            at[at == len(keys)] = 0
            own = keys[at] == words
            found = np.frombuffer(row["endings"], np.uint8)[at[own]]
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(own), pa.int32()), pa.array(found, pa.int32())], names=["at", "ending"])

    found = np.zeros(len(words), np.int64)
    if len(words):
        for row in state.select("words", "endings").mapInArrow(ends, "at int, ending int").groupBy("at").agg(F.max("ending").alias("ending")).collect():
            found[row["at"]] = row["ending"]
    return words, counts, found


def op4_hmm(spark, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))


QUERIES = {"op4_hmm": (op4_hmm, None)}
