"""Packing documents into sequences as a cutting-stock problem solved by column generation.

Each document becomes the ids of its text and one end id, cut into full pieces and a rest. Only the histogram of
piece lengths, in classes of ``unit`` tokens, leaves the executors (at most ``capacity / unit`` counts). A linear
program over patterns (how many pieces of each class share a sequence) is solved by column generation: the simplex
duals price the classes, an unbounded-knapsack dynamic program finds the best new pattern, until no pattern costs less
than its price. Pattern counts are rounded down, the bounded rest is placed first-fit decreasing, and the pieces,
ranked inside their class, take the slots of the patterns in order. A class with very many pieces is ranked in salted
parts. A sequence thus holds at most ``capacity`` tokens and no piece is ever dropped.

Cases: a null or empty text is the end id alone. Repeated rows and null ids are packed like any other rows. A text of
any length is cut; no piece exceeds ``capacity``. An empty table gives no piece. Further columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm import common

CAPACITY = 2048
UNIT = 8
END_ID = 1
# Words a task remembers, twice.
_REMEMBERED = 600_000
# A word of plain letters with punctuation behind: its ids are those of the lower-cased letters, then of the marks. Any
# other word is taken whole.
_LINE = re.compile(r"(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|]*)|([^\n]+))\n")
_tokenizers: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one above 255."""
    spare = iter(range(256, 512))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordTokenizer:
    """Ids of whole texts from remembered ids of words; no token of this vocabulary crosses white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.merge = self.full.model.tokenize
        self.letters = _byte_letters()
        # Remembered words and parts, and those of the time before: when the new ones are full they become the old ones.
        self.words: dict[bytes, bytes] = {b"": b""}
        self.old_words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def _part(self, part: str) -> bytes:
        """Ids of one run of letters or of marks: what the merges make of its bytes."""
        found = self.parts.get(part)
        if found is None:
            text = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            found = self.parts[part] = array("I", [t.id for t in self.merge(text)]).tobytes()
        return found

    def _learn(self, fresh: list[bytes]) -> None:
        """Remember the ids of words not seen before."""
        words, rest = self.words, []
        lines = _LINE.findall(b"\n".join([*fresh, b""]).decode())
        for word, (letters, marks, other) in zip(fresh, lines):
            if other:
                rest.append(word)
            else:
                words[word] = self._part(letters.lower()) + self._part(marks)
        for word, found in zip(rest, self.full.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)):
            words[word] = array("I", found.ids).tobytes()

    def _ids(self, distinct: list[bytes]) -> list[bytes]:
        if len(self.words) > _REMEMBERED:
            self.words, self.old_words = {b"": b""}, self.words
        if len(self.parts) > _REMEMBERED:
            self.parts = {"": b""}
        words, fresh = self.words, []
        for word in distinct:
            if word not in words:
                ids = self.old_words.get(word)
                if ids is None:
                    fresh.append(word)
                else:
                    words[word] = ids
        self._learn(fresh)
        return list(map(words.__getitem__, distinct))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text begins and ends."""
        split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        words = split.flatten().dictionary_encode()
        found = self._ids(words.dictionary.cast(pa.binary()).to_pylist())
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, begins = np.frombuffer(b"".join(found), "<u4"), np.cumsum(sizes) - sizes
        at = words.indices.to_numpy()
        lengths = sizes[at]
        ends = np.cumsum(lengths)
        ids = flat[np.repeat(begins[at] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        return ids, np.append(0, ends)[np.cumsum(np.append(0, counts))]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
           capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``): full pieces and a rest per document."""
    path = tokenizer or default_tokenizer()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * ids
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        encode, names = _tokenizers[path], [x.split()[0] for x in schema.split(", ")]
        for _, part in common.chunks(batches):
            found, ends = encode(part.column("text").combine_chunks())
            rows = []
            for owner, a, b in zip(part.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                whole = found[a:b].tobytes() + end
                for start in range(0, len(whole), 4 * capacity):
                    one = whole[start : start + 4 * capacity]
                    row = (owner, start // 4, len(one) // 4, zlib.crc32(one), len(whole) // 4)
                    rows.append((*row, one) if ids else row)
            kinds = [pa.int64()] * 5 + [pa.binary()] * ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)


# --- column generation -----------------------------------------------------------------------------------------------


def best_pattern(prices: np.ndarray, width: int) -> np.ndarray:
    """Counts per class (class ``k`` takes ``k`` of ``width``) of the pattern with the highest price."""
    value, pick = np.zeros(width + 1), np.zeros(width + 1, int)
    for w in range(1, width + 1):
        gains = prices[1 : w + 1] + value[w - 1 :: -1][:w]
        k = int(gains.argmax())
        value[w], pick[w] = (gains[k], k + 1) if gains[k] > value[w - 1] else (value[w - 1], 0)
    counts, w = np.zeros(width + 1, int), width
    while w > 0:
        if pick[w]:
            counts[pick[w]] += 1
            w -= pick[w]
        else:
            w -= 1
    return counts


def cutting_stock(demand: np.ndarray, width: int, rounds: int = 20_000, eps: float = 1e-7):
    """Patterns, how often each is used so that every class ``k`` gets exactly ``demand[k]`` places, and the program's value.

    Revised simplex over the columns generated so far. ``rounds`` bounds the time only: any state of the program is a
    full packing. The value is the least number of sequences that fractions of patterns could do with.
    """
    used = np.flatnonzero(demand)
    if not len(used):
        return np.zeros((0, width + 1), int), np.zeros(0, int), 0.0
    basis = np.zeros((len(used), width + 1), int)
    basis[np.arange(len(used)), used] = width // used
    inverse = np.diag(1.0 / basis[np.arange(len(used)), used])
    amount = demand[used] * inverse.diagonal()
    for _ in range(rounds):
        prices = np.zeros(width + 1)
        prices[used] = inverse.sum(axis=0)
        column = best_pattern(prices, width)
        if prices @ column <= 1 + eps:
            break
        step = inverse @ column[used]
        ratio = np.full(len(used), np.inf)
        up = step > 1e-9
        ratio[up] = amount[up] / step[up]
        out = int(ratio.argmin())
        amount = np.maximum(amount - ratio[out] * step, 0)
        amount[out] = ratio[out]
        inverse[out] /= step[out]
        others = np.arange(len(used)) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        basis[out] = column
    # Rounded down against what is left, so that no pattern asks for more than there is.
    rest, patterns, times = demand.astype(np.int64).copy(), [], []
    for pattern, x in zip(basis, amount):
        has = pattern > 0
        n = min(int(x + 1e-6), int((rest[has] // pattern[has]).min()))
        if n:
            patterns.append(pattern)
            times.append(n)
            rest -= n * pattern
    for pattern, n in _first_fit(rest, width):
        patterns.append(pattern)
        times.append(n)
    return np.array(patterns).reshape(-1, width + 1), np.array(times, np.int64), float(amount.sum())


def _first_fit(rest: np.ndarray, width: int):
    """First-fit decreasing over classes: each sequence takes as many of the largest classes as fit."""
    rest = rest.copy()
    while rest.any():
        pattern, room = np.zeros(width + 1, int), width
        for k in np.flatnonzero(rest)[::-1]:
            n = min(room // k, int(rest[k]))
            pattern[k], room = n, room - n * k
        has = pattern > 0
        n = int((rest[has] // pattern[has]).min())
        rest -= n * pattern
        yield pattern, n


def slots(patterns: np.ndarray, times: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per class: first rank, first sequence and slot of each run of places; sequences are numbered in order."""
    first = np.concatenate([[0], np.cumsum(times)])
    found: dict[int, list] = {}
    for p, pattern in enumerate(patterns):
        slot = 0
        for k in np.flatnonzero(pattern)[::-1]:
            for _ in range(pattern[k]):
                found.setdefault(int(k), []).append((int(times[p]), int(first[p]), slot))
                slot += 1
    return {
        k: (np.cumsum([0] + [n for n, _, _ in runs])[:-1], np.array([s for _, s, _ in runs]), np.array([s for _, _, s in runs]))
        for k, runs in found.items()
    }


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
         capacity: int = CAPACITY, unit: int = UNIT, ids: bool = False) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: one row per piece."""
    cut = common.stored(pieces(docs, doc_id, text, tokenizer, capacity, ids))
    spark = docs.sparkSession
    salts = min(512, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    keyed = cut.withColumn("class", F.ceil(F.col("length") / unit).cast("int")).withColumn(
        "salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    # At most (capacity / unit) * salts counts come to the driver, whatever the number of documents.
    sizes = keyed.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n")).collect()
    width = capacity // unit
    table = np.zeros((width + 1, salts), np.int64)
    for row in sizes:
        table[row["class"], row["salt"]] = row["n"]
    before = np.cumsum(table, axis=1) - table
    places = slots(*cutting_stock(table.sum(axis=1), width)[:2])
    order = Window.partitionBy("class", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = keyed.withColumn("rank", F.row_number().over(order).cast("long") - 1)

    @F.pandas_udf("sequence_id long, slot int")
    def place(kind, salt, rank):
        import pandas as pd

        kind, rank = kind.to_numpy(), rank.to_numpy() + before[kind.to_numpy(), salt.to_numpy()]
        sequence, slot = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int32)
        for k in np.unique(kind):
            start, first, nth = places[int(k)]
            own = kind == k
            run = np.searchsorted(start, rank[own], side="right") - 1
            sequence[own], slot[own] = first[run] + rank[own] - start[run], nth[run]
        return pd.DataFrame({"sequence_id": sequence, "slot": slot})

    placed = ranked.withColumn("place", place("class", "salt", "rank")).select(*cut.columns, "place.*")
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long")).drop("slot")


def padded_length(length, capacity: int = CAPACITY):
    """Length of a sequence after padding: ``capacity``, or unchanged where the length is a power of two."""
    return F.when((length > 0) & (length.bitwiseAND(length - 1) == 0), length).otherwise(F.lit(capacity))


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))


QUERIES = {"op9_packing": (op9_packing, None)}
