"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight byte positions. Two fingerprints that differ in at most ``distance`` bits share
at least ``8 - distance`` positional bytes (four, for four bits). Posting lists are kept for triples of
positions, chosen so that any four positions hold one of the triples: a pair that can reach the guaranteed
minimum therefore meets in some list, and lists are 65,536 times shorter than those of a single byte. In a list
the shared positional bytes of each pair are tallied, pairs below the minimum are dropped, the rest verified by
bit distance. Equal fingerprints are one entry of the index.

Cases: a null or empty text, and one without words, has fingerprint zero and is linked like any other. Rows that
repeat share a fingerprint and so a component. A row with a null id is linked like any other; ``component_id`` is null
only if nothing in the group has an id. An empty table gives an empty result.
Further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import common

SHINGLE = 4
DISTANCE = 4
# Fingerprints of one posting list that meet in one block; longer lists are dealt to pairs of blocks.
BLOCK = 4096
# Shingle hashes whose bits are counted at a time.
_STEP = 1 << 15
_PARTS = ((0, 1, 2), (3, 4, 5), (6, 7))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of ``text``, repeats included; XXH64 with seed 42; ties give 0."""
    words = common.WORDS.findall(text.lower())
    if not words:
        return 0
    if len(words) <= shingle:
        runs = iter([b" ".join(words)])
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    count = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, _STEP):
        rows = hashes[at : at + _STEP].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: one row per input row; ``fp`` holds the 64 bits as a long."""

    return docs.select(F.col(doc_id).alias("doc_id"), _signed(shingle)(F.col(text).cast("binary")).alias("fp"))


def _signed(shingle: int):
    @F.pandas_udf("long")
    def signed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            values = [fingerprint(bytes(t) if t is not None else b"", shingle) for t in part]
            yield pd.Series(np.array(values, np.uint64).view(np.int64))

    return signed


def position_sets(distance: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that any ``8 - distance`` positions hold one of them whole.

    With four shared bytes these are the 20 triples that lie in one of three parts, or take two positions of a
    part and one of the next; with more bits allowed the lists are those of single positions.
    """
    if distance <= 4:
        sets = [c for part in _PARTS for c in combinations(part, 3)]
        for i, part in enumerate(_PARTS):
            sets += [(*two, one) for two in combinations(part, 2) for one in _PARTS[(i + 1) % 3]]
        return sets
    if distance > 7:
        raise ValueError("with 8 bits or more no positional byte needs to be shared")
    return [(i,) for i in range(8)]


def links(entries: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` between entries ``id, fp`` of distinct fingerprints: enough of them to connect all that
    are within ``distance`` bits, not every pair of a dense group."""
    sets = position_sets(distance)

    def byte(p: int):
        return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))

    keys = []
    for n, places in enumerate(sets):
        key = F.lit(n).cast("long")
        for p in places:
            key = key * 256 + byte(p)
        keys.append(key)
    postings = entries.select("id", "fp", F.explode(F.array(*keys)).alias("key"))
    met = common.in_blocks(postings, "key", "id", block).select("key", "part", "id", "fp")
    met = met.repartition("key", "part").sortWithinPartitions("key", "part")
    least = 8 - distance

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in common.sorted_blocks(batches, ["key", "part"]):
            starts = common.group_starts(tab, ["key", "part"])
            ids, fps = tab.column("id").to_numpy(), tab.column("fp").to_numpy().view(np.uint64)
            a, b = _linked(ids, fps, starts, least, distance)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return met.mapInArrow(verify, "a long, b long").distinct()


def _close(x: np.ndarray, y: np.ndarray, least: int, distance: int) -> np.ndarray:
    """Count filter, then bit distance; ``x`` and ``y`` broadcast."""
    xor = np.bitwise_xor(x, y)
    shared = np.zeros(xor.shape, np.uint8)
    for p in range(8):
        shared += (xor >> np.uint64(8 * p)) & np.uint64(255) == 0
    return (shared >= least) & (np.bitwise_count(xor) <= distance)


def _linked(ids, fps, starts, least, distance, small: int = 12):
    """Links in groups of rows: small groups by comparing rows at every offset at once, large ones by search."""
    sizes = np.diff(starts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    a, b = [], []
    few = sizes[group] <= small
    for d in range(1, small):
        at = np.flatnonzero(few[:-d] & (group[:-d] == group[d:])) if len(group) > d else np.empty(0, int)
        if not len(at):
            break
        at = at[_close(fps[at], fps[at + d], least, distance)]
        a.append(ids[at])
        b.append(ids[at + d])
    for g in np.flatnonzero(sizes > small):
        i, j = _search(fps[starts[g] : starts[g + 1]], least, distance)
        a.append(ids[starts[g] + i])
        b.append(ids[starts[g] + j])
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def _search(fps: np.ndarray, least: int, distance: int, width: int = 32):
    """A spanning forest of the links in one block: rows found leave the search, so a dense group costs little."""
    rest, i, j = np.arange(len(fps)), [], []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            now, front = front[:width], front[width:]
            near = _close(fps[now][:, None], fps[rest][None, :], least, distance)
            hit = near.any(axis=0)
            if hit.any():
                i.append(now[near[:, hit].argmax(axis=0)])
                j.append(rest[hit])
                front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    none = np.empty(0, int)
    return (np.concatenate(i), np.concatenate(j)) if i else (none, none)


def groups(marked: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``fp, group, component_id`` for the fingerprints of ``marked`` (``doc_id, fp``): which are linked, directly or not."""
    firsts = common.stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = common.components(links(firsts.select(F.col("fp").alias("id"), "fp"), distance, block))
    named = firsts.join(common.shuffled(joined.withColumnRenamed("id", "fp")), "fp", "left")
    named = named.withColumn("group", F.coalesce("component", "fp"))
    least = named.groupBy("group").agg(F.min("first").alias("component_id"))
    return named.select("fp", "group").join(common.shuffled(least), "group")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE,
    block: int = BLOCK,
) -> DataFrame:
    """``doc_id, fingerprint, component_id, kept``: one row per input row.

    ``component_id`` is the smallest id reachable through links of at most ``distance`` bits; ``kept`` marks it.
    """
    marked = common.stored(fingerprints(docs, doc_id, text, shingle))
    return marked.join(common.shuffled(groups(marked, distance, block)), "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE,
    block: int = BLOCK,
) -> DataFrame:
    """One row of each group with the columns of ``docs``: the smallest id, ids before nulls; ties by a hash of the text."""
    bits = _signed(shingle)(F.col(text).cast("binary"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), F.col(doc_id).alias("doc_id"), bits.alias("fp"), F.xxhash64(text).alias("h"))
    rows = common.stored(rows.withColumn("nth", F.monotonically_increasing_id()))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "h", "nth")
    marked = rows.select("doc_id", "fp", "h", "nth")
    best = marked.join(common.shuffled(groups(marked, distance, block)), "fp").groupBy("group").agg(F.min_by("nth", order).alias("nth"))
    return rows.join(common.shuffled(best.select("nth")), "nth", "left_semi").select("row.*")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": (op1_simhash, None)}
