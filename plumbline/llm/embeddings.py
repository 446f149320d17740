"""Embedding near-duplicates through a pivot-permutation index.

Reference points (pivots) are vectors of the table, those with the smallest hash of the id: a bounded sample of at most
``MAX_PIVOTS``. Of sampled vectors that point almost the same way one stays: a large group of near copies would otherwise hold many
pivots, and which of them are nearest would be chance. Every vector is described by its ``prefix`` nearest pivots in order; inverted lists hold, per pivot, the
vectors that name it. Two vectors are candidates if they share at least ``shared`` pivots; candidates are verified by
cosine in double precision. Each pair is counted in one list only, that of the first pivot (by number) they share.
Lists longer than ``block`` are dealt to pairs of salted blocks. A task compares the vectors of a block by matrix products and emits
per vector the number of its links, and a spanning forest of the links, never the pairs.

Equal vectors are one entry of the index with a multiplicity, so a hot vector costs no pairs.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their own
component; so are vectors of other lengths than their partner's (lengths are indexed apart). Rows that repeat an id each
count as a vector. A row with a null id is linked and counted; its component is the smallest id reachable, or null, and
it is never kept. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import common

COSINE = 0.9
PREFIX, SHARED = 10, 2
APART = 0.7
MIN_PIVOTS, MAX_PIVOTS = 16, 4096
BLOCK = 2048


def unit(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = values / np.abs(values).max(axis=-1, keepdims=True)  # keeps huge and tiny components exact enough
        return scaled / np.sqrt((scaled * scaled).sum(axis=-1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def apart(pivots: np.ndarray, most: float = APART) -> np.ndarray:
    """The pivots whose cosine to every one kept before them is below ``most``."""
    kept = np.empty_like(pivots)
    n = 0
    for pivot in pivots:
        if not n or (kept[:n] @ pivot).max() < most:
            kept[n] = pivot
            n += 1
    return kept[:n]


def described(entries: DataFrame, pivots: np.ndarray, prefix: int) -> DataFrame:
    """``entries`` (``id, v, mult``) with ``pivots``: the numbers of the nearest pivots, nearest first."""
    width = pivots.shape[1]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                near = unit(_matrix(part.column("v"), width)) @ pivots.T
                k = min(prefix, near.shape[1])
                first = np.argpartition(-near, k - 1, axis=1)[:, :k]
                order = np.argsort(-np.take_along_axis(near, first, 1), axis=1, kind="stable")
                first = np.take_along_axis(first, order, 1).astype(np.int32)
                lists = pa.ListArray.from_arrays(np.arange(0, first.size + 1, k, dtype=np.int32), pa.array(first.ravel()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "v", "mult")), lists], names=["id", "v", "mult", "pivots"])

    return entries.select("id", "v", "mult").mapInArrow(describe, "id long, v array<double>, mult long, pivots array<int>")


def _compare(vectors, named, mult, side, pivot: int, shared: int, cosine: float):
    """Weighted link counts and forest of one block. ``side`` tells which salted part a row is from; pairs inside a
    part are left to the block of that part alone where two parts meet."""
    x = unit(vectors)
    # Rows as sets of pivots: how many two rows share, and whether they share one before this list's.
    known, place = np.unique(named, return_inverse=True)
    sets = np.zeros((len(x), len(known)), np.float32)
    sets[np.arange(len(x))[:, None], place.reshape(named.shape)] = 1
    earlier = known < pivot
    rows, cols, links = [], [], np.zeros(len(x), np.int64)
    for at in range(0, len(x), 256):
        part = slice(at, at + 256)
        near = x[part] @ x.T >= cosine
        near &= sets[part] @ sets.T >= shared - 0.5
        if earlier.any():
            near &= sets[part][:, earlier] @ sets[:, earlier].T < 0.5
        if side is not None:
            near &= side[part][:, None] != side[None, :]
        near[np.arange(near.shape[0]), at + np.arange(near.shape[0])] = False
        links[part] = near @ mult
        i, j = np.nonzero(near)
        keep = at + i < j
        i, j = _forest(len(x), at + i[keep], j[keep])
        rows.append(i)
        cols.append(j)
    i, j = _forest(len(x), np.concatenate(rows), np.concatenate(cols))
    return links, i, j


def _forest(n: int, i: np.ndarray, j: np.ndarray):
    """As few links as connect what the given ones connect: each row and the least row it reaches."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:
            short = new[new]
            if (short == new).all():
                break
            new = short
        new = new[label]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _links(postings: DataFrame, width: int, shared: int, cosine: float) -> DataFrame:
    """Rows ``a, b, n``: ``n`` links of entry ``a`` (``b`` null), or a link between ``a`` and ``b`` (``n`` null)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tab in common.sorted_blocks(batches, ["key", "part"]):
            starts = common.group_starts(tab, ["key", "part"])
            for low, high in zip(starts[:-1], starts[1:]):
                one = tab.slice(low, high - low)
                if one.num_rows < 2:
                    continue
                part, key = one.column("part")[0].as_py(), one.column("key")[0].as_py()
                side = one.column("own").to_numpy() if part >> common.PART_BITS != part & ((1 << common.PART_BITS) - 1) else None
                ids, mult = one.column("id").to_numpy(), one.column("mult").to_numpy()
                named = one.column("pivots").combine_chunks().flatten().to_numpy().reshape(one.num_rows, -1)
                links, i, j = _compare(_matrix(one.column("v"), width), named, mult, side, key, shared, cosine)
                some = links > 0
                a = np.concatenate([ids[some], ids[i]])
                b = pa.array(np.concatenate([np.zeros(some.sum(), np.int64), ids[j]]), mask=np.arange(len(a)) < some.sum())
                n = pa.array(np.concatenate([links[some], np.zeros(len(i), np.int64)]), mask=np.arange(len(a)) >= some.sum())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, n], names=["a", "b", "n"])

    return postings.mapInArrow(compare, "a long, b long, n long")


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE,
    prefix: int = PREFIX, shared: int = SHARED, block: int = BLOCK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per input row."""
    v = F.col(embedding).cast("array<double>")
    sound = F.coalesce(
        (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0),
        F.lit(False))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).withColumn("sound", sound)
    rows = common.stored(rows.withColumn("nth", F.monotonically_increasing_id()))
    classes = rows.where("sound").groupBy("v").agg(
        F.min("nth").alias("id"), F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("least"))
    classes = common.stored(classes)
    found = None
    for row in classes.groupBy(F.size("v").alias("width")).count().collect():  # one row per length that occurs
        part, width = classes.where(F.size("v") == row["width"]), row["width"]
        many = int(min(MAX_PIVOTS, max(MIN_PIVOTS, 4 * row["count"] ** 0.5)))
        # At most MAX_PIVOTS vectors come to the driver.
        chosen = part.orderBy(F.xxhash64("least", "v"), "id").limit(many).select("v").collect()
        pivots = apart(unit(np.array([r.v for r in chosen]).reshape(-1, width)))
        # With very few pivots all vectors share them: still exact, only without pruning.
        need = min(shared, len(pivots), prefix)
        named = described(part, pivots, prefix).withColumn("key", F.explode("pivots"))
        dealt = common.in_blocks(named, "key", "id", block).select("key", "part", "own", "id", "v", "mult", "pivots")
        dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part")
        links = _links(dealt, width, need, cosine)
        found = links if found is None else found.unionByName(links)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = common.stored(found)
    joined = common.components(found.where("b IS NOT NULL").select("a", "b"))
    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    entry = classes.join(common.shuffled(counts), "id", "left").join(common.shuffled(joined), "id", "left")
    entry = entry.withColumn("group", F.coalesce("component", "id"))
    least = entry.groupBy("group").agg(F.min("least").alias("component_id"))
    entry = entry.join(common.shuffled(least), "group").select("v", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    linked = rows.where("sound").join(common.shuffled(entry), "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op2_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_embeddings": (op2_embeddings, None)}
