"""What the operators share: words, hashing in numpy, linked groups, sorted blocks and the two-way exchange.

Texts are cut at the white space ``[\\x20\\x09-\\x0D]`` only, so that every operator and every SQL
counterpart sees the same words.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.session import checkpoint_dir

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"

# Text bytes that a task holds at a time where documents are worked on together.
CHUNK_BYTES = 6_000_000

# Most keys that chunks may ask of one shard, each counted once per chunk.
SHARD_KEYS = 1 << 20

# Parquet looks at the size of a page or row group only after 100 rows, and its reader takes a whole row group at a time:
# where a row holds megabytes, a task would hold all chunks of its split. With these a page is a row, a row group a few.
_BLOBS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder of ``spark.checkpoint.dir`` and go on from the files.

    Unlike ``checkpoint()``, which computes the last stage a second time for its copy, this runs it once. Rows with
    blobs are written and read back a few at a time, however many a task has.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    blobs = any(isinstance(f.dataType, T.BinaryType) for f in df.schema)
    df.write.options(compression="zstd", **(_BLOBS if blobs else {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc32_of(column: str) -> Column:
    """CRC-32 of the column as text; a null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def word_ids(text: bytes) -> np.ndarray:
    """One 64-bit hash per word."""
    words = WORDS.findall(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash pairs of 64-bit values; order matters."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x += b + np.uint64(2 * seed + 1)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


def grams(values: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` values, by joining runs of doubling length."""
    if len(values) < size:
        return np.empty(0, np.uint64)
    whole, at, step, run = None, 0, 1, values
    count = len(values) - size + 1
    while True:
        if size & step:
            part = run[at : at + count]
            whole = part if whole is None else mix(whole, part, seed)
            at += step
        step *= 2
        if step > size:
            return whole
        run = mix(run[: len(run) - step // 2], run[step // 2 :], seed)


def text_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """Texts as UTF-8, null as empty, one at a time from the Arrow buffer."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def shuffled(side: DataFrame) -> DataFrame:
    """A join side that grows with the table: it meets the other side in a shuffle, whatever ``autoBroadcastJoinThreshold``
    allows, as a broadcast is first collected by the driver and many of them are alive at a time."""
    return side.hint("merge")


# --- linked groups ---------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """Smallest id that each id reaches: ``(id, component)`` for ids that have a link.

    ``edges`` holds long columns ``a`` and ``b``. Rounds of large and small stars: every id links its
    neighbours to the smallest one it knows until each component is one star. A round is two grouped minima
    and two joins on the id, with reliable checkpoints between; the number of rounds grows with the
    logarithm of a chain's length.
    """
    pairs = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before, now = None, _digest(pairs)
    while now != before and now[0]:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(shuffled(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        own = F.struct(F.col("a"), F.col("m").alias("b"))
        found = F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = stored(large.join(shuffled(least), "a").select(F.inline(F.array(found, own))).where("a <> b").distinct())
        before, now = now, _digest(pairs)
    star = pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("id"), "component").distinct())


def _digest(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


# --- blocks of rows that share a key ---------------------------------------------------------------------------------


# A block's number holds two part numbers of so many bits.
PART_BITS = 31


def in_blocks(rows: DataFrame, key: str, row_id: str, block: int) -> DataFrame:
    """Rows that share ``key`` with another row, dealt to blocks: adds ``part``.

    A key with more than ``block`` rows is dealt to salted parts, and every pair of parts becomes one block,
    so that all rows of the key still meet in pairs while no block holds more than about ``2 * block`` rows.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(shuffled(sizes), key)
    parts = F.ceil(F.col("n") / block).cast("int")
    met = met.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64(F.col(row_id), F.lit(7)), F.col("parts")).cast("int"))
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("other", other)
    part = F.least("own", "other").cast("long") * F.lit(1 << PART_BITS) + F.greatest("own", "other")
    return met.withColumn("part", part).drop("n", "parts", "other")


def sorted_blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of equal ``keys`` from sorted batches: each table holds complete groups only."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            edge[1:] |= v[1:] != v[:-1]
        if rest:
            edge[0] = any(rest[-1].column(k)[-1] != batch.column(k)[0] for k in keys)
        cuts = np.flatnonzero(edge)
        if not len(cuts):
            rest.append(batch)
            continue
        last = int(cuts[-1])
        done = [*rest, batch.slice(0, last)] if last else rest
        if done:
            yield pa.Table.from_batches(done)
        rest = [batch.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest)


def group_starts(tab: pa.Table, keys: list[str]) -> np.ndarray:
    edge = np.zeros(tab.num_rows, bool)
    edge[:1] = True
    for k in keys:
        v = tab.column(k).to_numpy()
        edge[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(edge), tab.num_rows)


# --- two-way exchange between chunks of documents and shards of keys ----------------------------------------------------
#
# A chunk is a run of documents that one task reads together; what is kept of it is written once, so that its number
# names the same documents ever after. A chunk asks each shard once about its distinct keys, whatever the number of
# their occurrences: a key that fills a third of all rows reaches its shard as one entry per chunk.


def chunks(batches: Iterator[pa.RecordBatch], size: str = "text", limit: int = CHUNK_BYTES, each: int = 16) -> Iterator[tuple[int, pa.Table]]:
    """Numbered chunks of about ``limit`` bytes of the column ``size``, with ``each`` more for a row; every one gets a new number."""
    from pyspark import TaskContext

    number, held, weight = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        lengths = np.cumsum(_bytes_of(batch.column(size)) + each)
        at = 0
        while at < batch.num_rows:
            base = int(lengths[at - 1]) if at else 0
            end = int(np.searchsorted(lengths, base + limit - weight)) + 1
            held.append(batch.slice(at, end - at))
            weight += int(lengths[min(end, batch.num_rows) - 1]) - base
            at = end
            if weight >= limit:
                yield number, pa.Table.from_batches(held)
                number, held, weight = number + 1, [], 0
    if held:
        yield number, pa.Table.from_batches(held)


def _bytes_of(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def shards_of(spark: SparkSession) -> int:
    """One shard per shuffle partition: with as many partitions as the data needs, a shard's share of the distinct keys
    fits a task, and a chunk's request to a shard stays large enough to be worth a row."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shards_for(spark: SparkSession, keys: int) -> int:
    """Shards for so many asked keys: more than shuffle partitions if a shard would get more than ``SHARD_KEYS``."""
    return max(shards_of(spark), -(-keys // SHARD_KEYS))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of several megabytes, one at a time."""
    for batch in batches:
        for n in range(batch.num_rows):
            yield batch.slice(n, 1).to_pylist()[0]


def shard_cuts(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the shards begin and end in sorted ``keys``; shards are equal ranges of the hash."""
    edges = (np.arange(1, shards, dtype=np.uint64) * np.uint64((1 << 64) // shards)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges, "left"), [len(keys)]])


def from_blobs(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of all blobs in one array, and where each blob begins and ends."""
    parts = [np.frombuffer(b, kind) for b in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.empty(0, kind)), np.cumsum([0] + [len(p) for p in parts])
