"""Chunks of whole texts, and questions about keys that all chunks ask of shards.

``text_chunks`` writes the documents once, compressed, a chunk per row. ``ask`` sends the distinct keys of each chunk to
the shard of the key; ``cogrouped`` brings the answers back to the chunk. A key reaches its shard once per chunk however
often it occurs, so a key that fills a third of all rows is no hot spot, and no task holds more than a chunk or a
shard's share of the distinct keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import common

CHUNKS = "chunk long, ids array<long>, sizes binary, body binary"


def text_chunks(docs: DataFrame, doc_id: str, text: str, limit: int, extra: Callable | None = None) -> DataFrame:
    """``chunk, ids, sizes, body``: texts of about ``limit`` bytes, joined and compressed; null texts are empty.

    ``extra(sizes, body)`` makes a blob that is kept beside the chunk in a further column, for later steps to read.
    """
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    names = ["chunk", "ids", "sizes", "body", "extra"][: 5 if extra else 4]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in common.chunks(batches, limit=limit):
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            whole = b"".join(texts)
            row = [[number], [part.column("doc_id").to_pylist()], [sizes.tobytes()], [zstandard.ZstdCompressor(3).compress(whole)]]
            row += [[extra(sizes, whole)]] if extra else []
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], names=names)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return common.stored(rows.mapInArrow(read, CHUNKS + (", extra binary" if extra else "")))


def opened(row: dict) -> tuple[list, np.ndarray, bytes]:
    """Ids, sizes and joined texts of a chunk."""
    return row["ids"], np.frombuffer(row["sizes"], np.int64), zstandard.ZstdDecompressor().decompress(row["body"])


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    return zstandard.ZstdCompressor(1).compress(b"".join(a.tobytes() for a in arrays))


def unpacked(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def asked(source: DataFrame, shards: int, questions: Callable) -> DataFrame:
    """``shard, chunk, n, body``: what ``questions(row)`` of each source row sends to each shard.

    ``questions`` returns keys in ascending order and a function that packs the entries ``[a, b)``.
    """

    def send(key: int, keys: np.ndarray, pack: Callable) -> pa.RecordBatch:
        cuts = common.shard_cuts(keys, shards)
        full = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array([key] * len(full), pa.int64()), pa.array(np.diff(cuts)[full], pa.int64()),
             pa.array([pack(cuts[s], cuts[s + 1]) for s in full], pa.binary())], names=["shard", "chunk", "n", "body"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                yield send(one["chunk"], *questions(one, {}))

    def paired(left: pa.Table, right: pa.Table) -> pa.Table:
        one = left.to_pylist()[0]
        return pa.Table.from_batches([send(one["chunk"], *questions(one, answers_of(right)))])

    schema = "shard int, chunk long, n long, body binary"
    if isinstance(source, tuple):
        state, answers = source
        return state.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(paired, schema)
    return source.mapInArrow(alone, schema)


def answers_of(table: pa.Table) -> dict[int, bytes]:
    """The answers of each round, in the order of the asked keys."""
    found: dict[int, list] = {}
    if table.num_rows:
        table = table.sort_by([("round", "ascending"), ("shard", "ascending")])
        for r, body in zip(table.column("round").to_pylist(), table.column("body").to_pylist()):
            found.setdefault(r, []).append(unpacked(body))
    return {r: b"".join(parts) for r, parts in found.items()}


def answered(questions: DataFrame, round_number: int, judge: Callable) -> DataFrame:
    """``chunk, round, shard, body``: ``judge(bodies, counts)`` returns per question an array of answers."""

    def answer(group: pa.Table) -> pa.Table:
        bodies = [unpacked(b) for b in group.column("body").to_pylist()]
        back = judge(bodies, group.column("n").to_pylist())
        n = group.num_rows
        return pa.table({"chunk": group.column("chunk"), "round": pa.array([round_number] * n, pa.int32()),
                         "shard": group.column("shard"), "body": pa.array([packed(x) for x in back], pa.binary())})

    schema = "chunk long, round int, shard int, body binary"
    return common.stored(questions.groupBy("shard").applyInArrow(answer, schema))


def finished(state: DataFrame, answers: DataFrame, finish: Callable, schema: str) -> DataFrame:
    """``finish(row, answers)`` per chunk returns the columns of the result."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = finish(left.to_pylist()[0], answers_of(right))
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return state.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(close, schema)


def split_counts(counts: list[int]) -> np.ndarray:
    return np.cumsum([0, *counts])
