"""Benchmark decontamination: short test items found inside long documents by size-partitioned MinHash containment search.

Texts are lower-cased (A-Z) and cut into words; shingles are five consecutive words (fewer words: the whole sequence).
An item with ``q`` distinct shingles is contained in a document that holds at least ``need = ceil(threshold * q)`` of
them. Items are partitioned by size (powers of two of ``q``). For each item its MinHash sketch keeps the
``q - need + 1`` smallest shingle hashes: a document that holds ``need`` shingles must hold one of the sketch, so the
search loses nothing. A document is looked up only in partitions whose items it is large enough to hold. Candidates are
verified on the shingles themselves, compared as text.

The items are the stated query set: they are read in blocks of ``block_bytes`` of text, and all documents pass each block.

Cases: a null, empty or blank document or item has no shingle and matches nothing. An item of fewer than five words
matches only documents that consist of the same words. Repeated items and documents are reported for each row; null
ids are reported as null. Empty tables give no match. Further columns are ignored, or pass through ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import common

WORDS, THRESHOLD = 5, 0.8
BLOCK_BYTES = 8_000_000
_FOUND = "array<struct<item:int, n_shared:long, n_shingles:long>>"


def shingle_hashes(ids: np.ndarray, size: int = WORDS) -> np.ndarray:
    return common.grams(ids, min(size, len(ids)), seed=min(size, len(ids))) if len(ids) else ids


def shingle_texts(words: list[bytes], at, size: int = WORDS) -> set[bytes]:
    return {b" ".join(words[i : i + size]) for i in at}


class ItemIndex:
    """Sketches of one block of items, partitioned by size."""

    def __init__(self, texts: list[bytes], threshold: float = THRESHOLD, size: int = WORDS):
        self.size = size
        self.shingles: list[set[bytes]] = []
        self.needs: list[int] = []
        parts: dict[int, list] = {}
        every = [np.empty(0, np.uint64)]
        for n, text in enumerate(texts):
            text = text.lower()
            words = common.WORDS.findall(text)
            hashes = np.unique(shingle_hashes(common.word_ids(text), size))
            exact = shingle_texts(words, range(max(1, len(words) - size + 1)) if words else (), size)
            need = int(np.ceil(threshold * len(exact) - 1e-9))
            self.shingles.append(exact)
            self.needs.append(max(1, need))
            if len(hashes):
                parts.setdefault(len(hashes).bit_length(), []).append((n, hashes[: len(exact) - need + 1]))
                every.append(hashes)
        self.every = np.unique(np.concatenate(every))
        self.parts = []
        for _, held in sorted(parts.items()):
            values = np.concatenate([h for _, h in held])
            owner = np.concatenate([np.full(len(h), n) for n, h in held])
            order = np.argsort(values, kind="stable")
            self.parts.append((min(self.needs[n] for n, _ in held), values[order], owner[order]))
        bits = max(10, int(np.ceil(np.log2(16 * (len(self.every) + 1)))))
        self.mask = np.uint64((1 << bits) - 1)
        self.sieve = np.zeros(1 << bits, bool)
        for _, values, _ in self.parts:
            self.sieve[values & self.mask] = True

    def search(self, text: bytes) -> list[tuple[int, int, int]]:
        """``(item, shared, shingles)`` for the items that the text contains."""
        text = text.lower()
        hashes = shingle_hashes(common.word_ids(text), self.size)
        maybe = np.unique(hashes[self.sieve[hashes & self.mask]])
        if not len(maybe):
            return []
        items: set[int] = set()
        for least, values, owner in self.parts:
            if least > len(hashes):
                break
            low, high = np.searchsorted(values, maybe, "left"), np.searchsorted(values, maybe, "right")
            for a, b in zip(low[low < high], high[low < high]):
                items.update(owner[a:b].tolist())
        if not items:
            return []
        near = np.searchsorted(self.every, hashes)
        near[near == len(self.every)] = 0
        held = shingle_texts(common.WORDS.findall(text), np.flatnonzero(self.every[near] == hashes), self.size)
        found = []
        for n in sorted(items):
            shared = len(self.shingles[n] & held)
            if shared >= self.needs[n]:
                found.append((n, shared, len(self.shingles[n])))
        return found


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size; one block at a time is on the driver."""
    block, size = [], 0
    for row in items.select(F.col(item_id).cast("long"), F.col(text).cast("binary")).toLocalIterator():
        if row[1] is None:
            continue
        block.append((row[0], bytes(row[1])))
        size += len(row[1]) + 100
        if size > block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(index: ItemIndex):
    @F.pandas_udf(_FOUND)
    def search(texts: pd.Series) -> pd.Series:
        names = ("item", "n_shared", "n_shingles")
        return pd.Series([[dict(zip(names, hit)) for hit in index.search(bytes(t))] if t is not None else [] for t in texts])

    return search


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
              item_text: str = "text", threshold: float = THRESHOLD, size: int = WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, n_shared, n_shingles, containment``: one row per document and item it contains."""
    spark, found = docs.sparkSession, None
    for block in item_blocks(items, item_id, item_text, block_bytes):
        search = _search(ItemIndex([t for _, t in block], threshold, size))
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], "item int, item_id long")
        hits = docs.select(F.col(doc_id).alias("doc_id"), F.inline(search(F.col(text).cast("binary"))))
        hits = hits.join(F.broadcast(names), "item")  # one block's ids: bounded by block_bytes
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = docs.select(F.col(doc_id).alias("doc_id"), F.lit(0).alias("item"), F.lit(0).cast("long").alias("n_shared"),
                            F.lit(1).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("item_id")).where("false")
    return found.select("doc_id", "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
          threshold: float = THRESHOLD, size: int = WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that contain no item."""
    for block in item_blocks(items, item_id, item_text, block_bytes):
        search = _search(ItemIndex([t for _, t in block], threshold, size))
        docs = docs.where(F.size(search(F.col(text).cast("binary"))) == 0)
    return docs


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contained(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def _shingles_sql(table: str, key: str) -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""SELECT DISTINCT nth, {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS shingle
    FROM (SELECT row_number() OVER () AS nth, {key}, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') AS w FROM {table} WHERE text IS NOT NULL)"""


OP10_SQL = f"""
WITH d AS ({_shingles_sql("documents", "doc_id")}),
i AS ({_shingles_sql("benchmark", "item_id")}),
n AS (SELECT nth, count(*) AS n_shingles FROM i GROUP BY nth)
SELECT any_value(d.doc_id) AS doc_id, any_value(i.item_id) AS item_id, count(*) AS n_shared,
  any_value(n_shingles) AS n_shingles, count(*) / any_value(n_shingles) AS containment
FROM d JOIN i ON d.shingle = i.shingle JOIN n ON n.nth = i.nth
GROUP BY d.nth, i.nth HAVING 5 * count(*) >= 4 * any_value(n_shingles)"""

QUERIES = {"op10_decontaminate": (op10_decontaminate, OP10_SQL)}
