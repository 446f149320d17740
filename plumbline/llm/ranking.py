"""Ranked lexical search over a term-partitioned index: bundles of items travel from one owner of terms to the next.

Terms are the runs of letters, digits and non-ASCII characters of the whole text, with A-Z lower-cased. A document scores,
over an item's terms with repeats, the sum of ``w * ((10^9 * tf) div (1000 * tf + 12 * m))`` in 64-bit integers, where
``w = floor(1000 * ln((2N + 2) / (2 df + 1)))`` and ``m = 75 + (25 * n * N) div L``.

* Index: documents are read in blocks; a block keeps its documents' ids and lengths and the postings of the terms that the
  items ask for, ordered by term. Totals and document frequencies are summed from the blocks.
* Owners: the terms are cut into ``OWNERS`` parts with about as many postings each, rare terms first. A bundle of items
  starts empty at each block of documents and passes the owners one after the other: at each it is cogrouped
  with the block's postings of that owner, which adds its integer contributions to the bundle's accumulators.
* An accumulator is sparse: ``(item, document, sum)``. It is dropped once the sum and all that later owners could add stay
  *below* the twentieth best sum of its item in the same block: then twenty others end above it. For the same
  reason an item whose later terms cannot lift a new document that far takes no new ones. Nothing is lost, ties included.
* The twenty best of each block meet in one ranking per item.

The items are the stated query set: they are read in bundles of bounded size, one bundle at a time on the driver, and all
documents pass each. A term that a third of all documents hold is one list per block, and lists are never joined.

Cases: null texts and texts without terms are no documents and no items (they find nothing); repeated items
and documents are ranked as rows of their own; equal scores are ordered by id, a null id last. Empty tables
give an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.llm import common, exchange

TOP, OWNERS = 20, 4
# Limits of a bundle of items, and of a block of documents: bytes of text, with so many for each document.
BUNDLE_ITEMS, BUNDLE_BYTES, BLOCK_BYTES, PER_DOCUMENT = 256, 2_000_000, 8_000_000, 1_000
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes(32 if c in SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = "block long, ids array<long>, terms array<int>, df array<long>, top_tf array<long>, n_terms long, body binary"
_STATE = "block long, ids array<long>, body binary"
_HIT = "item int, doc_id long, score long"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def bundles(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple]]:
    """``(id, terms with counts)`` of the items, a bounded number of them at a time on the driver."""
    held, size = [], 0
    for number, body in items.select(F.col(item_id).cast("long"), F.col(text).cast("binary")).toLocalIterator():
        counts = Counter(terms(bytes(body or b"")))
        if counts:
            held.append((number, counts))
            size += len(body)
        if len(held) >= BUNDLE_ITEMS or size >= BUNDLE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def indexed(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """Blocks of documents with the postings of ``vocabulary``, written once."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in common.chunks(batches, limit=BLOCK_BYTES, each=PER_DOCUMENT):
            ids, lengths, found = [], [], []
            for key, body in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                words = terms(body or b"")
                if words:
                    hits = np.fromiter((vocabulary.get(w, -1) for w in words), np.int64, len(words))
                    found.append((hits[hits >= 0] << 32) | len(ids))
                    ids.append(key)
                    lengths.append(len(words))
            pairs, tf = np.unique(np.concatenate([*found, np.empty(0, np.int64)]), return_counts=True)
            term = pairs >> 32
            names, first = np.unique(term, return_index=True)
            top = np.maximum.reduceat(tf, first) if len(first) else tf
            body = exchange.packed(np.array(lengths, np.int64), term.astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32), tf.astype(np.int32))
            df = np.diff(np.append(first, len(term)))
            row = [[number], [ids], [names.astype(np.int32)], [df], [top], [sum(lengths)], [body]]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, _BLOCK_TYPES)], names=_BLOCK_NAMES)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return common.stored(rows.mapInArrow(build, _BLOCK))


_BLOCK_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]
_LONGS = pa.list_(pa.int64())
_BLOCK_TYPES = [pa.int64(), _LONGS, pa.list_(pa.int32()), _LONGS, _LONGS, pa.int64(), pa.binary()]
_STATE_TYPES = [pa.int64(), _LONGS, pa.binary()]


def gain(tf, m):
    """One term's contribution before its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Owner:
    """The terms of one part, the items that ask for them, and what later parts can still add to an item."""

    def __init__(self, owned: list[int], weights: dict[int, int], asked: dict[int, tuple], rest: np.ndarray, n_docs: int, n_terms: int):
        self.asked = {t: (weights[t], *asked[t]) for t in owned if weights[t]}
        self.rest, self.n_docs, self.n_terms = rest, n_docs, n_terms

    def add(self, sums: np.ndarray, lengths: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> None:
        """Contributions of this part to ``sums[item, document]``."""
        m = 75 + (25 * lengths * self.n_docs) // self.n_terms
        names, first = np.unique(term, return_index=True)
        for t, a, b in zip(names.tolist(), first, np.append(first[1:], len(term))):
            if t in self.asked:
                weight, items, times = self.asked[t]
                value = weight * gain(tf[a:b].astype(np.int64), m[doc[a:b]])
                sums[items[:, None], doc[a:b]] += times[:, None] * value


def opened(body: bytes, n_docs: int) -> tuple[np.ndarray, ...]:
    """Lengths, terms, documents and frequencies of a block."""
    raw = exchange.unpacked(body)
    lengths, rest = np.frombuffer(raw, np.int64, n_docs), np.frombuffer(raw, np.int32, offset=8 * n_docs)
    return lengths, *rest.reshape(3, -1)


def passed(state: bytes | None, owner: Owner, block: tuple, n_items: int) -> tuple[np.ndarray, ...]:
    """A bundle's accumulators ``(item, document, sum)`` after this owner, and which items still take new documents."""
    lengths, term, doc, tf = block
    sums = np.zeros((n_items, len(lengths)), np.int64)
    alive = np.ones(sums.shape, bool)
    takes = np.ones(n_items, bool)
    if state is not None:
        raw = exchange.unpacked(state)
        takes = np.frombuffer(raw, bool, n_items)
        values = np.frombuffer(raw, np.int64, offset=n_items + -n_items % 8).reshape(2, -1)
        at = np.divmod(values[0], max(1, len(lengths)))
        sums[at] = values[1]
        alive[~takes] = False
        alive[at] = True
    owner.add(sums, lengths, term, doc, tf)
    sums[~alive] = 0
    least = np.zeros(n_items, np.int64)
    if len(lengths) >= TOP:
        least = np.partition(sums, len(lengths) - TOP, axis=1)[:, len(lengths) - TOP]
    takes = takes & (owner.rest >= least) & (owner.rest > 0)
    item, place = np.nonzero((sums > 0) & (sums + owner.rest[:, None] >= least[:, None]))
    return item, place, sums[item, place], takes


def best(docs: DataFrame, bundle: list[tuple], doc_id: str, text: str) -> DataFrame:
    """``item, doc_id, score``: for the items of one bundle, the best of each block of documents."""
    vocabulary = {t: n for n, t in enumerate(sorted(set().union(*[counts for _, counts in bundle])))}
    index, n_items = indexed(docs, vocabulary, doc_id, text), len(bundle)
    n_docs, n_terms = index.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    each = index.select(F.inline(F.arrays_zip("terms", "df", "top_tf"))).groupBy("terms").agg(F.sum("df").alias("df"), F.max("top_tf").alias("tf"))
    held = {r.terms: (r.df, r.tf) for r in each.collect()}  # terms of one bundle: bounded by BUNDLE_BYTES
    weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, (df, _) in held.items()}
    asked: dict[int, list] = {}
    for n, (_, counts) in enumerate(bundle):
        for t, times in counts.items():
            asked.setdefault(vocabulary[t], []).append((n, times))
    asked = {t: tuple(np.array(x, np.int64) for x in zip(*pairs)) for t, pairs in asked.items()}
    parts, seen, total = [[] for _ in range(OWNERS)], 0, sum(df for df, _ in held.values())
    for t in sorted(held, key=lambda t: (held[t][0], t)):
        parts[min(OWNERS - 1, OWNERS * seen // max(1, total))].append(t)
        seen += held[t][0]
    owners, rest = [], np.zeros(n_items, np.int64)
    for owned in reversed(parts):
        owners.append(Owner(owned, weights, asked, rest.copy(), n_docs, n_terms))
        for t in owned:
            items, times = asked[t]
            rest[items] += times * weights[t] * gain(held[t][1], 75)
    owners.reverse()
    state = index.select("block", "ids", F.lit(None).cast("binary").alias("body"))
    for owner, owned in zip(owners, parts):
        state = state.groupBy("block").cogroup(_postings(index, np.array(owned, np.int32)).groupBy("block")).applyInArrow(_stage(owner, n_items), _STATE)
    return state.mapInArrow(_select(n_items), _HIT)


def _postings(index: DataFrame, owned: np.ndarray) -> DataFrame:
    """``block, body``: each block's lengths and its postings of one owner's terms."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, n, body in zip(batch.column("block").to_pylist(), batch.column("n").to_pylist(), batch.column("body").to_pylist()):
                lengths, term, doc, tf = opened(body, n)
                own = np.isin(term, owned)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([exchange.packed(lengths, term[own], doc[own], tf[own])])], names=["block", "body"])

    return index.select("block", F.size("ids").alias("n"), "body").mapInArrow(cut, "block long, body binary")


def _stage(owner: Owner, n_items: int):
    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, state = left.column("ids").to_pylist()[0], left.column("body").to_pylist()[0]
        block = opened(right.column("body").to_pylist()[0], len(ids))
        item, place, sums, takes = passed(state, owner, block, n_items)
        padded = np.concatenate([takes, np.zeros(-n_items % 8, bool)])
        row = [[left.column("block").to_pylist()[0]], [ids], [exchange.packed(padded, item * len(ids) + place, sums)]]
        return pa.table([pa.array(v, k) for v, k in zip(row, _STATE_TYPES)], names=["block", "ids", "body"])

    return visit


def _select(n_items: int):
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = exchange.unpacked(row["body"])
                values = np.frombuffer(raw, np.int64, offset=n_items + -n_items % 8).reshape(2, -1)
                item, place = np.divmod(values[0], max(1, len(row["ids"])))
                none = np.array([x is None for x in row["ids"]], bool)
                ids = np.array([x or 0 for x in row["ids"]], np.int64)
                order = np.lexsort((ids[place], none[place], -values[1], item))
                start = np.searchsorted(item[order], item[order], "left")
                order = order[np.arange(len(order)) - start < TOP]
                named = pa.array(ids[place[order]], pa.int64(), mask=none[place[order]])
                yield pa.RecordBatch.from_arrays([pa.array(item[order], pa.int32()), named, pa.array(values[1][order])], names=["item", "doc_id", "score"])

    return choose


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the twenty best documents of each item, those with a score above 0."""
    spark, done = docs.sparkSession, None
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for bundle in bundles(items, item_id, item_text):
        hits = best(docs, bundle, doc_id, text).withColumn("rank", F.row_number().over(order)).where(f"rank <= {TOP}")
        names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(bundle)], "item int, item_id long")
        hits = hits.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # at most BUNDLE_ITEMS rows
        done = hits if done is None else done.unionByName(hits)
    if done is None:
        done = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return done


def op13_search(spark, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def _terms_sql(table: str, key: str) -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""SELECT row_number() OVER () AS nth, {key},
      regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM {table}"""


OP13_SQL = f"""
WITH d AS MATERIALIZED (SELECT *, len(terms) AS n FROM ({_terms_sql("documents", "doc_id")}) WHERE len(terms) > 0),
i AS MATERIALIZED (SELECT nth, any_value(item_id) AS item_id, term, count(*) AS times
  FROM (SELECT nth, item_id, unnest(terms) AS term FROM ({_terms_sql("benchmark", "item_id")})) GROUP BY nth, term),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM d),
p AS MATERIALIZED (SELECT nth, term, count(*) AS tf FROM (SELECT nth, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY nth, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, total GROUP BY term),
s AS (SELECT i.nth, any_value(i.item_id) AS item_id, d.nth AS doc, any_value(d.doc_id) AS doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM p JOIN i USING (term) JOIN w USING (term) JOIN d ON d.nth = p.nth, total GROUP BY i.nth, d.nth)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY nth ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= {TOP}"""

QUERIES = {"op13_search": (op13_search, OP13_SQL)}
