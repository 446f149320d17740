"""Incremental, reversible removal of repeated lines: sharded cuckoo filters over exact reference counts.

A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased; keys of fewer than
``min_chars`` code points are never removed. The index holds

* ``refs``: exact references, one row per key and document (keys as 128-bit hashes),
* ``counts``: the exact reference-count table, one row per key: ``refs`` (documents) and ``first_doc``,
* ``filters``: per shard two cuckoo filters, of all keys (``seen``) and of keys with two or more documents
  (``repeated``). Both support insertion and deletion.

``insert`` asks ``seen`` which keys can be in the count table at all and touches no others; ``delete`` lowers
counts and takes keys out of the filters again, so that inserting documents and deleting them leaves the same
decisions as before. ``dedupe`` asks ``repeated``; what the filter passes is verified in the count table. Every
state is a set of new files in the shared folder; an older one stays valid.

Cases: a null or empty text is one empty line. Rows with the same id are one document. Rows whose id is null are
together one document that comes after all others. Repeated rows stay repeated. An empty table gives empty tables.
Other columns pass through ``dedupe`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from plumbline.llm import common

MIN_CHARS = 10
# Keys that one shard's filters are planned for; the number of shards follows the number of keys.
SHARD_KEYS = 50_000
# Groups that the probes of one shard are dealt to, each with a copy of the shard's filter.
PROBE_SALTS = 8
_NO_ID = (1 << 63) - 1
_UPPER = {c: c + 32 for c in range(65, 91)}


def line_key(line: str) -> str:
    return line.strip(common.SPACE).translate(_UPPER)


def key_hash(key: str) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(key.encode())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


# --- cuckoo filter ---------------------------------------------------------------------------------------------------


class Cuckoo:
    """Buckets of four 16-bit fingerprints; keys that find no place wait in an exact stash."""

    SLOTS, KICKS = 4, 200

    def __init__(self, capacity: int = 0, blob: bytes | None = None):
        if blob is None:
            self.size = 1 << max(0, (int(capacity / 0.8) // self.SLOTS)).bit_length()
            self.cells = np.zeros(self.size * self.SLOTS, np.uint16)
            self.stash: list[int] = []
        else:
            self.size = int.from_bytes(blob[:8], "little")
            end = 8 + 2 * self.SLOTS * self.size
            self.cells = np.frombuffer(blob[8:end], np.uint16).copy()
            self.stash = np.frombuffer(blob[end:], np.uint64).tolist()

    def blob(self) -> bytes:
        return self.size.to_bytes(8, "little") + self.cells.tobytes() + np.array(self.stash, np.uint64).tobytes()

    def places(self, keys: np.ndarray):
        """Fingerprint and the two buckets of each key; each bucket follows from the other and the fingerprint."""
        mark = (keys >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (keys & np.uint64(self.size - 1)).astype(np.int64)
        return mark, first, first ^ self._turn(mark)

    def _turn(self, mark):
        spread = np.asarray(mark).astype(np.uint64) * np.uint64(0x5BD1E995C2B2AE35)
        return ((spread >> np.uint64(20)) & np.uint64(self.size - 1)).astype(np.int64)

    def insert(self, keys: np.ndarray) -> None:
        if not len(keys):
            return
        cells, slots, turn = self.cells, self.SLOTS, 0
        for key, mark, i, j in zip(keys.tolist(), *(x.tolist() for x in self.places(keys))):
            for b in (i, j):
                free = np.flatnonzero(cells[b * slots : b * slots + slots] == 0)
                if len(free):
                    cells[b * slots + free[0]] = mark
                    break
            else:
                moves, b, held = [], j, mark
                for _ in range(self.KICKS):
                    turn += 1
                    at = b * slots + turn % slots
                    moves.append((at, int(cells[at])))
                    cells[at], held = held, int(cells[at])
                    b ^= int(self._turn(np.array([held], np.uint16))[0])
                    free = np.flatnonzero(cells[b * slots : b * slots + slots] == 0)
                    if len(free):
                        cells[b * slots + free[0]] = held
                        break
                else:
                    for at, old in reversed(moves):
                        cells[at] = old
                    self.stash.append(key)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, bool)
        mark, i, j = self.places(keys)
        rows = self.cells.reshape(-1, self.SLOTS)
        found = (rows[i] == mark[:, None]).any(axis=1) | (rows[j] == mark[:, None]).any(axis=1)
        return found | np.isin(keys, np.array(self.stash, np.uint64)) if self.stash else found

    def remove(self, keys: np.ndarray) -> None:
        """Only keys that were inserted may be removed."""
        if not len(keys):
            return
        for key, mark, i, j in zip(keys.tolist(), *(x.tolist() for x in self.places(keys))):
            if key in self.stash:
                self.stash.remove(key)
                continue
            for b in (i, j):
                at = np.flatnonzero(self.cells[b * self.SLOTS : (b + 1) * self.SLOTS] == mark)
                if len(at):
                    self.cells[b * self.SLOTS + at[0]] = 0
                    break


# --- index -----------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LineIndex:
    refs: DataFrame  # k1, k2, doc_id
    counts: DataFrame  # k1, k2, refs, first_doc
    filters: DataFrame  # shard, seen, repeated, n_seen, n_repeated
    shards: int
    min_chars: int = MIN_CHARS


def line_refs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``k1, k2, doc_id``: each key of enough code points once per document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, ids = [], [], []
            for owner, body in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                keys = {k for k in map(line_key, (body or "").split("\n")) if len(k) >= min_chars}
                for a, b in map(key_hash, keys):
                    k1.append(a)
                    k2.append(b)
                ids += [owner] * len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(ids, pa.int64())], names=["k1", "k2", "doc_id"])

    own = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("doc_id")
    return docs.select(own, F.col(text).alias("text")).mapInArrow(read, "k1 long, k2 long, doc_id long").distinct()


def _counted(refs: DataFrame) -> DataFrame:
    return refs.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first_doc"))


def _shard(shards: int):
    return F.pmod(F.col("k2"), F.lit(shards)).cast("int")


_FILTERS = "shard int, seen binary, repeated binary, n_seen long, n_repeated long"


def _filters(counts: DataFrame, shards: int) -> DataFrame:
    def build(group: pa.Table) -> pa.Table:
        keys, many = group.column("k1").to_numpy().view(np.uint64), group.column("refs").to_numpy() > 1
        seen, repeated = Cuckoo(max(len(keys), SHARD_KEYS // 4)), Cuckoo(max(int(many.sum()), SHARD_KEYS // 4))
        seen.insert(keys)
        repeated.insert(keys[many])
        return pa.table({"shard": group.column("shard")[:1], "seen": [seen.blob()], "repeated": [repeated.blob()],
                         "n_seen": [len(keys)], "n_repeated": [int(many.sum())]})

    return counts.withColumn("shard", _shard(shards)).select("shard", "k1", "refs").groupBy("shard").applyInArrow(build, _FILTERS)


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> LineIndex:
    """Insert all documents into an empty index."""
    refs = common.stored(line_refs(docs, doc_id, text, min_chars))
    counts = common.stored(_counted(refs))
    shards = max(1, -(-counts.count() // SHARD_KEYS))
    return LineIndex(refs, counts, common.stored(_filters(counts, shards)), shards, min_chars)


def _probe(index: LineIndex, keys: DataFrame, which: str) -> DataFrame:
    """The rows of ``keys`` (k1, k2, doc_id) whose key the shard's filter may hold."""

    def ask(salt_and_shard, rows: pa.Table, stored: pa.Table) -> pa.Table:
        held = np.zeros(rows.num_rows, bool)
        if stored.num_rows and rows.num_rows:
            held = Cuckoo(blob=stored.column("filter")[0].as_py()).holds(rows.column("k1").to_numpy().view(np.uint64))
        return rows.select(["k1", "k2", "doc_id"]).filter(pa.array(held))

    asked = keys.withColumn("shard", _shard(index.shards)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(PROBE_SALTS)).cast("int"))
    copies = index.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(PROBE_SALTS - 1))).alias("salt"), F.col(which).alias("filter"))
    pairs = asked.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt"))
    return pairs.applyInArrow(ask, "k1 long, k2 long, doc_id long")


def _changed(index: LineIndex, refs: DataFrame, counts: DataFrame, moved: DataFrame) -> LineIndex:
    """New filters after counts moved; ``moved`` has ``k1, k2, old, new`` reference counts."""

    def turn(_, filters: pa.Table, rows: pa.Table) -> pa.Table:
        keys, old, new = (rows.column(c).to_numpy() for c in ("k1", "old", "new"))
        keys, out = keys.view(np.uint64), {"shard": (filters if filters.num_rows else rows).column("shard").combine_chunks()[:1]}
        for name, least in (("seen", 1), ("repeated", 2)):
            one = Cuckoo(blob=filters.column(name)[0].as_py()) if filters.num_rows else Cuckoo(SHARD_KEYS)
            one.remove(keys[(old >= least) & (new < least)])
            one.insert(keys[(old < least) & (new >= least)])
            had = filters.column(f"n_{name}")[0].as_py() if filters.num_rows else 0
            out |= {name: [one.blob()], f"n_{name}": [had + int((new >= least).sum() - (old >= least).sum())]}
        return pa.table(out).select([x.split()[0] for x in _FILTERS.split(", ")])

    rows = moved.withColumn("shard", _shard(index.shards)).select("shard", "k1", "old", "new")
    filters = common.stored(index.filters.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(turn, _FILTERS))
    shards = index.shards
    if (filters.agg(F.max("n_seen")).first()[0] or 0) > 2 * SHARD_KEYS:
        shards = max(1, -(-counts.count() // SHARD_KEYS))
        filters = common.stored(_filters(counts, shards))
    return replace(index, refs=refs, counts=counts, filters=filters, shards=shards)


def insert(index: LineIndex, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
    """The index after more documents; lines of ids it already holds are added to those documents."""
    fresh = common.stored(line_refs(docs, doc_id, text, index.min_chars))
    # Only keys that the filter may hold can have references; the rest are new without a look at the tables.
    maybe = _probe(index, fresh, "seen").select("k1", "k2").distinct()
    touched = index.refs.join(maybe, ["k1", "k2"], "left_semi").unionByName(fresh).distinct()
    after = _counted(touched).withColumnRenamed("refs", "new")
    old = index.counts.select("k1", "k2", F.col("refs").alias("old"))
    moved = common.stored(after.join(old, ["k1", "k2"], "left").na.fill(0, ["old"]))
    rest = index.counts.join(moved.select("k1", "k2"), ["k1", "k2"], "left_anti")
    counts = common.stored(rest.unionByName(moved.select("k1", "k2", F.col("new").alias("refs"), "first_doc")))
    refs = common.stored(index.refs.unionByName(fresh).distinct())
    return _changed(index, refs, counts, moved)


def delete(index: LineIndex, ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
    """The index without the documents listed in ``ids``."""
    gone = ids.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("doc_id")).distinct()
    refs = common.stored(index.refs.join(gone, "doc_id", "left_anti"))
    keys = index.refs.join(gone, "doc_id", "left_semi").select("k1", "k2").distinct()
    after = _counted(refs.join(keys, ["k1", "k2"], "left_semi")).withColumnRenamed("refs", "new")
    old = index.counts.join(keys, ["k1", "k2"], "left_semi").select("k1", "k2", F.col("refs").alias("old"))
    moved = common.stored(old.join(after, ["k1", "k2"], "left").na.fill(0, ["new"]))
    rest = index.counts.join(moved.select("k1", "k2"), ["k1", "k2"], "left_anti")
    left = moved.where("new > 0").select("k1", "k2", F.col("new").alias("refs"), "first_doc")
    return _changed(index, refs, common.stored(rest.unionByName(left)), moved)


def dedupe(index: LineIndex, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", inserted: bool = False) -> DataFrame:
    """``docs`` with ``text`` rewritten, and ``n_lines`` and ``n_dropped`` before and of the removal.

    A line goes if the index holds its key in two or more documents and this document is not the first of them.
    ``inserted`` says that the index holds just these documents, so that its references serve as theirs.
    """
    own = index.refs if inserted else line_refs(docs, doc_id, text, index.min_chars)
    maybe = _probe(index, own, "repeated")
    repeated = index.counts.where("refs > 1").select("k1", "k2", "first_doc")
    drops = maybe.join(repeated, ["k1", "k2"]).where("doc_id <> first_doc")
    drops = drops.groupBy("doc_id").agg(F.collect_list("k1").alias("drop1"), F.collect_list("k2").alias("drop2"))
    drops = drops.select(F.col("doc_id").alias("owner"), "drop1", "drop2")
    least = index.min_chars

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def rewrite(texts, drop1, drop2):
        import pandas as pd

        out = []
        for body, a, b in zip(texts, drop1, drop2):
            lines = (body or "").split("\n")
            kept = lines
            if a is not None and len(a):
                dropped = set(zip(a.tolist(), b.tolist()))
                keys = map(line_key, lines)
                kept = [x for x, k in zip(lines, keys) if len(k) < least or key_hash(k) not in dropped]
            out.append((body if len(kept) == len(lines) else "\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    names = [c for c in docs.columns if c != text]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(text).alias("body"),
                      F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("owner"))
    done = row.join(drops, "owner", "left").withColumn("done", rewrite("body", "drop1", "drop2"))
    cols = [F.col("done.text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns]
    extra = [F.col(f"done.{c}") for c in ("n_lines", "n_dropped") if c not in docs.columns]
    return done.select(*cols, *extra)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = dedupe(build(docs), docs, inserted=True)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = f"""
WITH split AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS nth
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), keyed AS (SELECT doc_id, nth, line, {_KEY} AS k FROM split),
shared AS (
  SELECT k, min(doc_id) AS first_doc FROM keyed WHERE length(k) >= {MIN_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) > 1
), judged AS (
  SELECT keyed.*, coalesce(doc_id <> first_doc, false) AS gone FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

QUERIES = {"op7_line_dedup": (op7_line_dedup, OP7_SQL)}
