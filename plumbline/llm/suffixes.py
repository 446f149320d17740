"""Removal of repeated byte strings by threshold-bounded interval expansion.

A suffix array of a whole corpus does not fit a shuffle, so its rows are thinned first. Every window of ``length`` bytes
has an anchor: of the 24-byte strings inside it the one with the smallest hash, the leftmost of equals. Equal windows
have equal anchors at equal places, so windows can only be equal if their anchors are. Round one of the exchange asks
which anchors occur in two documents; all windows around others stay.

In round two the anchors of a shard are the rows of a suffix order: they are sorted by what follows the anchor, and
neighbours know how much of it they share. The bytes before the anchors, in that order, are the Burrows-Wheeler column. The
intervals of one anchor are expanded breadth first: each round extends the strings backward by one byte, splitting an
interval by its preceding bytes, while the part that has to follow shrinks by one, so that the strings compared always
have the minimum length and the expansion stops as soon as no window reaches further. An interval that holds a document
with a smaller id marks its windows. Equal rows are one row before they are sent and again in the shard; an anchor with
a single distinct row left is not expanded.

Cases: a null or empty text has no byte. Texts shorter than ``length`` lose nothing. Rows that repeat an id are one
document: nothing in them is removed because of each other. Rows with a null id come after all others and do not remove from each other.
An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from plumbline.llm import common, exchange

LENGTH, GRAM = 50, 24
_LAST = (1 << 63) - 1


def anchors(sizes: np.ndarray, body: bytes, length: int) -> bytes:
    """The anchors of a chunk, packed: how far each is from the one before, and the most and least bytes that a window naming it has before it."""
    hashes, ends = _gram_hashes(body), np.cumsum(sizes)
    count = max(0, len(body) - length + 1)
    at = _leftmost_minimum(hashes, length - GRAM + 1)[:count]
    inside = np.zeros(count + 1, np.int64)
    full = sizes >= length
    np.add.at(inside, (ends - sizes)[full], 1)
    np.add.at(inside, (ends - length + 1)[full], -1)
    windows = np.flatnonzero(np.cumsum(inside[:count]) > 0)
    at = at[windows]
    new = np.append(True, (at[1:] != at[:-1]) | (np.diff(windows) != 1))[: len(windows)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(windows)) - 1
    at = at[first]
    most, least = at - windows[first], at - windows[last]
    steps = np.diff(at, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4)
    return exchange.packed(steps.T, most.astype(np.uint8), least.astype(np.uint8))


class Regions:
    """The anchors of a chunk, found when it was written, with the windows that name them."""

    def __init__(self, row: dict, length: int):
        self.ids, self.sizes, self.body = exchange.opened(row)
        self.text = np.frombuffer(self.body, np.uint8)
        self.side = length - GRAM
        self.ends = np.cumsum(self.sizes)
        owners = np.array([_LAST if i is None else i for i in self.ids], np.int64)
        held = np.frombuffer(exchange.unpacked(row["extra"]), np.uint8).reshape(6, -1)
        self.at = np.cumsum(np.ascontiguousarray(held[:4].T).view("<u4").ravel(), dtype=np.int64)
        self.most, self.least = held[4].astype(np.int64), held[5].astype(np.int64)  # bytes of a window before the anchor
        self.doc = owners[np.searchsorted(self.ends, self.at, side="right")] if len(self.at) else owners[:0]
        gram = self.text[self.at[:, None] + np.arange(GRAM)] if len(self.at) else np.empty((0, GRAM), np.uint8)
        small = _joined(*np.ascontiguousarray(gram).view("<u8").T)
        self.key = common.mix(small, small, 5000)  # minima crowd at small values; the shards are ranges

    def distinct_keys(self):
        order = np.argsort(self.key, kind="stable")
        keys, doc = self.key[order] >> np.uint64(16), self.doc[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
        if not len(first):
            return keys, np.zeros(0, bool), np.zeros(0, np.int64)
        many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
        place = np.empty(len(order), np.int64)
        place[order] = np.searchsorted(first, np.arange(len(order)), side="right") - 1
        return keys[first], many, place

    def rows(self, shared: np.ndarray):
        """Distinct rows of the shared anchors, sorted; the smallest document of each; which region has which row."""
        *_, place = self.distinct_keys()
        self.chosen = np.flatnonzero(shared[place]) if len(place) else place
        at, most, least = self.at[self.chosen], self.most[self.chosen], self.least[self.chosen]
        step = np.arange(self.side)
        before = _bytes(self.text, at[:, None] - 1 - step, step < most[:, None])
        after = _bytes(self.text, at[:, None] + GRAM + step, step < (self.side - least)[:, None])
        key = self.key[self.chosen].astype(">u8").view(np.uint8).reshape(-1, 8)
        table = np.concatenate([key, least[:, None].astype(np.uint8), most[:, None].astype(np.uint8), before, after], axis=1)
        unique, first, place = _distinct(table)
        doc = np.full(len(unique), _LAST)
        np.minimum.at(doc, place, self.doc[self.chosen])
        return unique, doc, place


def _gram_hashes(body: bytes) -> np.ndarray:
    """Hash of the 24 bytes from each position."""
    n = len(body)
    if n < GRAM:
        return np.empty(0, np.uint64)
    eight = np.empty(n - 7, np.uint64)
    for off in range(8):
        part = np.frombuffer(body, "<u8", (n - off) // 8, off)
        eight[off::8] = part[: len(eight[off::8])]
    return _joined(eight[: n - 23], eight[8 : n - 15], eight[16:])


def _joined(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return common.mix(common.mix(a, b, 1), c, 2)


def _leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first smallest value among the next ``width``, by doubling."""
    if len(values) < width:
        return np.empty(0, np.int64)
    value, at, span = values, np.arange(len(values)), 1
    while 2 * span <= width:
        value, at = _smaller(value[:-span], at[:-span], value[span:], at[span:])
        span *= 2
    if span < width:
        off = width - span
        value, at = _smaller(value[:-off], at[:-off], value[off:], at[off:])
    return at


def _smaller(value, at, other, other_at):
    take = other < value
    return np.where(take, other, value), np.where(take, other_at, at)


def _bytes(text: np.ndarray, where: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    found = text[np.clip(where, 0, max(0, len(text) - 1))] if len(text) else np.zeros(where.shape, np.uint8)
    return np.where(wanted, found, np.uint8(0))


def _distinct(table: np.ndarray):
    rows = np.ascontiguousarray(table).view(np.dtype((np.void, table.shape[1]))).ravel()
    _, first, place = np.unique(rows, return_index=True, return_inverse=True)
    return table[first], first, place


def _shared(bodies: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """Which anchors occur in two documents; keys come as six bytes, then whether the chunk holds two documents with each."""
    cuts = exchange.split_counts(counts)
    keys = np.zeros((cuts[-1], 8), np.uint8)
    keys[:, :6] = np.concatenate([np.frombuffer(b, np.uint8, 6 * n).reshape(-1, 6) for b, n in zip(bodies, counts)])
    many = np.concatenate([np.frombuffer(b, bool, n, 6 * n) for b, n in zip(bodies, counts)])
    _, place, seen = np.unique(keys.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    total = seen > 1
    total[place[many]] = True
    back = total[place]
    return [back[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def expand(table: np.ndarray, doc: np.ndarray, side: int) -> np.ndarray:
    """Per row a mask: bit ``b`` is set if the window with ``b`` bytes before the anchor is in a document with a smaller id.

    ``table`` holds key (8 bytes), least and most bytes before the anchor, the bytes before (nearest first) and after.
    """
    unique, first, place = _distinct(table)
    least_doc = np.full(len(unique), _LAST)
    np.minimum.at(least_doc, place, doc)
    every = (1 << (side + 1)) - 1
    mask = np.where(least_doc[place] < doc, np.uint64(every), np.uint64(0))
    key = np.ascontiguousarray(unique[:, :8]).view(">u8").ravel()
    start = np.append(True, key[1:] != key[:-1])
    group = np.cumsum(start) - 1
    rows = np.flatnonzero(np.bincount(group)[group] > 1)  # an anchor with one row has nothing to meet
    if not len(rows):
        return mask
    part, owner = unique[rows], least_doc[rows]
    after = part[:, 10 + side :]
    order = np.lexsort((*after.T[::-1], key[rows]))  # the suffix order: by what follows the anchor
    rows, part, owner, after = rows[order], part[order], owner[order], after[order]
    low, high, before = part[:, 8], part[:, 9], part[:, 10 : 10 + side]
    fresh = np.append(True, key[rows][1:] != key[rows][:-1])
    same = after[1:] == after[:-1]
    common_after = np.append(0, np.where(same.all(axis=1), side, same.argmin(axis=1)))
    string = np.cumsum(fresh) - 1  # the interval of the anchor, split by preceding bytes in each round
    found = np.zeros(len(rows), np.uint64)
    for b in range(side + 1):
        if b:
            _, string = np.unique(string * 256 + before[:, b - 1], return_inverse=True)
        run = np.cumsum(fresh | (common_after < side - b)) - 1
        live = np.flatnonzero((low <= b) & (b <= high))
        if not len(live):
            continue
        _, box = np.unique(run[live] * len(rows) + string[live], return_inverse=True)
        least = np.full(box.max() + 1, _LAST)
        np.minimum.at(least, box, owner[live])
        found[live[least[box] < owner[live]]] |= np.uint64(1 << b)
    whole = np.zeros(len(unique), np.uint64)
    whole[rows] = found
    return mask | whole[place]


def dedupe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, texts: bool = False,
           chunk_bytes: int = common.CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept``, the bytes kept): one row per input row."""
    if not GRAM < length <= GRAM + 60:
        raise ValueError("length must be 25 to 84 bytes")
    side, width = length - GRAM, 10 + 2 * (length - GRAM)
    shards = common.shards_of(docs.sparkSession)
    state = exchange.text_chunks(docs, doc_id, text, chunk_bytes, lambda sizes, body: anchors(sizes, body, length))

    def keys(row, _):
        found, many, _ = Regions(row, length).distinct_keys()
        six = np.ascontiguousarray(found.view(np.uint8).reshape(-1, 8)[:, :6])
        return found << np.uint64(16), lambda a, b: exchange.packed(six[a:b], many[a:b])

    def rows(row, answers):
        table, doc, _ = Regions(row, length).rows(np.frombuffer(answers.get(1, b""), bool))
        key = np.ascontiguousarray(table[:, :8]).view(">u8").ravel().astype(np.uint64)
        return key, lambda a, b: exchange.packed(table[a:b], doc[a:b])

    def judge(bodies, counts):
        cuts = exchange.split_counts(counts)
        table = np.concatenate([np.frombuffer(b, np.uint8, width * n).reshape(-1, width) for b, n in zip(bodies, counts)])
        doc = np.concatenate([np.frombuffer(b, np.int64, n, width * n) for b, n in zip(bodies, counts)])
        mask = expand(table, doc, side)
        return [mask[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def finish(row, answers):
        regions = Regions(row, length)
        _, doc, place = regions.rows(np.frombuffer(answers.get(1, b""), bool))
        mask = np.frombuffer(answers.get(2, b""), np.uint64)
        at, owner = regions.at[regions.chosen], regions.doc[regions.chosen]
        every = np.uint64((1 << (side + 1)) - 1)
        mask = np.where(doc[place] < owner, every, mask[place]) if len(place) else mask
        cover = np.zeros(len(regions.text) + 1, np.int64)
        for b in range(side + 1):
            hit = (regions.least[regions.chosen] <= b) & (b <= regions.most[regions.chosen]) & (mask >> np.uint64(b) & np.uint64(1) == 1)
            np.add.at(cover, at[hit] - b, 1)
            np.add.at(cover, at[hit] - b + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        out, begin = [], 0
        for owner_id, end in zip(regions.ids, regions.ends.tolist()):
            lost = gone[begin:end]
            removed = int(lost.sum())
            kept = regions.text[begin:end][~lost].tobytes() if removed else regions.body[begin:end]
            spans = int(lost[:1].sum() + (lost[1:] & ~lost[:-1]).sum()) if removed else 0
            out.append((owner_id, end - begin, removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
            begin = end
        return list(zip(*out))

    first = exchange.answered(exchange.asked(state, shards, keys), 1, _shared)
    second = exchange.answered(exchange.asked((state, first), shards, rows), 2, judge)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return exchange.finished(state, first.unionByName(second), finish, schema)


def op5_suffixes(spark, sf_dir: str) -> DataFrame:
    return dedupe(common.table(spark, sf_dir, "documents"))


QUERIES = {"op5_suffixes": (op5_suffixes, None)}
