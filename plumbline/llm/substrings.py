"""Removal of repeated runs of words by recompression.

Rounds of recompression rewrite the word sequence: first every maximal run of equal symbols becomes one symbol, then
neighbours merge in pairs, where the name of the left one falls in one class and that of the right one in the other. Names are
hashes of what they stand for, so all documents name globally alike without a dictionary. Equal stretches
of words therefore get equal symbols, but for a few at either end, which depend on what lies outside.

A window of ``window`` words knows, per round, the symbols inside it that nothing outside can change: each round loses the
outermost run and at most one more symbol at either end. Its anchor is the longest symbol (then the one with the
smallest name) of the highest round in which such a symbol is left; the words themselves are round zero, so every window has
an anchor, and equal windows have equal anchors. Round one of the exchange asks which anchors occur twice anywhere; only
windows around shared symbols ask, in round two, whether the whole window (96 bits) occurs twice. All else stays.

Cases: a null or empty text has no words; its hash is that of the empty text. A document shorter than ``window`` loses
nothing. Repeated rows repeat each other's words and lose them all, like repeats inside a text. Null ids are kept as null.
An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from plumbline.llm import common, exchange

WINDOW = 35
_ROUNDS = 12


def _salted(names: np.ndarray, level: int) -> np.ndarray:
    return common.mix(names, names >> np.uint64(7), 1000 + level)


def anchors(words: np.ndarray, window: int = WINDOW):
    """Per window start: the level of its anchor and the anchor's number in that level. Also the names per level."""
    count = len(words) - window + 1
    if count <= 0:
        return np.zeros(0, np.int8), np.zeros(0, np.int64), []
    starts, names = np.arange(len(words)), words
    low, high = np.arange(count), np.arange(count) + window
    best_level, best = np.zeros(count, np.int8), np.zeros(count, np.int64)
    live, levels = np.arange(count), []
    for level in range(_ROUNDS):
        levels.append(names)
        # runs: the outermost ones may go on outside
        new = np.append(True, names[1:] != names[:-1])
        run = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        length = np.diff(np.append(begin, len(names)))
        merged = np.where(length > 1, common.mix(names[begin], length.astype(np.uint64), 2000 + level), names[begin])
        inner, outer = run[low] + 1, run[high - 1]
        # pairs: a right name may belong to what is left of it, a left name to what is right of it
        right = (_salted(merged, level) >> np.uint64(40)) & np.uint64(1) == 1
        some = np.flatnonzero(inner < outer)
        inner, outer = inner[some], outer[some]
        inner, outer = inner + right[inner], outer - ~right[outer - 1]
        left = inner < outer
        some, inner, outer = some[left], inner[left], outer[left]
        # windows that end here take their anchor from this level; the others go on
        ends = np.ones(len(live), bool)
        ends[some] = level == _ROUNDS - 1
        best_level[live[ends]], best[live[ends]] = level, _longest(starts, names, low[ends], high[ends], len(words))
        live = live[~ends]
        if not len(live):
            break
        head = np.append(True, ~(right[1:] & ~right[:-1]))
        place = np.cumsum(head) - 1
        first = np.flatnonzero(head)
        pair = np.diff(np.append(first, len(merged))) == 2
        names = merged[first]
        names[pair] = common.mix(merged[first[pair]], merged[first[pair] + 1], 3000 + level)
        low, high = place[inner], place[outer - 1] + 1
        starts = starts[begin][first]
    return best_level, best, levels


def _longest(starts, names, low, high, total) -> np.ndarray:
    """The longest symbol in each range, then the smallest name, then the first."""
    span = np.minimum(np.diff(np.append(starts, total)), 255).astype(np.uint64)
    rank = ((np.uint64(255) - span) << np.uint64(56)) | (names >> np.uint64(8))
    best, value = low.copy(), rank[low]
    at = low + 1
    left = np.flatnonzero(at < high)
    while len(left):
        better = rank[at[left]] < value[left]
        hit = left[better]
        best[hit], value[hit] = at[hit], rank[at[hit]]
        at[left] += 1
        left = left[at[left] < high[left]]
    return best


def _parsed(row: dict, window: int):
    """Words of a chunk, their hashes, document starts, and which window starts lie inside one document."""
    ids, sizes, body = exchange.opened(row)
    ends = np.cumsum(sizes)
    docs = [common.WORDS.findall(body[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist())]
    counts = np.fromiter(map(len, docs), np.int64, len(docs))
    hashes = [np.fromiter(map(common.xxhash.xxh64_intdigest, d), np.uint64, len(d)) for d in docs]
    words = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    inside = np.zeros(max(0, len(words) - window + 1), bool)
    begin = np.cumsum(counts) - counts
    for b, n in zip(begin.tolist(), counts.tolist()):
        inside[b : max(b, b + n - window + 1)] = True
    return ids, docs, counts, words, inside


def _keys(words, inside, window):
    """Distinct anchor names with whether the chunk holds them twice; and per window (inside documents) its anchor."""
    level, number, levels = anchors(words, window)
    level, number = level[inside], number[inside]
    names, base, at = [], np.zeros(len(levels) + 1, np.int64), np.zeros(len(level), np.int64)
    for k, all_names in enumerate(levels):
        own = level == k
        used, place = np.unique(number[own], return_inverse=True)
        names.append(all_names[used])
        at[own] = base[k] + place
        base[k + 1] = base[k] + len(used)
    names = np.concatenate(names) if names else np.empty(0, np.uint64)
    names = common.mix(names, names, 4000)  # small names are chosen more often; the shards are ranges
    keys, place, many = np.unique(names, return_inverse=True, return_counts=True)
    return keys, many > 1, place[at] if len(at) else at


def _windows(words, where, window):
    """Two hashes, of 64 and 32 bits, of the windows at ``where``."""
    one = common.grams(words, window, 1)[where]
    two = (common.grams(words, window, 2)[where] >> np.uint64(32)).astype(np.uint32)
    return one, two


def _candidates(row, answers, window):
    """Words and, for the windows whose anchor is shared, their starts and distinct hashes."""
    ids, docs, counts, words, inside = _parsed(row, window)
    keys, _, place = _keys(words, inside, window)
    shared = np.frombuffer(answers.get(1, b""), bool)
    where = np.flatnonzero(inside)[shared[place]] if len(keys) else np.empty(0, np.int64)
    one, two = _windows(words, where, window) if len(where) else (np.empty(0, np.uint64), np.empty(0, np.uint32))
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    new = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)]
    first = np.flatnonzero(new)
    place = np.empty(len(one), np.int64)
    place[order] = np.cumsum(new) - 1
    many = np.diff(np.append(first, len(one))) > 1
    return ids, docs, counts, words, where, one[first], two[first], many, place


def _twice(bodies: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """Which keys occur twice over all chunks; a body holds keys, then whether the chunk alone holds each twice."""
    cuts = exchange.split_counts(counts)
    keys = np.concatenate([np.frombuffer(b, np.uint64, n) for b, n in zip(bodies, counts)])
    many = np.concatenate([np.frombuffer(b, bool, n, 8 * n) for b, n in zip(bodies, counts)])
    unique, place, seen = np.unique(keys, return_inverse=True, return_counts=True)
    total = seen > 1
    total[place[many]] = True
    back = total[place]
    return [back[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _twice_wide(bodies: list[bytes], counts: list[int]) -> list[np.ndarray]:
    cuts = exchange.split_counts(counts)
    one = np.concatenate([np.frombuffer(b, np.uint64, n) for b, n in zip(bodies, counts)])
    two = np.concatenate([np.frombuffer(b, np.uint32, n, 8 * n) for b, n in zip(bodies, counts)])
    many = np.concatenate([np.frombuffer(b, bool, n, 12 * n) for b, n in zip(bodies, counts)])
    order = np.lexsort((two, one))
    new = np.append(True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0))
    group = np.empty(len(one), np.int64)
    group[order] = np.cumsum(new) - 1
    total = np.bincount(group) > 1
    total[group[many]] = True
    back = total[group]
    return [back[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def dedupe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, texts: bool = False,
           chunk_bytes: int = common.CHUNK_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``text`` with the words kept): one row per input row."""
    shards = common.shards_of(docs.sparkSession)
    state = exchange.text_chunks(docs, doc_id, text, chunk_bytes)

    def symbols(row, _):
        *_, words, inside = _parsed(row, window)
        keys, many, _ = _keys(words, inside, window)
        return keys, lambda a, b: exchange.packed(keys[a:b], many[a:b])

    def whole(row, answers):
        *_, one, two, many, _ = _candidates(row, answers, window)
        return one, lambda a, b: exchange.packed(one[a:b], two[a:b], many[a:b])

    def finish(row, answers):
        ids, docs, counts, words, where, *_, place = _candidates(row, answers, window)
        twice = np.frombuffer(answers.get(2, b""), bool)
        hit = where[twice[place]] if len(where) else where
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, np.minimum(hit + window, len(words)), -1)
        gone, at, rows = np.cumsum(cover[:-1]) > 0, 0, []
        for owner, held, n in zip(ids, docs, counts.tolist()):
            out = gone[at : at + n]
            lost, at = int(out.sum()), at + n
            kept = b" ".join(held if not lost else [held[i] for i in np.flatnonzero(~out)])
            rows.append((owner, n, lost, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if texts else [])))
        return list(zip(*rows))

    first = exchange.answered(exchange.asked(state, shards, symbols), 1, _twice)
    second = exchange.answered(exchange.asked((state, first), shards, whole), 2, _twice_wide)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * texts
    return exchange.finished(state, first.unionByName(second), finish, schema)


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    return dedupe(common.table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH w AS (
  SELECT row_number() OVER () AS nth, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), win AS (
  SELECT nth, unnest(range(1, len(words) - {WINDOW - 2})) AS start, words FROM w WHERE len(words) >= {WINDOW}
), hashed AS (
  SELECT nth, start, md5(array_to_string(words[start:start + {WINDOW - 1}], ' ')) AS h FROM win
), twice AS (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT nth, unnest(range(start, start + {WINDOW})) AS pos FROM hashed JOIN twice USING (h)),
lost AS (SELECT nth, count(*) AS n, list(pos) AS positions FROM gone GROUP BY nth),
each AS (SELECT nth, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
kept AS (SELECT nth, string_agg(word, ' ' ORDER BY pos) AS text FROM each ANTI JOIN gone USING (nth, pos) GROUP BY nth)
SELECT doc_id, len(words) AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN lost USING (nth) LEFT JOIN kept USING (nth)"""

QUERIES = {"op3_substrings": (op3_substrings, OP3_SQL)}
