import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from plumbline.llm import common, runs


def brute(words, least=6, repeats=4):
    """Every lag and every stretch, with all smaller periods tried."""
    found = []
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            held = words[start : i + q]
            if len(held) >= max(least, repeats * q) and not any(held[d:] == held[:-d] for d in range(1, q)):
                found.append((start, len(held), q))
            i += i == start
    return sorted(found)


def circled(words):
    n = len(words)

    def turned(case):
        a, p = case
        return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]

    return st.tuples(st.integers(0, max(0, n - 1)), st.integers(1, max(1, n // 3))).map(turned)


texts = st.integers(0, 3).flatmap(lambda k: st.lists(st.integers(0, k * k), max_size=50)).flatmap(lambda w: st.one_of(st.just(w), circled(w)))


@settings(max_examples=400, deadline=None)
@given(st.lists(texts, max_size=4), st.sampled_from([(6, 4), (6, 3), (2, 3), (40, 5)]))
def test_runs_equal_brute_force(docs, limits):
    flat = np.array([w for words in docs for w in words], np.int64)
    got = runs.found(flat, np.cumsum([0, *map(len, docs)]), *limits)
    assert got == [(d, *run) for d, words in enumerate(docs) for run in brute(words, *limits)]


def test_one_word_a_million_times_takes_time_in_proportion():
    assert runs.found(np.zeros(1_000_000, np.int64), np.array([0, 1_000_000])) == [(0, 0, 1_000_000, 1)]
    nested = np.tile(np.r_[np.tile([1, 2, 3], 20), np.arange(10, 50)], 2000)
    got = runs.found(nested, np.array([0, len(nested)]))
    assert (0, 0, len(nested), 100) in got and len(got) == 2001


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a b " * 4), (4, "a b " * 4), (None, "x " * 9), (5, "é\x1c  é " * 4), (6, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("start", F.lit("s"))
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find(docs).collect()), key=str)
    assert got == sorted([
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 8, [(0, 8, 2)], "a b"), (4, 8, [(0, 8, 2)], "a b"),
        (None, 9, [(0, 9, 1)], "x"), (5, 8, [(0, 8, 2)], "é\x1c  é"), (6, 3, [], "a b c")], key=str)
    assert runs.find(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.find(docs, repeats=2)


def test_longest_of_equal_lengths_is_the_first(spark):
    docs = spark.createDataFrame([(1, "a a a a a a b c c c c c c"), (2, "x y")], "doc_id long, text string")
    got = {r.doc_id: r.best for r in runs.find(docs).select("doc_id", runs.longest("runs").alias("best")).collect()}
    assert tuple(got[1]) == (0, 6, 1) and got[2] is None


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in runs.op11_runs(spark, folder).collect()}
    docs = common.table(spark, folder, "documents").collect()
    assert len(got) == len(docs)
    for row in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (row.text or "").encode())
        n, h = len(words), zlib.crc32(str(row.doc_id).encode())
        if n > 2500:
            continue
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute(words)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        wanted = (len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                  hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
                  hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())
        assert got[row.doc_id] == wanted
