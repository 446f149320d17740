import math
import pathlib
import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, ranking

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
import oracle  # noqa: E402

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    held = [(key, words) for key, words in ((k, words_of(t)) for k, t in docs) if words]
    total, every = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, words in held:
        for t in set(words):
            df[t] = df.get(t, 0) + 1
    found = []
    for item, text in items:
        scores = []
        for key, words in held:
            m = 100 - 25 + (25 * len(words) * total) // every
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * words.count(t)) // (1000 * words.count(t) + 12 * m))
                        for t in words_of(text) if t in words)
            if score > 0:
                scores.append((-score, key is None, key or 0))
        found += [(item, n + 1, None if none else key, -score) for n, (score, none, key) in enumerate(sorted(scores)[:20])]
    return sorted(found, key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_BYTES", 30_000)
    monkeypatch.setattr(ranking, "BUNDLE_ITEMS", 7)


def test_equals_brute_force_over_blocks_and_bundles(spark, small_blocks):
    random.seed(4)
    vocabulary = ["é" * n + chr(97 + n) for n in range(26)] + [f"W{n}" for n in range(60)]
    weights = [1 / (n + 1) for n in range(len(vocabulary))]
    text = lambda least: random.choice([" ", "-", "\n\x0b"]).join(random.choices(vocabulary, weights, k=random.randint(least, 60)))
    docs = [(n % 290, text(0)) for n in range(300)] + [(1000 + n, "copy of one text") for n in range(45)]
    items = [(n, text(1)) for n in range(15)] + [(15, "copy one"), (16, "a a a W1 w1"), (17, "unseen")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = ranking.search(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == brute(docs, items)


def test_an_owner_drops_only_what_cannot_reach_the_ranking():
    lengths, n_items = np.full(50, 10, np.int64), 1
    asked = {t: (np.array([0]), np.array([1])) for t in (0, 1)}
    later = ranking.Owner([1], {1: 10}, asked, np.array([0]), 50, 500)
    first = ranking.Owner([0], {0: 1000}, asked, np.array([10 * ranking.gain(1, 75)]), 50, 500)
    both = np.arange(30), np.ones(30, np.int32)
    item, place, sums, takes = ranking.passed(None, first, (lengths, np.zeros(30, np.int32), both[0].astype(np.int32), both[1]), n_items)
    assert place.tolist() == list(range(30)) and not takes[0]  # ties with the twentieth stay, unseen documents do not come in
    first.rest = np.array([1000 * ranking.gain(1, 100)])
    assert ranking.passed(None, first, (lengths, np.zeros(30, np.int32), both[0].astype(np.int32), both[1]), n_items)[3][0]
    assert later.rest[0] == 0


def test_cases(spark):
    docs = [(1, "Alpha beta"), (2, None), (3, ""), (4, "--"), (None, "alpha"), (5, "alpha"), (5, "alpha"), (6, "Ä alpha" + " filler" * 300_000), (7, "gamma")]
    items = [(1, "ALPHA!"), (1, "alpha"), (2, None), (3, ""), (None, "beta"), (4, "nothing here")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("score", F.lit("x"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = ranking.search(frame, asked).collect()
    assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == brute(docs, items)
    assert ranking.search(frame.limit(0), asked).count() == 0 and ranking.search(frame, asked.limit(0)).count() == 0
    assert ranking.search(frame, asked.where("item_id = 3")).count() == 0


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    query, sql = ranking.QUERIES["op13_search"]
    assert oracle.compare(spark, oracle.connect(folder), query, sql, folder) is None
    docs = [tuple(r) for r in common.table(spark, folder, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in common.table(spark, folder, "benchmark").select("item_id", "text").limit(3).collect()]
    wanted = {r for r in brute(docs, items)}
    got = {(r.item_id, r["rank"], r.doc_id, r.score) for r in query(spark, folder).collect()}
    assert wanted <= got
