import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import packing

tokenizers = pytest.importorskip("tokenizers")


def texts():
    r = random.Random(2)
    words = ["The", "l'été", "naïve,", "<|endoftext|>x", "don't", "12a", "İx", "ﬁn", "ét", "a b", "Straße.", "##", "x" * 3000]
    return [" ".join(r.choices(words[:-1], k=r.randrange(1, 900))) for _ in range(60)] + [None, "", " \n", words[-1], "long " * 9000]


def check(rows, tokenizer, body):
    ids = defaultdict(list)
    for i, t in body:
        found = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        ids[i].append(np.array(found, "<u4"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, found in ids.items():
        want = Counter()
        for whole in found:
            for s in range(0, len(whole), 2048):
                p = whole[s : s + 2048]
                want[(s, len(p), zlib.crc32(p.tobytes()), len(whole))] += 1
        assert Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_doc[i]) == want
    assert set(by_doc) == set(ids)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return by_sequence


def test_every_id_once_and_little_padding(spark):
    body = list(enumerate(texts())) + [(3, texts()[3]), (None, "a b"), (None, "a b")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in body], "doc_id long, text string, start int, rank int")
    rows = packing.pack(docs).collect()
    held = check(rows, tokenizers.Tokenizer.from_file(packing.default_tokenizer()), body)
    total = sum(r.length for r in rows)
    assert len(held) <= total / 2048 * 1.05 + 1
    again = packing.pack(docs, ids=True).collect()
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in again)
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_cutting_stock_places_all(seed):
    r = np.random.default_rng(seed)
    width, demand = 32, np.zeros(33, np.int64)
    for k in r.integers(1, 33, 400):
        demand[k] += r.integers(1, 50)
    patterns, times, value = packing.cutting_stock(demand, width)
    assert ((patterns * times[:, None]).sum(axis=0) == demand).all()
    assert (patterns @ np.arange(33) <= width).all()
    used = np.flatnonzero(demand)
    assert value >= max(demand @ np.arange(33) / width, demand[17:].sum()) - 1e-6
    assert value <= times.sum() <= value + len(used)
    ranks = packing.slots(patterns, times)
    assert {k: int(demand[k]) for k in ranks} == {k: int(demand[k]) for k in np.flatnonzero(demand)}


def test_knapsack_matches_brute_force():
    from itertools import product

    prices = np.array([0, 0.1, 0.25, 0.31, 0.5, 0.7])
    best = max(sum(c * prices[k] for k, c in enumerate(n, 1)) for n in product(range(6), repeat=5) if sum(k * c for k, c in enumerate(n, 1)) <= 5)
    found = packing.best_pattern(prices, 5)
    assert found @ np.arange(6) <= 5 and abs(found @ prices - best) < 1e-12


def test_padded_length(spark):
    got = spark.range(1, 6).select(packing.padded_length(F.col("id")).alias("n")).collect()
    assert [r.n for r in got] == [1, 2, 2048, 4, 2048]
