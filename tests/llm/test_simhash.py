import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import common, simhash


def plain_fingerprint(text, k=4):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    if not words:
        return 0
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(r.encode(), seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, distance=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    reach = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= distance:
                    reach[i] = min(reach[i], reach[j], key=lambda x: rows[x][0])
    return {rows[i][0]: (f"{fps[i]:016x}", rows[reach[i]][0]) for i in range(len(rows))}


def make(n=60):
    import random

    r = random.Random(5)
    base = [" ".join(r.choice(["Al", "be", "ÇA", "di", "eu", "fo"]) + str(r.randrange(40)) for _ in range(80)) for _ in range(12)]
    rows = []
    for i in range(n):
        words = base[i % 12].split()
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = "x"
        rows.append((n - i, "\t".join(words)))
    return rows + [(900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "ONE\ttwo"), (905, "zero " * 5000)]


@pytest.mark.parametrize("block", [4096, 3])
def test_components_match_all_pairs(spark, block):
    rows = make()
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, fp string, id int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, block=block).collect()}
    assert got == brute(rows)


def test_every_four_positions_hold_a_set():
    from itertools import combinations

    sets = simhash.position_sets(4)
    assert len(sets) == 20
    assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), 4))


def test_random_fingerprints_lose_no_link(spark):
    import random

    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(30)]
    fps += [f ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 7))) for f in fps for _ in range(8)]
    fps = list(dict.fromkeys(fps))
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)]
    entries = spark.createDataFrame(rows, "id long, fp long")
    from plumbline.llm import common

    got = {r.id: r.component for r in common.components(simhash.links(entries, 4, 16)).collect()}
    want = {i: i for i in range(len(fps))}
    for _ in fps:
        for i, x in enumerate(fps):
            for j in range(i):
                if (x ^ fps[j]).bit_count() <= 4:
                    want[i] = want[j] = min(want[i], want[j])
    assert {i: got.get(i, i) for i in want} == want


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b"), (3, "a b"), (None, "z"), (3, "a b")], "doc_id long, text string")
    got = sorted(str((r.doc_id, r.component_id, r.kept)) for r in simhash.near_duplicates(docs).collect())
    assert got == ["(3, 3, True)", "(3, 3, True)", "(None, 3, False)", "(None, None, False)"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs.selectExpr("doc_id", "text", "1 AS fp", "2 AS nth"))
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == ["(3, 'a b', 1, 2)", "(None, 'z', 1, 2)"]


def test_no_side_of_a_join_comes_to_the_driver(spark):
    """Broadcasts are collected by the driver: over 0.5 GB of documents its memory was too small for those of ``groups``."""
    docs = spark.createDataFrame(make(), "doc_id long, text string")
    marked = common.stored(simhash.fingerprints(docs))
    pairs = simhash.links(marked.select(F.col("fp").alias("id"), "fp").distinct())
    plans = [simhash.near_duplicates(docs), simhash.keep_one(docs), simhash.groups(marked), pairs, common.components(pairs)]
    for made in plans:
        made.collect()
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
