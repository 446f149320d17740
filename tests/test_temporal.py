import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import temporal

NESTED = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frames(spark, seed):
    random.seed(seed)
    left = [(n, random.choice(["hot", "hot", "b", None]), random.choice([None, *range(60)])) for n in range(250)]
    right = [(n, random.choice(["hot", "hot", "b", "c", None]), random.choice([None, *range(60)])) for n in range(90)]
    return left, right, spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "id int, k string, t int")


@pytest.mark.parametrize("bucket_rows", [7, 10**6])
@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact", [True, False])
def test_asof_equals_brute_force(spark, bucket_rows, direction, exact):
    left, right, l, r = frames(spark, 1)
    out = temporal.asof_join(l, r, "t", "t", ["k"], direction, exact, tolerance=9, tie="id", bucket_rows=bucket_rows)
    assert out.columns == ["id", "k", "t", "id_right", "t_right"] and not any(n in plan_of(out) for n in NESTED)
    got = {x["id"]: x["id_right"] for x in out.collect()}
    sign = 1 if direction == "backward" else -1
    for n, k, t in left:
        near = [(sign * u, m) for m, j, u in right if None not in (k, t, j, u) and j == k and (sign * u < sign * t or exact and u == t)]
        best = max(near, default=None)
        assert got[n] == (best[1] if best and sign * t - best[0] <= 9 else None)
    assert len(got) == len(left)


def test_asof_without_keys_on_times_keeps_names_apart(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    l = spark.createDataFrame([(day(2), "x"), (day(5), "y")], "at timestamp, name string")
    r = spark.createDataFrame([(day(1), "one", 1), (day(4), "four", 2)], "at timestamp, name string, id int")
    got = temporal.asof_join(l, r, "at", "at", tolerance=86_400).orderBy("at").collect()
    assert [(x["name"], x["name_right"]) for x in got] == [("x", "one"), ("y", "four")]
    assert temporal.asof_join(l, r.limit(0), "at", "at").where("id IS NULL").count() == 2
    assert temporal.asof_join(l.limit(0), r, "at", "at").count() == 0
    with pytest.raises(TypeError):
        temporal.asof_join(l, r, "name", "at")
    with pytest.raises(ValueError):
        temporal.asof_join(l, r, "at", "at", direction="sideways")


def test_a_hot_key_is_cut_into_buckets(spark):
    hot = spark.range(20_000).selectExpr("id", "'one' AS k", "CAST(id AS DOUBLE) AS t")
    out = temporal.asof_join(hot, hot.where("id % 100 = 0"), "t", "t", ["k"], bucket_rows=1000)
    assert out.where("id_right <> id - id % 100").count() == 0 and out.count() == 20_000
    assert temporal._bucket_width(hot.selectExpr("k", "t AS _at"), ["k"], 1000) == pytest.approx(1000, rel=0.01)


def spans(seed, n):
    random.seed(seed)
    out = []
    for i in range(n):
        low = random.choice([None, *range(100)])
        length = random.choice([0, 0, 1, 2, 3, 5, 40, 1000, -3])
        out.append((i, random.choice(["a", "b", None]), low, None if low is None else low + length))
    return out


@pytest.mark.parametrize("half_open", [False, True])
@pytest.mark.parametrize("by", [[], ["k"]])
def test_range_and_overlap_equal_brute_force(spark, half_open, by):
    points, a, b = [(n, k, t) for n, k, t, _ in spans(2, 120)], spans(3, 120), spans(4, 90)
    schema = "id int, k string, low int, high int"
    fa, fb = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    same = lambda j, k: not by or (j is not None and j == k)
    held = lambda t, lo, hi: None not in (t, lo) and lo <= hi and (lo <= t < hi if half_open else lo <= t <= hi)
    found = temporal.range_join(spark.createDataFrame(points, "id int, k string, t int"), fa, "t", "low", "high", by, half_open)
    assert not any(n in plan_of(found) for n in NESTED)
    got = sorted((r["id"], r["id_right"]) for r in found.collect())
    assert got == sorted((n, m) for n, j, t in points for m, k, lo, hi in a if same(j, k) and held(t, lo, hi))

    def meet(x, y):
        (_, j, lo, hi), (_, k, low, high) = x, y
        if None in (lo, low) or lo > hi or low > high or not same(j, k):
            return False
        return (lo < high and low < hi) if half_open else (lo <= high and low <= hi)

    found = temporal.overlap_join(fa, fb, ("low", "high"), ("low", "high"), by, half_open)
    assert not any(n in plan_of(found) for n in NESTED)
    got = sorted((r["id"], r["id_right"]) for r in found.collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if meet(x, y))


def test_empty_sides(spark):
    none = spark.createDataFrame([], "id int, low double, high double")
    some = spark.createDataFrame([(1, 0.0, 0.0)], "id int, low double, high double")
    assert temporal.overlap_join(none, some, ("low", "high"), ("low", "high")).count() == 0
    assert temporal.overlap_join(some, some, ("low", "high"), ("low", "high")).count() == 1
    assert temporal.range_join(some, none, "low", "low", "high").count() == 0


def test_an_interval_is_dealt_to_two_bins_at_most(spark):
    rows = spark.range(2000).selectExpr("CAST(id AS DOUBLE) AS low", "CAST(id + POW(1.01, id) AS DOUBLE) AS high")
    held = temporal._span(rows, "low", "high", [])
    base = temporal._base(held)
    dealt = temporal._dealt(held.withColumn("_level", temporal._level(F.col("_len"), base)), F.array("_level"), base)
    assert dealt.count() <= 4000 and bisect.bisect(temporal._levels(held.withColumn("_level", temporal._level(F.col("_len"), base))), 40) <= 40


@pytest.mark.parametrize("half_open", [False, True])
@pytest.mark.parametrize("by", [(), ["k"]])
def test_totals_of_a_range_join_are_those_of_its_pairs_without_making_them(spark, half_open, by):
    random.seed(4)
    points = [(n, random.choice(["hot", "hot", "b", None]), random.choice([None, 7, *range(60)])) for n in range(300)]
    spans = [(random.choice([None, n]), random.choice(["hot", "b", "c"]), low, low + random.choice([-1, 0, 0, 1, 5, 40])) for n in range(200) for low in [random.randrange(60)]]
    p = spark.createDataFrame(points, "id int, k string, t int")
    i = spark.createDataFrame(spans, "v int, kk string, low int, high int")
    keys = [("k", "kk")] if by else ()
    pairs = temporal.range_join(p, i, "t", "low", "high", keys, half_open).groupBy("id", "k", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    found = temporal.range_join(p, i, "t", "low", "high", keys, half_open, totals={"n": None, "s": "v"})
    assert found.columns == pairs.columns and found.dtypes[3:] == pairs.dtypes[3:]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, pairs.collect()), key=str)
    # A hundred thousand points in as many intervals: ten billion pairs are not made.
    many = spark.range(100_000).selectExpr("id", "id AS low", "id + 1000000 AS high")
    all_in = temporal.range_join(many.selectExpr("id", "id + 100000 AS t"), many.drop("id"), "t", "low", "high", totals={"n": None, "s": "low"})
    assert all_in.where("n = 100000 AND s = 4999950000").count() == 100_000
    with pytest.raises(TypeError):
        temporal.range_join(p, i, "t", "low", "high", totals={"s": "kk"})
