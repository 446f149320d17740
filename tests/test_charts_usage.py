from pyspark.sql import functions as F

from plumbline.functions.order import number_rows
from plumbline.operators import charts as H, usage as U


def rows(spark, data):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "k int, month string, region string, revenue string")


def test_pivot_keeps_gaps_and_the_last_duplicate(spark):
    df = rows(spark, [("Jan", "N", "1"), ("Jan", "S", "0"), ("Feb", "N", "-5"), ("Feb", "N", "7"), ("Mar", None, "bad")])
    got = {r["month"]: r.asDict() for r in H.pivot_grouped(df, "month", "region", "revenue", "k").collect()}
    assert got["Jan"]["N"] == 1.0 and got["Jan"]["S"] == 0.0 and got["Feb"]["N"] == 7.0 and got["Feb"]["S"] is None and got["Mar"]["Unknown"] is None
    assert H.series_names(df, "region", "k") == ["N", "S", "Unknown"]


def test_compact_bars_are_centred(spark):
    wide = spark.createDataFrame([("a", 1.0, None, 3.0), ("b", None, 2.0, None)], "x string, p double, q double, r double")
    got = sorted((r["label"], r["series"], round(r["position"], 6)) for r in H.compact_bars(wide, "x", ["p", "q", "r"]).collect())
    assert got == [("a", "p", -0.2), ("a", "r", 0.2), ("b", "q", 1.0)]


def test_time_sort_only_when_all_parse(spark):
    good = rows(spark, [("2024-03-01", "a", "1"), ("2024-01-01", "b", "2")])
    bad = rows(spark, [("2024-03-01", "a", "1"), ("soon", "b", "2")])
    assert [r["month"] for r in H.sort_by_time(good, "month", "k").collect()] == ["2024-01-01", "2024-03-01"]
    assert [r["month"] for r in H.sort_by_time(bad, "month", "k").collect()] == ["2024-03-01", "soon"]


def test_row_numbers_over_many_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(11)
    got = sorted((r["v"], r["position"]) for r in number_rows(df, [F.col("v").asc()]).collect())
    assert got == [(i, i) for i in range(1000)]


def test_latency_nearest_rank_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (10, 20, 30, 40, 50, 60)], "source string, latency double")
    got = {r["p"]: r["value"] for r in U.latency_percentiles(df, ["source"]).collect()}
    assert got == {0.5: 30.0, 0.95: 60.0}


def test_token_budget_always_keeps_the_newest(spark):
    df = spark.createDataFrame([(1, i, "q" * 10, "a" * (40_000 if i == 3 else 400)) for i in range(4)], "conv int, turn int, question string, answer string")
    assert [r["turn"] for r in U.within_token_budget(df, ["conv"], "turn").collect()] == [3]
    assert len(U.within_token_budget(df.filter("turn < 3"), ["conv"], "turn").collect()) == 3


def test_key_page_walks_through_everything(spark):
    df = spark.range(7).select("id", F.timestamp_seconds(F.col("id") * 60).alias("ran_at"))
    page, cursor = U.page(df, "ran_at", size=3)
    first = [r["id"] for r in page.collect()]
    before = spark.range(1).select(cursor.alias("c")).first()["c"]
    page, cursor = U.page(df, "ran_at", before=F.lit(before), size=4)
    assert first == [6, 5, 4] and [r["id"] for r in page.collect()] == [3, 2, 1, 0]
    assert spark.range(1).select(cursor.alias("c")).first()["c"] is None
