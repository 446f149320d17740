from pyspark.sql import functions as F

from plumbline.operators import sketches as S


def table(spark, rows, seed=1):
    return spark.range(rows).select(
        F.col("id"), (F.randn(seed) * 10).alias("x y"), F.concat(F.lit("v"), F.floor(F.pow(F.rand(seed + 1), 4) * 3000)).alias("label"),
        F.when(F.rand(seed + 2) < 0.3, F.lit(7)).alias("few"), F.lit(None).cast("int").alias("none"), (F.col("id") % 6).alias("part"))


COLUMNS = ["id", "x y", "label", "few", "none"]


def check(spark, df, profile):
    total = df.count()
    for r in profile.collect():
        values = df.where(F.col(f"`{r['column']}`").isNotNull()).select(F.col(f"`{r['column']}`").alias("v"))
        assert r["rows"] == total and r["count"] == values.count()
        exact = values.distinct().count()
        assert abs(r["distinct"] - exact) <= S.DISTINCT_ERROR * exact + 1
        counts = {str(x["v"]): x["count"] for x in values.groupBy("v").count().collect()}
        for item in r["top"]:
            assert 0 <= counts[item["item"]] - item["count"] <= r["count"] / (0.75 * S.TRACKED)
        if r["quantiles"]:
            ranks = values.agg(*[f(F.col("v"), F.lit(q)) for q in r["quantiles"] for f in (lambda v, q: F.count_if(v < q), lambda v, q: F.count_if(v <= q))]).first()
            for p, below, upto in zip(S.PROBABILITIES, ranks[::2], ranks[1::2]):
                assert below / r["count"] - S.RANK_ERROR <= p <= upto / r["count"] + S.RANK_ERROR


def test_merged_parts_stay_within_bounds_and_parts_are_replaced(spark, tmp_path):
    df, store = table(spark, 20_000), S.SketchStore(str(tmp_path / "s"), COLUMNS)
    store.put(df.where("part < 4"), F.col("part"))
    store.put(df.where("part >= 4"), F.col("part"))
    store.put(df.where("part = 2"), F.col("part"))  # once more: nothing counts twice
    assert store.parts(spark).count() == 6
    check(spark, df, store.profile(spark))
    changed = df.where("part <> 3").unionByName(table(spark, 500, 9).withColumn("part", F.lit(3)))
    store.put(changed.where("part = 3"), F.col("part"))
    check(spark, changed, store.profile(spark))
    check(spark, changed.where("part in (3, 5)"), store.profile(spark, parts=F.col("kept").isin("3", "5")))
    none = {r["column"]: r for r in store.profile(spark).collect()}["none"]
    assert (none["count"], none["distinct"], none["low"], none["quantiles"], none["top"]) == (0, 0, None, None, [])


def test_exact_figures_beside_sketches_come_from_value_counts(spark):
    """Seven distinct counts in one aggregate made eight copies of every row."""
    import __spark_entry__ as entry

    out = entry.queries()["G13_from_sketches"](spark, "/root/testdata/sf0.01")
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert len(rows) == 7 and all(r.distinct_within and r.quantiles_within and r.top_within for r in rows)
