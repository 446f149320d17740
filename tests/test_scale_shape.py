"""A third of all rows under one key: results stay whole, and plans stay free of products."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
import __spark_entry__ as entry
from plumbline.functions import counts as C, ranks as R
from plumbline.operators import clean, duplicates as D, metrics as M, quality as Q, usage as U

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
# One or two queries per family; ORACLE_ALL=1 runs every query that has SQL.
PICKED = ["A1_column_kinds", "P2_column_profile", "P9_histogram", "Q9_outlier_counts", "C2_standardize_categories", "C5_drop_duplicates_first", "D1_duplicate_rows",
          "E3_correlations", "E6_box_stats", "H2_pivot_grouped", "H3_compact_bars", "K2_metric_by_period", "K6_relationship_probe", "K10_match_definitions",
          "G9_ground", "G24_column_policy", "G29_noise", "U8_latency_percentiles", "U22_token_budget", "W2_product_performance", "W7_lifetime_value",
          "M5_split", "M14_class_metrics", "M16_stratified_folds", "S8_write_csv", "T3_rate_limit", "L6_grouping_sets"]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("ORACLE_ALL") else PICKED)
def test_same_as_sql(spark, con, name):
    assert oracle.compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) is None


@pytest.fixture(scope="module")
def skewed(spark):
    """30 000 rows; key 0 holds a third of them, all with the same label."""
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 997).alias("key"), (F.col("id") * 7919 % 10_007).cast("double").alias("v"))
    return df.withColumn("label", F.when(F.col("key") == 0, F.lit("Hot")).otherwise(F.concat(F.lit("l"), (F.col("key") % 50).cast("string")))).repartition(7)


def test_quantiles_of_a_hot_group_are_exact_when_narrowed(spark, skewed):
    pdf = skewed.toPandas()
    rows = R.grouped_quantiles(skewed, ["key"], F.col("v"), [0.05, 0.5, 0.999], group_rows=300).collect()
    want = pdf.groupby("key")["v"].quantile([0.05, 0.5, 0.999])
    assert len(rows) == 3 * pdf.key.nunique()
    assert all(np.isclose(r["value"], want[(r["key"], r["p"])]) for r in rows)


def test_outliers_agree_on_both_paths(spark, skewed, monkeypatch):
    one = [tuple(r) for r in Q.outlier_counts(skewed, ["v", "key"]).orderBy("column").collect()]
    monkeypatch.setenv("PLUMBLINE_GROUP_ROWS", "500")
    assert [tuple(r) for r in Q.outlier_counts(skewed, ["v", "key"]).orderBy("column").collect()] == one


def test_probe_counts_all_pairs_of_a_hot_key(spark, skewed):
    row = M.relationship_probe(skewed, "key", skewed, "key").first()
    sizes = skewed.toPandas().groupby("key").size()
    assert row["matched_count"] == int((sizes ** 2).sum()) and row["left_count"] == 30_000


def test_cleaning_keeps_every_row(spark, skewed):
    mixed = skewed.withColumn("label", F.when(F.col("id") % 2 == 0, F.upper("label")).otherwise(F.col("label")))
    out, record = clean.standardize_categories(mixed, "label", "id")
    assert out.count() == 30_000 and record["cells_changed"] > 0
    assert D.drop_duplicates(skewed.select("id", "label"), ["id"]).count() == skewed.select("label").distinct().count()


def test_lookup_join_gives_the_same_rows_without_broadcast(spark, skewed, monkeypatch):
    from plumbline import session

    lookup = skewed.groupBy("key").agg(F.count("*").alias("n"))
    small = session.lookup_join(skewed, lookup, "key").agg(F.sum("n")).first()[0]
    large = session.lookup_join(skewed, lookup, "key", rows=0).agg(F.sum("n")).first()[0]
    assert small == large


def test_top_values_are_limited_before_the_shuffle(skewed):
    plan = C.top_values(C.value_counts(skewed, ["label", "key"]), 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_parquet_scans_read_only_what_is_needed(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_shipdate > '1998-01-01'")
    plan = R.column_quantiles(df, ["l_tax"], [0.5], approximate=True)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThan(l_shipdate" in plan and "l_extendedprice" not in plan


def test_result_does_not_depend_on_partitions(spark, skewed):
    runs = lambda d: sorted(map(tuple, U.latency_percentiles(d.select(F.col("key").alias("source"), F.col("v").alias("latency")), ["source"]).collect()))
    assert runs(skewed) == runs(skewed.coalesce(1)) == runs(skewed.repartition(23, "v"))


def test_pairs_of_a_nation_are_made_in_more_than_one_task(spark, con):
    name = "L2_joins"
    query = entry.queries()[name](spark, SF)
    made = query._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [n_nationkey" in made
    nations = spark.read.parquet(f"{SF}/nation.parquet").select(F.col("n_name").alias("name"))
    parts = query.sparkSession.table("nation").select(F.spark_partition_id().alias("part")).distinct().count()
    assert parts > nations.count() / 4
    assert oracle.compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF) is None
