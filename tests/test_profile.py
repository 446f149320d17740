import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.functions import moments as M
from plumbline.operators import duplicates as D, kinds as K, profile as P


def messy(spark):
    rows = [(i, None if i == 3 else 20.0 + i, ["Delhi", "delhi", "DELHI", "Pune", "Goa"][i % 5], i % 2 == 0, f"2024-01-{i + 1:02d}", "x", 999999 if i == 9 else 100 + i)
            for i in range(10)]
    df = spark.createDataFrame(rows, "id int, age double, city string, active boolean, signup string, constant string, salary int")
    return df.withColumn("signup", F.col("signup").cast("timestamp"))


def test_kinds(spark):
    kinds = K.kind_map(messy(spark).withColumn("nothing", F.lit(None).cast("string")).withColumn("bit", (F.col("id") % 2)))
    assert kinds == {"id": "numeric", "age": "numeric", "city": "categorical", "active": "boolean", "signup": "datetime", "constant": "categorical",
                     "salary": "numeric", "nothing": "empty", "bit": "boolean"}


def test_text_kind_needs_long_and_varied_values(spark):
    df = spark.range(200).select(F.concat(F.lit("a rather long sentence with the number "), F.col("id").cast("string"), F.lit(" in it")).alias("t"),
                                 F.concat(F.lit("t"), F.col("id").cast("string")).alias("token"))
    assert K.kind_map(df) == {"t": "text", "token": "categorical"}
    facts = P.column_facts(df)
    assert P.kinds_of(facts) == {"t": "text", "token": "categorical"}
    assert {r["column"]: r["is_high_cardinality"] for r in P.column_profile(facts).collect()} == {"t": True, "token": True}


def test_scan_agrees_with_and_without_value_counts(spark):
    df = messy(spark).drop("signup")
    facts = {r["column"]: r for r in P.column_facts(df).collect()}
    for row in K.scan_columns(df).collect():
        for name in ("count", "missing", "two_valued", "avg_length", "numeric_like", "date_like", "untrimmed"):
            assert facts[row["column"]][name] == row[name], (row["column"], name)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    row = K.scan_columns(df).first()
    assert (row["count"], row["missing"], row["mean"]) == (1, 2, 1.0)


def test_duplicates_count_all_members_and_nulls_are_equal(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "a int, b string")
    assert D.count_duplicates(df) == 4


def test_drop_duplicates_keeps_by_order(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 1), (2, "a", 1), (4, "b", 2)], "k int, x string, y int")
    kept = lambda keep: sorted(r["k"] for r in D.drop_duplicates(df, ["k"], keep=keep).collect())
    assert kept("first") == [1, 4] and kept("last") == [3, 4] and kept(False) == [4]


def test_moments_equal_pandas(spark):
    rng = np.random.default_rng(1)
    for values in (rng.gamma(2, 3, 500), [1.0, 2.0, 4.0, 9.0], [5.0] * 6, [1.0, 2.0]):
        s = pd.Series(values)
        row = spark.createDataFrame(pd.DataFrame({"x": s})).agg(M.sample_skew(F.col("x")).alias("s"), M.sample_kurtosis(F.col("x")).alias("k")).first()
        assert np.isclose(row["s"], s.skew() if len(s) > 2 else 0.0)
        assert np.isclose(row["k"], s.kurtosis() if len(s) > 3 else 0.0)


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"x": rng.normal(0, 1, 1000), "few": rng.integers(0, 4, 1000).astype(float), "one": 3.0})
    pdf.loc[5, "x"] = np.nan
    found = P.histogram(spark.createDataFrame(pdf), ["x", "few", "one"]).toPandas()
    for name, bins in (("x", 20), ("few", 4)):
        counts, edges = np.histogram(pdf[name].dropna(), bins=bins)
        part = found[found.column == name].sort_values("bin")
        assert list(part["count"]) == list(counts)
        assert np.allclose(part["low"], edges[:-1], atol=1e-5)
    assert not (found.column == "one").any()


def test_sample_is_independent_of_layout(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    pick = lambda d: sorted(r["k"] for r in K.sample_rows(d, 100, "k").collect())
    assert pick(df) == pick(df.repartition(13))
    assert len(pick(df)) == 100
    assert K.sample_rows(df, 9000, "k").count() == 5000
    assert K.sample_rows(df, 4999, "k").count() == 4999
    assert K.sample_rows(df.union(df), 7, "k").count() == 7


def test_late_dates_are_seen(spark):
    df = spark.range(2000).select(F.when(F.col("id") < 100, "n/a").otherwise("2024-02-03").alias("d"))
    assert dict(K.coerce_dates(df).dtypes)["d"].startswith("timestamp")


def test_dates_are_recovered_and_numbers_are_not(spark):
    df = spark.range(60).select(F.when(F.col("id") < 50, "2024-02-03").otherwise("3/14/2024").alias("d"), F.col("id").cast("string").alias("n"))
    out = K.coerce_dates(df)
    assert dict(out.dtypes)["d"].startswith("timestamp") and dict(out.dtypes)["n"] == "string"
