import pytest
from pyspark.sql import functions as F

from plumbline.operators.refresh import Rollup

MEASURES = {"n": ("count", "value"), "total": ("sum", "value"), "low": ("min", "value"), "high": ("max", "value"), "mean": ("avg", "value"),
            "spread": ("stddev", "value")}


def events(spark, start, stop):
    return spark.range(start, stop).selectExpr(
        "timestamp_seconds(1704067200 + id * 5000) AS ts", "CONCAT('k', id % 3) AS kind", "IF(id % 7 = 0, NULL, CAST(id AS DOUBLE)) AS value")


def put(df, folder):
    df.coalesce(1).write.mode("overwrite").parquet(folder)


def full(spark, source):
    rows = spark.read.option("recursiveFileLookup", "true").parquet(source)
    return rows.groupBy(F.to_date("ts").alias("day"), "kind").agg(
        F.count("value").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread"))


def rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_new_changed_and_removed_files(spark, tmp_path):
    source, rollup = str(tmp_path / "in"), Rollup(str(tmp_path / "rollup"), "ts", ["kind"], MEASURES)
    with pytest.raises(ValueError):
        rollup.result(spark)
    put(events(spark, 0, 90), f"{source}/a")
    put(events(spark, 60, 200), f"{source}/b")
    assert rollup.refresh(spark, source) == {"read": 2, "kept": 0, "dropped": 0}
    assert rows(rollup.result(spark)) == rows(full(spark, source))
    assert rollup.refresh(spark, source) == {"read": 0, "kept": 2, "dropped": 0} and rollup.version(spark) == 1
    put(events(spark, 30, 77), f"{source}/late c")
    assert rollup.refresh(spark, source) == {"read": 1, "kept": 2, "dropped": 0}
    assert rows(rollup.result(spark)) == rows(full(spark, source))
    read = spark.read.parquet(f"{rollup.path}/parts/v=2").select("_file").distinct().collect()
    assert len(read) == 1 and "late" in read[0][0]
    put(events(spark, 500, 520), f"{source}/a")  # another file in place of the first
    assert rollup.refresh(spark, source) == {"read": 1, "kept": 2, "dropped": 1}
    assert rows(rollup.result(spark)) == rows(full(spark, source))
    put(events(spark, 0, 0), f"{source}/b")  # a file without rows
    assert rollup.refresh(spark, source)["dropped"] == 1
    assert rows(rollup.result(spark)) == rows(full(spark, source))
    rollup.compact(spark)
    assert rows(rollup.result(spark)) == rows(full(spark, source))
    assert rollup.refresh(spark, source)["read"] == 0


def test_a_refresh_without_manifest_counts_for_nothing(spark, tmp_path):
    source, rollup = str(tmp_path / "in"), Rollup(str(tmp_path / "rollup"), "ts", ["kind"], MEASURES)
    put(events(spark, 0, 50), source)
    rollup.refresh(spark, source)
    wanted = rows(rollup.result(spark))
    put(events(spark, 0, 50).withColumn("_file", F.lit("x")), f"{rollup.path}/parts/v=2")  # died before its manifest
    (tmp_path / "rollup" / "manifest" / "v=2").mkdir()
    assert rollup.version(spark) == 1 and rows(rollup.result(spark)) == wanted
    put(events(spark, 50, 60), f"{source}/more")
    assert rollup.refresh(spark, source)["read"] == 1
    assert rows(rollup.result(spark)) == rows(full(spark, source))
