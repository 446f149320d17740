from pyspark.sql import functions as F

from plumbline.operators import profile as P, quality as Q
from plumbline.streaming import watch

SCHEMA = "k long, part int, label string, note string, code string, day string, gap double, flag boolean, at timestamp, tags array<string>"


def _rows(spark):
    return spark.range(600).selectExpr(
        "id AS k", "CAST(id DIV 200 AS INT) AS part", "CASE WHEN id = 450 THEN 'RED ' WHEN id % 2 = 0 THEN 'red' ELSE 'blue' END AS label",
        "CASE WHEN id < 200 THEN ' x' ELSE concat('a long text that no other row of this table repeats, number ', id) END AS note",
        "CASE WHEN id < 60 THEN 'n/a' ELSE CAST(id AS STRING) END AS code", "CAST(date_add(DATE'2024-01-01', CAST(id % 300 AS INT)) AS STRING) AS day",
        "CASE WHEN id < 200 AND id % 2 = 0 THEN NULL WHEN id = 7 THEN double('nan') ELSE id * 0.5D END AS gap", "id % 3 = 0 AS flag",
        "timestamp_seconds(id) AS at", "array(CAST(id % 2 AS STRING)) AS tags")


def _plain(df):
    return sorted(tuple(sorted(x.items()) if isinstance(x, dict) else str(x) for x in r) for r in df.select(*[c.split()[0] for c in Q.ISSUE_SCHEMA.replace("map<string,string>", "m").split(", ")]).collect())


def test_the_running_profile_equals_that_of_the_whole_table(spark, tmp_path):
    rows = _rows(spark)
    for n in range(3):
        rows.where(F.col("part") == n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    watch.watch(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    whole = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in")
    facts = P.column_facts(whole)
    want = Q.missing_issues(facts).unionByName(Q.type_issues(facts)).unionByName(Q.label_issues(whole, facts))
    got = watch.latest(spark, f"{tmp_path}/out", "issues", Q.ISSUE_SCHEMA)
    assert len(_plain(want)) >= 4 and _plain(got) == _plain(want)
    sums = {r.column: r for r in watch.latest(spark, f"{tmp_path}/out", "sums", watch.SUMS).collect()}
    for r in facts.where("kind = 'numeric'").collect():
        s = sums[r.column]
        assert (s.rows, s["count"], s.min, s.max) == (r.rows, r["count"], r.min, r.max)
        assert abs(s.mean - r.mean) < 1e-9 and abs((s.m2 / (s["count"] - 1)) ** 0.5 - r.std) < 1e-9
    seen = spark.read.parquet(f"{tmp_path}/out/changes").groupBy("code").agg(F.collect_set("change").alias("c"))
    seen = {r.code: set(r.c) for r in seen.collect()}
    assert "resolved" in seen["category::whitespace::note"] and "changed" in seen["missing::gap"]
    assert seen["category::inconsistent::label"] == {"raised"}


def test_merging_in_any_order_and_empty_parts(spark):
    rows = _rows(spark)
    parts = [watch.batch_sums(rows.where(F.col("part") == n)) for n in range(3)]
    none = watch.batch_sums(rows.limit(0))
    key = lambda df: {r.column: tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect() if r.rows}
    one = key(watch.merged_sums(watch.merged_sums(parts[0], parts[1]), parts[2]))
    assert one == key(watch.merged_sums(parts[2], none, watch.merged_sums(parts[1], parts[0]))) == key(watch.merged_sums(watch.batch_sums(rows)))
    levels = watch.merged_levels(watch.batch_levels(rows.where("part = 0")), watch.batch_levels(rows.where("part > 0")), watch.batch_levels(rows.limit(0)))
    assert sorted(levels.collect()) == sorted(watch.batch_levels(rows).collect())
