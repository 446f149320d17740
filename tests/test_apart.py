"""Statements with an aggregate per joined table: the same rows as from Spark alone, without the pairs of those tables."""

import pytest
from pyspark.sql import functions as F

from plumbline.plans import runner
from plumbline.suite import passing

JOINED = "FROM g LEFT JOIN s ON s.k = g.k LEFT JOIN c ON c.k = g.k AND c.b > 1"
STATEMENTS = [
    f"SELECT g.name, count(DISTINCT s.id) AS x, count(DISTINCT c.id) AS y {JOINED} GROUP BY g.name",
    f"SELECT g.name AS n, max(s.id) AS x, count(DISTINCT c.id) + min(c.b) AS y {JOINED} GROUP BY g.name HAVING count(DISTINCT s.id) > 0 ORDER BY y, n LIMIT 7",
    f"SELECT g.f, count(DISTINCT coalesce(c.id, -1)) AS y, min(s.id) AS x {JOINED} GROUP BY g.f",
    f"SELECT upper(g.name) AS n, count(DISTINCT s.id, c.id) AS both, max(c.b) AS y {JOINED} WHERE g.k <> 2 OR s.id > 3 GROUP BY upper(g.name)",
    "SELECT s.k, count(DISTINCT s.id) AS x, count(DISTINCT c.id) AS y FROM s JOIN c ON s.k = c.k GROUP BY s.k",
    "SELECT c.k, min(s.id) AS x, max(c.id) AS y FROM s LEFT JOIN c ON s.k = c.k AND s.id < c.id GROUP BY c.k",
    "SELECT g.name, count(DISTINCT c.id) AS y FROM g JOIN s ON s.k = g.k JOIN c ON c.k = s.k GROUP BY g.name",
    # Left as they are: repeated rows count, or rows differ from one reading to the next.
    f"SELECT g.name, count(s.id) AS x, count(DISTINCT c.id) AS y {JOINED} GROUP BY g.name",
    "SELECT g.name, count(DISTINCT s.id) AS x, count(DISTINCT c.id) AS y FROM g FULL JOIN s ON s.k = g.k LEFT JOIN c ON c.k = g.k GROUP BY g.name",
]


@pytest.fixture(scope="module")
def views(spark):
    key = lambda n: F.when(F.col("id") % 9 > 0, F.col("id") % n)
    name = F.when(F.col("id") % 5 > 0, F.concat(F.lit("n"), (F.col("id") % 4).cast("string")))
    f = F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).when(F.col("id") % 3 == 1, -F.lit(0.0)).otherwise(F.lit(0.0))
    return {"g": spark.range(12).select(F.col("id").alias("k"), name.alias("name"), f.alias("f")),
            "s": spark.range(40).select("id", key(7).alias("k")).repartition(3),
            "c": spark.range(60).select("id", key(6).alias("k"), (F.col("id") % 4).alias("b"))}


@pytest.mark.parametrize("sql", STATEMENTS)
def test_same_rows_as_from_spark_alone(spark, views, sql):
    got = runner.statement(spark, sql, views)
    want = spark.sql(sql)
    assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    rows = sorted(map(str, got.collect()))
    assert rows and rows == sorted(map(str, want.collect()))
    assert ("_group_0" in got._jdf.queryExecution().analyzed().toString()) == (sql in STATEMENTS[:7])


def test_rows_that_differ_per_reading_are_read_once(spark, views):
    sql = STATEMENTS[0]
    drawn = views | {"s": views["s"].where(F.rand() < 0.5)}
    assert "_group_0" not in runner.statement(spark, sql, drawn)._jdf.queryExecution().analyzed().toString()


def _most_joined(node) -> int:
    """The most rows that a join of a finished plan gave out."""
    own = node.metrics().apply("numOutputRows").value() if "Join" in node.nodeName() else 0
    return max([own, *[_most_joined(node.children().apply(i)) for i in range(node.children().size())]])


def test_no_pairs_of_a_nations_suppliers_and_customers(spark, tmp_path):
    nation = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5)  # one nation holds a third and more
    tables = {
        "region": spark.range(1).selectExpr("id AS r_regionkey", "'R' AS r_name"),
        "nation": spark.range(6).selectExpr("id AS n_nationkey", "concat('N', id) AS n_name", "0L AS n_regionkey"),
        "supplier": spark.range(300).select(F.col("id").alias("s_suppkey"), nation.alias("s_nationkey")),
        "customer": spark.range(900).select(F.col("id").alias("c_custkey"), nation.alias("c_nationkey"), (F.col("id") * 11.0).alias("c_acctbal")),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a plan that is finished keeps its figures in place
    try:
        query = passing.QUERIES["L2_joins"][0](spark, str(tmp_path))
        rows = {r["n_name"]: (r["suppliers"], r["customers"]) for r in query.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    at = [0 if i % 3 == 0 else i % 5 for i in range(900)]
    assert rows == {f"N{n}": (at[:300].count(n), sum(k == n and i * 11 > 5000 for i, k in enumerate(at))) for n in range(6)}
    assert 0 < _most_joined(query._jdf.queryExecution().executedPlan()) <= 910
