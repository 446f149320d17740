"""Sources, sinks and the report."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.functions import order, values as V
from plumbline.operators import explore as E, profile as P, quality as Q, report as R
from plumbline.session import checkpoint_dir
from plumbline.sources import readers, workbook, writers
from plumbline.suite.tables import dirty_customer, table


def _path(s, name):
    return f"{checkpoint_dir(s)}/files/{name}"


def _upload(s, d, sep, name):
    """Customers written as a delimited file with an empty column and padded names."""
    customers = table(s, d, "customer").selectExpr("c_custkey AS ` key `", "c_mktsegment AS segment", "CAST(NULL AS STRING) AS blank", "c_acctbal AS balance",
                                                   "concat('2024-0', CAST(1 + c_custkey % 9 AS STRING), '-11') AS joined")
    path = _path(s, name)
    customers.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path


def _read(sep, name, reader=None):
    def run(s, d):
        path = _upload(s, d, sep, name)
        df = reader(s, path) if reader else readers.read_csv(s, path)
        month = F.date_format("joined", "yyyy-MM")
        return df.groupBy("segment", month.alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"), F.max("key").cast("long").alias("key"))
    return run


READ = """SELECT c_mktsegment AS segment, '2024-0' || (1 + c_custkey % 9) AS month, count(*) AS n, round(sum(c_acctbal), 2) AS balance, max(c_custkey) AS key FROM customer GROUP BY 1, 2"""


def s4(s, d):
    """Nations as a workbook of two sheets, written, read back from its file and joined to the table."""
    nations = table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    half = lambda keep: (nations.columns, (tuple(r) for r in nations.where(keep).toLocalIterator()))
    content = workbook.workbook_bytes({"low": half("n_regionkey < 2"), "high": half("n_regionkey >= 2")})
    path = f"{_path(s, 'workbooks')}/{uuid.uuid4().hex}"
    s.createDataFrame([(bytearray(content),)], "value binary").select(F.base64("value").alias("value")).coalesce(1).write.text(path)
    back = readers.read_xlsx(s, content=s.read.text(path, wholetext=True).first()[0].strip())
    return back.join(table(s, d, "customer"), back["n_nationkey"] == F.col("c_nationkey")).groupBy("n_name").agg(
        F.count("*").alias("customers"), F.max("n_regionkey").alias("region"))


S4 = "SELECT n_name, count(*) AS customers, max(n_regionkey) AS region FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name"


def pages(s, d):
    """Page 500 of the lines by price."""
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return order.Pages(lines, [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]).page(500, 40)


PAGES = "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 40 OFFSET 19960"


def s1(s, d):
    rows = table(s, d, "nation").orderBy("n_nationkey").collect()
    return readers.from_records(s, ["n_nationkey", "n_name"], [r.asDict() for r in rows])


def s5(s, d):
    return readers.tidy_header(table(s, d, "customer").selectExpr("c_custkey AS ` id `", "CAST(NULL AS INT) AS nothing", "c_name AS `name `"))


def s6(s, d):
    table(s, d, "lineitem").createOrReplaceTempView("lineitem")
    return readers.from_table(s, "lineitem", rows=30_000, order_by=["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


def s8(s, d):
    df = table(s, d, "part").selectExpr("p_partkey", "concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN ', \"big\"' ELSE '' END) AS name", "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS size")
    path = _path(s, "parts_csv")
    writers.write_csv(df, path)
    back = s.read.option("header", True).option("escape", '"').csv(path, schema="p_partkey long, name string, size int")
    lines = writers.csv_lines(df).withColumn("p_partkey", F.substring_index("line", ",", 1).cast("long"))
    return back.join(lines, "p_partkey")


S8 = """SELECT p_partkey, name, size, concat(p_partkey, ',', CASE WHEN contains(name, '"') THEN '"' || replace(name, '"', '""') || '"' ELSE name END, ',', coalesce(size::VARCHAR, '')) AS line
FROM (SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 0 THEN ', "big"' ELSE '' END AS name, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size END AS size FROM part)"""


def s10(s, d):
    totals = table(s, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    path = _path(s, "pinned")
    totals.withColumn("chart", F.lit("bar")).write.mode("overwrite").parquet(path)
    return s.read.parquet(path)


def s11(s, d):
    about = P.overview(table(s, d, "orders"), "orders", order_by="o_orderkey")
    shown = about["sample_rows"].agg(F.count("*").alias("n")).scalar()
    first = about["sample_rows"].agg(F.min("o_orderdate").alias("t")).scalar()
    return about["columns"].select(
        "ordinal", "column", "kind", "missing", F.lit(about["n_rows"]).alias("rows"), shown.alias("shown"), first.alias("first")
    )


S11 = """SELECT o AS ordinal, c AS "column", k AS kind, 0::BIGINT AS missing, (SELECT count(*) FROM orders) AS rows, 10::BIGINT AS shown,
 (SELECT min(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')) FROM (SELECT o_orderdate FROM orders ORDER BY o_orderkey LIMIT 10)) AS first
FROM (VALUES (0, 'o_orderkey', 'numeric'), (1, 'o_custkey', 'numeric'), (2, 'o_orderstatus', 'categorical'), (3, 'o_totalprice', 'numeric'), (4, 'o_orderdate', 'datetime'), (5, 'o_orderpriority', 'categorical')) AS v(o, c, k)"""


def s12(s, d):
    df = table(s, d, "events").selectExpr("event_id", "CASE WHEN event_id % 5 = 0 THEN double('NaN') WHEN event_id % 5 = 1 THEN double('-Infinity') ELSE value END AS value", "ts",
                                          "CAST(user_id AS DECIMAL(20,0)) AS user")
    return V.json_safe(df)


S12 = """SELECT event_id, CASE WHEN event_id % 5 > 1 THEN value END AS value,
 strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE printf('.%06d', microsecond(ts) % 1000000) END AS ts, user_id AS "user" FROM events"""


def r1(s, d):
    df = dirty_customer(s, d, "segment", "balance", "spend", "channel", "plan")
    facts = P.column_facts(df)
    issues = Q.analyze_quality(df, facts)
    score, dims = Q.overall_score(issues), Q.dimension_scores(issues)
    numbers = E.numeric_summary(df, ["balance", "spend"])
    labels = E.categorical_summary(df, ["segment", "channel"])
    pairs = E.top_pairs(E.correlations(df, ["balance", "spend"]))
    return R.build_report("customers", facts, issues, score, dims, numeric=numbers, categorical=labels, pairs=pairs, findings=E.skew_findings(numbers))


QUERIES = {
    "S1_from_records": (s1, 'SELECT n_nationkey - (SELECT min(n_nationkey) FROM nation) AS _row_id, n_nationkey, n_name FROM nation'),
    "S4_read_xlsx": (s4, S4), "G30_deep_page": (pages, PAGES),
    "S2_read_csv": (_read(";", "customers_semicolon"), READ), "S3_read_tsv": (_read("\t", "customers_tab", readers.read_tsv), READ),
    "S5_tidy_header": (s5, "SELECT c_custkey AS id, c_name AS name FROM customer"),
    "S6_from_table": (s6, "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 30000"),
    "S8_write_csv": (s8, S8), "S10_pin_result": (s10, "SELECT o_orderpriority, count(*) AS n, 'bar' AS chart FROM orders GROUP BY 1"),
    "S11_overview": (s11, S11), "S12_json_safe": (s12, S12), "R1_report": (r1, None),
}
