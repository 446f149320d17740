"""Cleaning operators over dirtied customers and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import clean, neighbours
from plumbline.operators.workbench import Workbench
from plumbline.suite.tables import dirty_customer, dirty_sql, table

SQUEEZE = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _seg(spark, d):
    return dirty_customer(spark, d, "segment", key=True)


def trim_whitespace(spark, d):
    out, record = clean.trim_whitespace(_seg(spark, d), "segment")
    return out.groupBy("segment").agg(F.count("*").alias("n"), F.lit(record["cells_changed"]).cast("long").alias("cells_changed"))


TRIM_SQL = f"""
SELECT {SQUEEZE.format(c='segment')} AS segment, count(*) AS n,
 (SELECT count(*) FROM ({dirty_sql('segment')}) WHERE segment <> {SQUEEZE.format(c='segment')}) AS cells_changed
FROM ({dirty_sql('segment')}) GROUP BY 1"""


def standardize(spark, d):
    out, record = clean.standardize_categories(_seg(spark, d), "segment", order_by="c_custkey")
    return out.groupBy("segment").agg(F.count("*").alias("n"), F.lit(record["cells_changed"]).cast("long").alias("cells_changed"))


STANDARD_SQL = f"""
WITH t AS (SELECT c_custkey, segment, lower({SQUEEZE.format(c='segment')}) AS canon FROM ({dirty_sql('segment', key=True)})),
 best AS (SELECT canon, arg_min(segment, (-n, seen, segment)) AS canonical FROM
  (SELECT canon, segment, count(*) AS n, min(c_custkey) AS seen FROM t GROUP BY 1, 2) GROUP BY 1)
SELECT canonical AS segment, count(*) AS n, (SELECT count(*) FROM t JOIN best USING (canon) WHERE segment <> canonical) AS cells_changed
FROM t JOIN best USING (canon) GROUP BY 1"""


def to_numeric(spark, d):
    out, record = clean.to_numeric(dirty_customer(spark, d, "amount", key=True), "amount")
    return out.agg(
        F.count("amount").alias("parsed"), F.round(F.sum("amount"), 2).alias("total"), F.max("amount").alias("most"),
        F.lit(record["failed_conversions"]).cast("long").alias("failed"),
    )


NUMERIC_SQL = f"""
SELECT count(v) AS parsed, round(sum(v), 2) AS total, max(v) AS most, count(*) - count(v) AS failed
FROM (SELECT try_cast(replace(amount, ',', '') AS DOUBLE) AS v FROM ({dirty_sql('amount')}))"""


def to_datetime(spark, d):
    out, record = clean.to_datetime(dirty_customer(spark, d, "joined", key=True), "joined")
    return out.groupBy(F.date_format("joined", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"), F.lit(record["failed_conversions"]).cast("long").alias("failed")
    )


DATETIME_SQL = f"""
WITH t AS (SELECT coalesce(try_strptime(joined, '%Y-%m-%d'), try_strptime(joined, '%m/%d/%Y')) AS v FROM ({dirty_sql('joined')}))
SELECT strftime(v, '%Y-%m-%d') AS day, count(*) AS n, (SELECT count(*) - count(v) FROM t) AS failed FROM t GROUP BY 1"""

def _dedup(keep):
    def run(spark, d):
        lines = table(spark, d, "lineitem").selectExpr("l_suppkey", "l_returnflag", "l_quantity", "l_orderkey * 10 + l_linenumber AS row_key")
        out, record = clean.drop_duplicates(lines, ["row_key"], keep=keep)
        return out.agg(
            F.count("*").alias("rows"), F.sum("row_key").alias("key_sum"), F.min("row_key").alias("key_min"),
            F.lit(record["rows_removed"]).cast("long").alias("removed"),
        )
    return run


def _dedup_sql(pick: str, having: str = "") -> str:
    return f"""
SELECT count(*) AS rows, sum(k)::BIGINT AS key_sum, min(k) AS key_min, (SELECT count(*) FROM lineitem) - count(*) AS removed
FROM (SELECT {pick}(l_orderkey * 10 + l_linenumber) AS k FROM lineitem GROUP BY l_suppkey, l_returnflag, l_quantity {having})"""


def drop_column(spark, d):
    out, _ = clean.drop_column(dirty_customer(spark, d, "segment", "nothing", key=True), "nothing")
    return out.select(F.lit(",".join(out.columns)).alias("columns"), "c_custkey", "segment")


def drop_rows_missing(spark, d):
    out, record = clean.drop_rows_missing(dirty_customer(spark, d, "balance", "few_gaps", "vip", key=True))
    return out.groupBy("vip").agg(
        F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"),
        F.lit(record["rows_removed"]).cast("long").alias("removed"),
    )


DROP_MISSING_SQL = f"""
WITH t AS ({dirty_sql('balance', 'few_gaps', 'vip')})
SELECT vip, count(*) AS n, round(sum(balance), 2) AS balance,
 (SELECT count(*) FROM t WHERE balance IS NULL OR few_gaps IS NULL) AS removed
FROM t WHERE balance IS NOT NULL AND few_gaps IS NOT NULL GROUP BY 1"""


def _impute(column, strategy, **more):
    def run(spark, d):
        out, record = clean.impute_missing(dirty_customer(spark, d, column, key=True), column, strategy, **more)
        return out.agg(
            F.count(column).alias("present"), F.round(F.sum(F.col(column)).cast("double"), 2).alias("total"),
            F.lit(record["missing_before"]).cast("long").alias("missing_before"),
            F.lit(record["strategy"]).alias("strategy"),
        )
    return run


def _impute_sql(column, fill, strategy):
    return f"""
WITH t AS ({dirty_sql(column)}), f AS (SELECT ({fill})::DOUBLE AS v FROM t)
SELECT count(*) AS present, round(sum(coalesce({column}, v)) * 1.0::DOUBLE, 2) AS total,
 (SELECT count(*) - count({column}) FROM t) AS missing_before, '{strategy}' AS strategy FROM t, f"""


def impute_wide_ids(spark, d):
    """Keys that doubles cannot tell apart stay apart, and keep their type, when gaps are filled."""
    lines = table(spark, d, "lineitem").selectExpr(
        "CASE WHEN l_linenumber <> 5 THEN l_orderkey * 8 + l_linenumber + 1152921504606846976 END AS line_id")
    out, record = clean.impute_missing(lines, "line_id", "constant", 1152921504606846977)
    return out.agg(
        F.count("line_id").alias("present"), F.count_distinct("line_id").alias("distinct_ids"),
        F.sum(F.col("line_id") - F.lit(1 << 60)).alias("total"), F.lit(record["missing_before"]).cast("long").alias("missing_before"),
        F.lit(out.schema["line_id"].dataType.simpleString()).alias("type"),
    )


IMPUTE_WIDE_SQL = """
WITH t AS (SELECT CASE WHEN l_linenumber <> 5 THEN l_orderkey * 8 + l_linenumber END AS k FROM lineitem)
SELECT count(*) AS present, count(DISTINCT coalesce(k, 1)) AS distinct_ids, sum(coalesce(k, 1))::BIGINT AS total,
 count(*) - count(k) AS missing_before, 'bigint' AS type FROM t"""


def impute_labels(spark, d):
    gaps = dirty_customer(spark, d, "channel", "vip", key=True).withColumn(
        "vip", F.when(F.col("c_custkey") % 8 != 0, F.col("vip"))
    ).withColumn("channel", F.when(F.col("c_custkey") % 6 != 0, F.col("channel")))
    out, first = clean.impute_missing(gaps, "vip")
    out, second = clean.impute_missing(out, "channel", "constant", "Unknown")
    return out.groupBy("vip", "channel").agg(F.count("*").alias("n"))


IMPUTE_LABEL_SQL = f"""
WITH t AS (SELECT CASE WHEN c_custkey % 8 <> 0 THEN vip END AS vip, CASE WHEN c_custkey % 6 <> 0 THEN channel END AS channel
  FROM ({dirty_sql('vip', 'channel', key=True)})),
 m AS (SELECT vip AS mode FROM t WHERE vip IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT coalesce(vip, mode) AS vip, coalesce(channel, 'Unknown') AS channel, count(*) AS n FROM t, m GROUP BY 1, 2"""

_KNN = ("balance", "few_gaps", "churn_score")


def impute_knn(spark, d):
    df = dirty_customer(spark, d, *_KNN, key=True)
    out, k = neighbours.knn_impute(df, "balance", "c_custkey")
    filled = out.join(df.filter("balance IS NULL").select("c_custkey"), "c_custkey")
    return filled.select("c_custkey", F.round("balance", 4).alias("balance"), F.lit(k).alias("k"))


KNN_SQL = f"""
WITH t AS ({dirty_sql(*_KNN, key=True)}), n AS (SELECT least(5, greatest(2, count(*) // 20)) AS k FROM t),
 pairs AS (SELECT q.c_custkey, d.balance, d.c_custkey AS donor,
   sqrt((coalesce((q.few_gaps - d.few_gaps) ** 2, 0) + coalesce((q.churn_score - d.churn_score) ** 2, 0)) * 3.0
    / ((q.few_gaps IS NOT NULL AND d.few_gaps IS NOT NULL)::INT + 1)) AS dist
  FROM t q, t d WHERE q.balance IS NULL AND d.balance IS NOT NULL)
SELECT c_custkey, round(avg(balance), 4) AS balance, k::INTEGER AS k FROM
 (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY dist, donor) AS rn FROM pairs), n WHERE rn <= k GROUP BY c_custkey, k"""


def _outliers(strategy):
    def run(spark, d):
        out, record = clean.handle_outliers(dirty_customer(spark, d, "spend", "vip", key=True), "spend", strategy)
        flagged = F.count_if(F.col("spend__is_outlier")) if strategy == "flag" else F.lit(0).cast("long")
        return out.groupBy("vip").agg(
            F.count("*").alias("n"), F.round(F.sum("spend"), 2).alias("spend"), flagged.alias("flagged"),
            F.lit(record["outliers"]).cast("long").alias("outliers"),
        )
    return run


def _outlier_sql(value="spend", where="true", flagged="0::BIGINT"):
    return f"""
WITH t AS ({dirty_sql('spend', 'vip')}), q AS (SELECT quantile_cont(spend, 0.25) AS a, quantile_cont(spend, 0.75) AS b FROM t),
 f AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM q)
SELECT vip, count(*) AS n, round(sum({value}), 2) AS spend, {flagged} AS flagged,
 (SELECT count(*) FROM t, f WHERE spend < lo OR spend > hi) AS outliers FROM t, f WHERE {where} GROUP BY vip"""


def group_rare(spark, d):
    out, record = clean.group_rare_categories(table(spark, d, "documents"), "source", 0.04)
    return out.groupBy("source").agg(F.count("*").alias("n"), F.lit(record["levels_grouped"]).cast("long").alias("grouped"))


RARE_SQL = """
WITH c AS (SELECT source, count(*) AS n, count(*) < 0.04 * sum(count(*)) OVER () AS rare FROM documents GROUP BY 1)
SELECT CASE WHEN rare THEN 'Other' ELSE source END AS source, sum(n)::BIGINT AS n, (SELECT count(*) FROM c WHERE rare) AS grouped
FROM c GROUP BY 1"""


def map_categories(spark, d):
    mapping = {"BUILDING": "SITE", "MACHINERY": "PLANT"}
    out, record = clean.map_categories(table(spark, d, "customer"), "c_mktsegment", mapping)
    return out.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.lit(record["cells_changed"]).cast("long").alias("changed"))


MAP_SQL = """
SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'SITE' WHEN 'MACHINERY' THEN 'PLANT' ELSE c_mktsegment END AS c_mktsegment,
 count(*) AS n, (SELECT count(*) FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) AS changed FROM customer GROUP BY 1"""

STEPS = [
    {"op": "standardize_categories", "params": {"column": "segment"}},
    {"op": "to_numeric", "params": {"column": "amount"}},
    {"op": "impute_missing", "params": {"column": "balance", "strategy": "median"}},
    {"op": "drop_column", "params": {"column": "nothing"}},
    {"op": "trim_whitespace", "params": {"column": "nothing"}},
]
_BENCH = ("segment", "amount", "balance", "nothing")


def apply_operations(spark, d):
    out, records = clean.apply_operations(dirty_customer(spark, d, *_BENCH, key=True), STEPS, "c_custkey")
    skipped = sum(1 for r in records if r.get("skipped"))
    return out.groupBy("segment").agg(
        F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"), F.round(F.sum("balance"), 2).alias("balance"),
        F.lit(skipped).cast("long").alias("skipped"),
    )


APPLY_SQL = f"""
WITH t AS (SELECT *, lower({SQUEEZE.format(c='segment')}) AS canon FROM ({dirty_sql(*_BENCH, key=True)})),
 best AS (SELECT canon, arg_min(segment, (-n, seen, segment)) AS canonical FROM
  (SELECT canon, segment, count(*) AS n, min(c_custkey) AS seen FROM t GROUP BY 1, 2) GROUP BY 1)
SELECT canonical AS segment, count(*) AS n, round(sum(try_cast(replace(amount, ',', '') AS DOUBLE)), 2) AS amount,
 round(sum(coalesce(balance, (SELECT median(balance) FROM t))), 2) AS balance, 1::BIGINT AS skipped
FROM t JOIN best USING (canon) GROUP BY 1"""

_STATS = ("segment", "balance", "sparse", "nothing")


def frame_stats(spark, d):
    return clean.frame_stats(dirty_customer(spark, d, *_STATS)).withColumn("columns", F.col("columns").cast("long"))


STATS_SQL = f"""
WITH t AS ({dirty_sql(*_STATS)})
SELECT count(*) AS rows, 4::BIGINT AS columns, (4 * count(*) - count(segment) - count(balance) - count(sparse) - count(nothing)) AS missing_cells,
 (SELECT coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM t GROUP BY {", ".join(_STATS)} HAVING count(*) > 1)) AS duplicate_rows
FROM t"""


def column_diff(spark, d):
    before = dirty_customer(spark, d, *_BENCH, key=True)
    after, _ = clean.apply_operations(before, STEPS + [{"op": "handle_outliers", "params": {"column": "balance"}}], "c_custkey")
    return clean.column_diff(before, after)


DIFF_SQL = f"""
WITH t AS ({dirty_sql(*_BENCH)}), n AS (SELECT count(*) AS n, count(balance) AS b, count(try_cast(replace(amount, ',', '') AS DOUBLE)) AS a FROM t)
SELECT 'c_custkey' AS "column", 'unchanged' AS status, 'bigint' AS dtype_before, 'bigint' AS dtype_after, 0::BIGINT AS missing_before, 0::BIGINT AS missing_after FROM n
UNION ALL SELECT 'segment', 'unchanged', 'string', 'string', 0, 0 FROM n
UNION ALL SELECT 'amount', 'modified', 'string', 'double', 0, n - a FROM n
UNION ALL SELECT 'balance', 'modified', 'double', 'double', n - b, 0 FROM n
UNION ALL SELECT 'nothing', 'dropped', 'double', NULL, n, NULL FROM n
UNION ALL SELECT 'balance__is_outlier', 'added', NULL, 'boolean', NULL, 0 FROM n"""


def preview(spark, d):
    seen = clean.preview(dirty_customer(spark, d, *_BENCH, key=True), STEPS, "c_custkey")
    tag = lambda df, s: df.select(F.lit(s).alias("stage"), "rows", F.col("columns").cast("long").alias("columns"), "missing_cells")
    return tag(seen["before"], "before").unionByName(tag(seen["after"], "after"))


PREVIEW_SQL = f"""
WITH t AS ({dirty_sql(*_BENCH)})
SELECT 'before' AS stage, count(*) AS rows, 4::BIGINT AS columns, 4 * count(*) - count(segment) - count(amount) - count(balance) - count(nothing) AS missing_cells FROM t
UNION ALL SELECT 'after', count(*), 3, count(*) - count(try_cast(replace(amount, ',', '') AS DOUBLE)) FROM t"""


def history(spark, d):
    bench = Workbench(dirty_customer(spark, d, *_BENCH, key=True), "c_custkey")
    bench.apply(STEPS[:1])
    bench.apply([{"op": "drop_rows_missing", "params": {"columns": ["balance"]}}])
    full = bench.current
    bench.undo()
    undone = bench.current
    bench.reset()
    return (
        full.agg(F.lit("applied").alias("stage"), F.count("*").alias("rows"), F.count_distinct("segment").alias("labels"))
        .unionByName(undone.agg(F.lit("undone").alias("stage"), F.count("*").alias("rows"), F.count_distinct("segment").alias("labels")))
        .unionByName(bench.current.agg(F.lit("reset").alias("stage"), F.count("*").alias("rows"), F.count_distinct("segment").alias("labels")))
    )


HISTORY_SQL = f"""
WITH t AS ({dirty_sql(*_BENCH)}), c AS (SELECT count(DISTINCT lower({SQUEEZE.format(c='segment')})) AS k FROM t)
SELECT 'applied' AS stage, count(balance) AS rows, any_value(k) AS labels FROM t, c
UNION ALL SELECT 'undone', count(*), any_value(k) FROM t, c
UNION ALL SELECT 'reset', count(*), count(DISTINCT segment) FROM t"""


def score_change(spark, d):
    bench = Workbench(dirty_customer(spark, d, "segment", "few_gaps", "plan", key=True), "c_custkey")
    bench.apply([
        {"op": "standardize_categories", "params": {"column": "segment"}},
        {"op": "impute_missing", "params": {"column": "few_gaps", "strategy": "median"}},
        {"op": "drop_column", "params": {"column": "plan"}},
    ])
    return bench.score_change()


QUERIES = {
    "C1_trim_whitespace": (trim_whitespace, TRIM_SQL),
    "C2_standardize_categories": (standardize, STANDARD_SQL),
    "C3_to_numeric": (to_numeric, NUMERIC_SQL),
    "C4_to_datetime": (to_datetime, DATETIME_SQL),
    "C5_drop_duplicates_first": (_dedup("first"), _dedup_sql("min")),
    "C5_drop_duplicates_last": (_dedup("last"), _dedup_sql("max")),
    "C5_drop_duplicates_none": (_dedup(False), _dedup_sql("min", "HAVING count(*) = 1")),
    "C6_drop_column": (drop_column, f"SELECT 'c_custkey,segment' AS columns, c_custkey, segment FROM ({dirty_sql('segment', key=True)})"),
    "C7_drop_rows_missing": (drop_rows_missing, DROP_MISSING_SQL),
    "C8_impute_mean": (_impute("balance", "mean"), _impute_sql("balance", "avg(balance)", "mean")),
    "C8_impute_median": (_impute("balance", "median"), _impute_sql("balance", "median(balance)", "median")),
    "C8_impute_mode": (_impute("few_gaps", "mode"), f"""
WITH t AS ({dirty_sql('few_gaps')}), f AS (SELECT few_gaps::DOUBLE AS v FROM t WHERE few_gaps IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT count(*) AS present, round(sum(coalesce(few_gaps, v)), 2) AS total, (SELECT count(*) - count(few_gaps) FROM t) AS missing_before, 'mode' AS strategy FROM t, f"""),
    "C8_impute_constant": (_impute("balance", "constant", value=7), _impute_sql("balance", "max(7)", "constant")),
    "C8_wide_ids": (impute_wide_ids, IMPUTE_WIDE_SQL),
    "C8_impute_labels": (impute_labels, IMPUTE_LABEL_SQL),
    "C9_impute_auto": (_impute("balance", "auto"), f"""
WITH t AS ({dirty_sql('balance')}), f AS (SELECT CASE WHEN abs(skewness(balance)) > 1 THEN median(balance) ELSE avg(balance) END AS v,
 CASE WHEN abs(skewness(balance)) > 1 THEN 'median' ELSE 'mean' END AS s FROM t)
SELECT count(*) AS present, round(sum(coalesce(balance, v)), 2) AS total, count(*) - count(balance) AS missing_before, any_value(s) AS strategy FROM t, f"""),
    "C10_impute_knn": (impute_knn, KNN_SQL),
    "C11_outliers_remove": (_outliers("remove"), _outlier_sql(where="NOT (spend < lo OR spend > hi)")),
    "C12_outliers_cap": (_outliers("cap"), _outlier_sql(value="least(greatest(spend, lo), hi)")),
    "C13_outliers_flag": (_outliers("flag"), _outlier_sql(flagged="count(*) FILTER (spend < lo OR spend > hi)")),
    "C14_outliers_keep": (_outliers("keep"), _outlier_sql()),
    "C15_group_rare_categories": (group_rare, RARE_SQL),
    "C16_map_categories": (map_categories, MAP_SQL),
    "C17_apply_operations": (apply_operations, APPLY_SQL),
    "C20_frame_stats": (frame_stats, STATS_SQL),
    "C21_column_diff": (column_diff, DIFF_SQL),
    "C22_preview": (preview, PREVIEW_SQL),
    "C23_history": (history, HISTORY_SQL),
    "C24_score_change": (score_change, None),
}
