"""Chart shaping over order and event results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.functions.order import number_rows
from plumbline.operators import charts as H, refresh
from plumbline.session import checkpoint_dir
from plumbline.suite.tables import table


def _orders(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey", "o_orderdate AS created_at", "o_orderstatus AS status", "o_totalprice",
        "date_format(o_orderdate, 'yyyy-MM') AS month", "o_orderpriority AS priority",
    )


def global_filters(spark, d):
    orders = _orders(spark, d)
    now = orders.agg(F.max("created_at").alias("t")).scalar()
    out = H.global_filters(orders, {"date_range": "90", "status": "F", "limit": "many"}, now)
    return out.select("o_orderkey", "o_totalprice")


FILTER_SQL = """SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY AND o_orderstatus = 'F'"""


def pivot_grouped(spark, d):
    return H.pivot_grouped(_orders(spark, d), "month", "status", "o_totalprice", "o_orderkey")


PIVOT_SQL = """
SELECT month, max(v) FILTER (s = 'F') AS "F", max(v) FILTER (s = 'O') AS "O", max(v) FILTER (s = 'P') AS "P" FROM
(SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS s, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1, 2) GROUP BY 1"""

_SPARSE = "CASE WHEN o_orderkey % 3 = 0 THEN 'low' WHEN o_orderkey % 3 = 1 AND month(o_orderdate) > 6 THEN 'mid' ELSE 'high' END"
_ONLY = "CASE WHEN month(o_orderdate) % 2 = 0 THEN 'even' ELSE 'odd' END"


def compact_bars(spark, d):
    orders = table(spark, d, "orders").selectExpr(
        "date_format(o_orderdate, 'yyyy-MM') AS month", f"{_SPARSE} AS band", f"{_ONLY} AS half", "o_totalprice", "o_orderkey"
    ).withColumn("series", F.concat_ws("-", "half", "band"))
    wide = H.pivot_grouped(orders, "month", "series", "o_totalprice", "o_orderkey")
    names = sorted(c for c in wide.columns if c != "month")
    return H.compact_bars(wide, "month", names).select("label", F.round("position", 6).alias("position"), "series", "value")


COMPACT_SQL = f"""
WITH c AS (SELECT strftime(o_orderdate, '%Y-%m') AS label, {_ONLY} || '-' || {_SPARSE} AS series, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2),
 r AS (SELECT *, dense_rank() OVER (ORDER BY label) - 1 AS g, row_number() OVER (PARTITION BY label ORDER BY series) - 1 AS i, count(*) OVER (PARTITION BY label) AS k FROM c)
SELECT label, round(g + (i - (k - 1) / 2.0::DOUBLE) * (0.8 / (SELECT max(k) FROM r)), 6) AS position, series, value FROM r"""


def _monthly(spark, d):
    return _orders(spark, d).groupBy("month").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("orders"))


_MONTHLY = "SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS revenue, count(*) AS orders FROM orders GROUP BY 1"


def normalise(spark, d):
    return H.normalise(_monthly(spark, d), ["revenue", "orders"])


NORMAL_SQL = f"""
WITH m AS ({_MONTHLY})
SELECT month, floor(revenue / (SELECT max(abs(revenue)) FROM m) * 1000 + 0.5) / 10 AS revenue, revenue AS raw_revenue,
 floor(orders::DOUBLE / (SELECT max(orders) FROM m) * 1000 + 0.5) / 10 AS orders, orders AS raw_orders FROM m"""


def chart_rows(spark, d):
    orders = _orders(spark, d).select("month", "priority", "o_totalprice", "o_orderkey")
    wide = H.chart_rows(orders, "month", ["o_totalprice"], "o_orderkey")
    plain = H.chart_rows(_monthly(spark, d).withColumn("k", F.col("month")), "month", ["revenue"], "k")
    first = wide.columns[1]
    return wide.join(plain, "month").select("month", "revenue", F.col(f"`{first}`").alias("some_priority"),
                                            F.lit(len(wide.columns) - 1).cast("long").alias("series"))


CHART_ROWS_SQL = f"""
WITH p AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS s, arg_max(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1, 2),
 f AS (SELECT arg_min(o_orderpriority, o_orderkey) AS s FROM orders)
SELECT m.month, m.revenue, p.v AS some_priority, (SELECT count(DISTINCT s) FROM p) AS series
FROM ({_MONTHLY}) m LEFT JOIN (SELECT month, v FROM p JOIN f USING (s)) p ON p.month = m.month"""


def sort_by_time(spark, d):
    rows = _monthly(spark, d).withColumn("key", F.reverse("month"))
    ordered = H.sort_by_time(rows, "month", "key")
    return number_rows(ordered, [F.col("month")]).select("month", "position")


TIME_SQL = f"SELECT month, row_number() OVER (ORDER BY month) - 1 AS position FROM ({_MONTHLY})"


def pie_shares(spark, d):
    totals = _orders(spark, d).withColumn("priority", F.when(F.col("priority") != "5-LOW", F.col("priority"))).groupBy("priority").agg(
        F.round(F.sum("o_totalprice"), 2).alias("v")
    )
    return H.pie_shares(totals, "priority", "v").withColumn("pct", F.round("pct", 6))


PIE_SQL = """
WITH t AS (SELECT coalesce(nullif(o_orderpriority, '5-LOW'), 'Unknown') AS label, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1)
SELECT label, value, round(100.0 * value / (SELECT sum(value) FROM t), 6) AS pct FROM t"""


def dual_axis(spark, d):
    return H.dual_axis(_monthly(spark, d), ["revenue", "orders"])


DUAL_SQL = f"""
WITH m AS ({_MONTHLY}), p AS (SELECT 'revenue' AS measure, max(abs(revenue)) AS peak FROM m UNION ALL SELECT 'orders', max(orders)::DOUBLE FROM m)
SELECT measure, peak, CASE WHEN peak < (SELECT max(peak) FROM p) / 10 THEN 'right' ELSE 'left' END AS axis FROM p"""


def sparkline(spark, d):
    return H.sparkline(_monthly(spark, d), "orders", "month").select(F.col("at").alias("point"), "value", F.round("height", 6).alias("height"))


SPARK_SQL = f"""
WITH l AS (SELECT month AS point, orders::DOUBLE AS value FROM ({_MONTHLY}) ORDER BY month DESC LIMIT 16)
SELECT point, value, round((value - lo) / (hi - lo), 6) AS height FROM l, (SELECT least(0.0::DOUBLE, min(value)) AS lo, greatest(1.0::DOUBLE, max(value)) AS hi FROM l)"""


def infer_chart(spark, d):
    monthly = _monthly(spark, d)
    kpi = monthly.agg(F.sum("revenue").alias("revenue"))
    by_status = _orders(spark, d).groupBy("status").agg(F.sum("o_totalprice").alias("total"))
    out = None
    for df in (monthly, kpi, by_status):
        part = H.infer_chart(df).select("type", "title", F.coalesce("x", F.lit("")).alias("x"), F.array_join("y", ",").alias("y"), "grouped")
        out = part if out is None else out.unionByName(part)
    return out


INFER_SQL = """SELECT * FROM (VALUES ('line', 'Revenue by Month', 'month', 'revenue,orders', true), ('kpi', 'Key result', '', 'revenue', false),
 ('bar', 'Total by Status', 'status', 'total', false)) AS v(type, title, x, y, grouped) WHERE (SELECT count(*) FROM orders) > 3"""


# One chart specification per part.
_SPEC = ("CASE p_partkey % 4 WHEN 0 THEN 'line' WHEN 1 THEN 'pie' WHEN 2 THEN 'bar' ELSE 'area' END",
         "CASE p_size % 3 WHEN 0 THEN 'month' WHEN 1 THEN 'orders' ELSE lower(p_type) END",
         "CASE WHEN p_size % 2 = 0 THEN 'revenue' ELSE 'month' END")


def check_chart(spark, d):
    specs = table(spark, d, "part").selectExpr("p_partkey", f"{_SPEC[0]} AS type", f"{_SPEC[1]} AS x", f"array({_SPEC[2]}, 'orders') AS y")
    return H.check_charts(_monthly(spark, d), specs).select("p_partkey", F.array_join("problems", ";").alias("problems"))


CHECK_SQL = f"""WITH c AS (SELECT p_partkey, {_SPEC[0]} AS type, {_SPEC[1]} AS x, {_SPEC[2]} AS y, chr(39) AS q FROM part)
SELECT p_partkey, CASE WHEN x NOT IN ('month', 'orders') THEN concat('no column ', q, x, q) ELSE concat_ws(';', CASE WHEN y = 'month' THEN concat(q, y, q, ' is not numeric') END,
 CASE WHEN type = 'pie' AND (SELECT count(*) FROM ({_MONTHLY})) > 7 THEN 'too many slices' END,
 CASE WHEN type IN ('line', 'area') AND x = 'orders' THEN concat(q, x, q, ' is neither time nor number') END) END AS problems FROM c"""


def refresh_widget(spark, d):
    orders = _orders(spark, d)
    now = orders.agg(F.max("created_at").alias("t")).scalar()
    path = f"{checkpoint_dir(spark)}/widgets/recent_orders"
    return H.refresh_widget(orders, {"date_range": 365, "status": "O"}, path, ["o_orderkey"], now=now).select("o_orderkey", "o_totalprice")


def incremental(spark, d):
    """Events arrive in three files, of which one comes late and one is replaced; each refresh reads what is new."""
    events = table(spark, d, "events")
    base = f"{checkpoint_dir(spark)}/rollups/{uuid.uuid4().hex}"
    half = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    late = F.col("event_type") == "error"
    rollup = refresh.Rollup(f"{base}/rollup", "ts", ["event_type"], {
        "events": ("count", "event_id"), "total": ("sum", "value"), "lowest": ("min", "value"), "highest": ("max", "value"), "mean": ("avg", "value")})
    events.where(half).write.parquet(f"{base}/in/first")
    events.where(late).write.parquet(f"{base}/in/second")
    rollup.refresh(spark, f"{base}/in")
    events.where(~half & ~late).write.parquet(f"{base}/in/third")
    events.where(~half & late).write.mode("overwrite").parquet(f"{base}/in/second")
    rollup.refresh(spark, f"{base}/in")
    return rollup.result(spark).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("total", 4).alias("total"), "lowest", "highest", F.round("mean", 6).alias("mean"))


INCREMENTAL_SQL = """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, round(sum(value), 4) AS total, min(value) AS lowest,
max(value) AS highest, round(avg(value), 6) AS mean FROM events GROUP BY ALL"""


WIDGET_SQL = """SELECT o_orderkey, o_totalprice FROM orders
WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY AND o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 500"""


def compact_number(spark, d):
    return _monthly(spark, d).select(
        "month", H.compact_number(F.col("revenue"), currency=True).alias("revenue"), H.compact_number(F.col("orders").cast("double")).alias("orders"),
        H.compact_number(F.col("orders") / 100).alias("small"),
    )


COMPACT_NUMBER_SQL = f"""
SELECT month, CASE WHEN revenue >= 1e9 THEN printf('$%.1fB', revenue / 1e9) WHEN revenue >= 1e6 THEN printf('$%.1fM', revenue / 1e6)
 WHEN revenue >= 1e3 THEN printf('$%.0fK', revenue / 1e3) ELSE printf('$%d', revenue::BIGINT) END AS revenue,
 CASE WHEN orders >= 1e3 THEN printf('%.0fK', orders / 1e3) WHEN orders < 10 THEN printf('%.1f', orders::DOUBLE) ELSE orders::VARCHAR END AS orders,
 CASE WHEN orders >= 1000 THEN floor(orders / 100.0 + 0.5)::BIGINT::VARCHAR ELSE printf('%.1f', round(orders / 100.0::DOUBLE, 1)) END AS small FROM ({_MONTHLY})"""


def first_to_last(spark, d):
    out = H.first_to_last_change(_monthly(spark, d), ["revenue", "orders"], "month")
    return out.withColumn("change_pct", F.round("change_pct", 6))


CHANGE_SQL = f"""
WITH m AS ({_MONTHLY})
SELECT 'revenue' AS measure, arg_min(revenue, month) AS first, arg_max(revenue, month) AS last,
 round((arg_max(revenue, month) - arg_min(revenue, month)) * 100 / abs(arg_min(revenue, month)), 6) AS change_pct FROM m
UNION ALL SELECT 'orders', arg_min(orders, month)::DOUBLE, arg_max(orders, month)::DOUBLE,
 round((arg_max(orders, month) - arg_min(orders, month)) * 100.0::DOUBLE / arg_min(orders, month), 6) FROM m"""

QUERIES = {
    "H1_global_filters": (global_filters, FILTER_SQL),
    "H2_pivot_grouped": (pivot_grouped, PIVOT_SQL),
    "H3_compact_bars": (compact_bars, COMPACT_SQL),
    "H4_normalise": (normalise, NORMAL_SQL),
    "H5_chart_rows": (chart_rows, CHART_ROWS_SQL),
    "H6_sort_by_time": (sort_by_time, TIME_SQL),
    "H7_pie_shares": (pie_shares, PIE_SQL),
    "H8_dual_axis": (dual_axis, DUAL_SQL),
    "H9_sparkline": (sparkline, SPARK_SQL),
    "H10_infer_chart": (infer_chart, INFER_SQL),
    "H11_check_chart": (check_chart, CHECK_SQL),
    "H12_refresh_widget": (refresh_widget, WIDGET_SQL),
    "H12_incremental": (incremental, INCREMENTAL_SQL),
    "H13_compact_number": (compact_number, COMPACT_NUMBER_SQL),
    "H14_first_to_last_change": (first_to_last, CHANGE_SQL),
}
