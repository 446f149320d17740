"""As-of, range and interval joins over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import temporal
from plumbline.suite.tables import table

# Events of one month, stretched over the years of the orders.
_SHIFTED = "timestamp_seconds(788918400 + (unix_seconds(CAST(ts AS TIMESTAMP)) - 1704067200) * 80)"
_SHIFTED_SQL = "make_timestamp((788918400 + (epoch(date_trunc('second', ts))::BIGINT - 1704067200) * 80) * 1000000)"


def _events(spark, d):
    return table(spark, d, "events").selectExpr("event_id", "user_id", f"{_SHIFTED} AS moment")


_EVENTS = f"(SELECT event_id, user_id, {_SHIFTED_SQL} AS moment FROM events)"


def asof(spark, d):
    """Each event with the last order that its user had placed by then."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    out = temporal.asof_join(_events(spark, d), orders, "moment", "o_orderdate", by=[("user_id", "o_custkey")], tie="o_orderkey", bucket_rows=50)
    return out.select("event_id", "o_orderkey", "o_totalprice")


_LAST = "(SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey {}) = 1)"
ASOF = f"""SELECT event_id, o_orderkey, o_totalprice FROM {_EVENTS} e ASOF LEFT JOIN {_LAST.format("DESC")} o
ON e.user_id = o.o_custkey AND e.moment >= o.o_orderdate"""


def asof_forward(spark, d):
    """Each event with the next order of its user within ninety days."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    out = temporal.asof_join(_events(spark, d), orders, "moment", "o_orderdate", by=[("user_id", "o_custkey")], direction="forward", exact=False,
                             tolerance=90 * 86_400, tie="o_orderkey")
    return out.select("event_id", "o_orderkey")


ASOF_FORWARD = f"""SELECT event_id, CASE WHEN epoch_us(o_orderdate) - epoch_us(moment) <= 90 * 86400 * 1000000::BIGINT THEN o_orderkey END AS o_orderkey
FROM {_EVENTS} e ASOF LEFT JOIN {_LAST.format("DESC")} o ON e.user_id = o.o_custkey AND e.moment < o.o_orderdate"""


# An order is open for one to forty days, and for every fiftieth one a year or more.
_OPEN = "o_orderdate + make_dt_interval(CASE WHEN o_orderkey % 50 = 0 THEN CAST(365 + o_orderkey % 400 AS INT) ELSE CAST(1 + o_orderkey % 40 AS INT) END)"
_OPEN_SQL = "o_orderdate + to_days(CASE WHEN o_orderkey % 50 = 0 THEN (365 + o_orderkey % 400)::INT ELSE (1 + o_orderkey % 40)::INT END)"


def _open_orders(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey", "o_custkey", "o_orderdate AS since", f"{_OPEN} AS until")


_OPEN_ORDERS = f"(SELECT o_orderkey, o_custkey, o_orderdate AS since, {_OPEN_SQL} AS until FROM orders)"


def ranges(spark, d):
    """Orders that were open at each event, whoever placed them: their number and the sum of their keys."""
    found = temporal.range_join(_events(spark, d), _open_orders(spark, d), "moment", "since", "until", totals={"open_orders": None, "keys": "o_orderkey"})
    return found.groupBy("event_id").agg(F.sum("open_orders").alias("open_orders"), F.sum("keys").alias("keys"))


RANGES = f"""SELECT event_id, count(*) AS open_orders, sum(o_orderkey)::BIGINT AS keys FROM {_EVENTS} e
JOIN {_OPEN_ORDERS} o ON moment BETWEEN since AND until GROUP BY event_id"""


def ranges_by_key(spark, d):
    """Events inside an open order of the same user."""
    found = temporal.range_join(_events(spark, d), _open_orders(spark, d), "moment", "since", "until", by=[("user_id", "o_custkey")], half_open=True)
    return found.select("event_id", "o_orderkey")


RANGES_BY_KEY = f"SELECT event_id, o_orderkey FROM {_EVENTS} e JOIN {_OPEN_ORDERS} o ON user_id = o_custkey AND moment >= since AND moment < until"


def overlaps(spark, d):
    """Pairs of orders of one customer that were open at the same time."""
    orders = _open_orders(spark, d)
    found = temporal.overlap_join(orders, orders, ("since", "until"), ("since", "until"), by=["o_custkey"])
    return found.where("o_orderkey < o_orderkey_right").select("o_custkey", "o_orderkey", F.col("o_orderkey_right").alias("other"))


OVERLAPS = f"""SELECT a.o_custkey, a.o_orderkey, b.o_orderkey AS other FROM {_OPEN_ORDERS} a JOIN {_OPEN_ORDERS} b
ON a.o_custkey = b.o_custkey AND a.since <= b.until AND b.since <= a.until AND a.o_orderkey < b.o_orderkey"""

QUERIES = {
    "L4_asof": (asof, ASOF), "L4_asof_forward": (asof_forward, ASOF_FORWARD), "L4_range": (ranges, RANGES),
    "L4_range_by_key": (ranges_by_key, RANGES_BY_KEY), "L4_overlap": (overlaps, OVERLAPS),
}
