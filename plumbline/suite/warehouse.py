"""Reporting views over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import views as W
from plumbline.suite.tables import table


def w1(s, d):
    return W.order_summary(*(table(s, d, t) for t in ("orders", "customer", "nation", "lineitem")))


W1 = """SELECT o_orderkey, c_name || ' / ' || n_name AS customer, o_orderstatus, coalesce(i.items, 0) AS items, coalesce(round(i.net, 2)::DOUBLE, 0) AS net
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN (SELECT l_orderkey, count(*) AS items, sum(l_extendedprice::DECIMAL(15, 2) * (1 - l_discount::DECIMAL(15, 2))) AS net FROM lineitem GROUP BY 1) i ON l_orderkey = o_orderkey"""


def w2(s, d):
    return W.product_performance(table(s, d, "part"), table(s, d, "lineitem"))


W2 = """SELECT p_partkey, p_brand, coalesce(units, 0) AS units, coalesce(round(revenue, 2), 0) AS revenue, coalesce(orders, 0) AS orders,
 coalesce(returns, 0) AS returns, round(return_discount, 8) AS return_discount, round((revenue - units * p_retailprice) * 100 / revenue, 2) AS margin_pct
FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS units, sum(l_extendedprice) AS revenue, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1) a ON a.l_partkey = p_partkey
LEFT JOIN (SELECT l_partkey, count(*) AS returns, avg(l_discount) AS return_discount FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b ON b.l_partkey = p_partkey"""


def w3(s, d):
    people = table(s, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS team", "CASE WHEN c_custkey > 9 THEN c_custkey div 10 END AS manager_id")
    orders = table(s, d, "orders")
    work = orders.selectExpr("o_custkey AS person_id", "o_totalprice AS value", "o_orderdate AS at")
    return W.people_summary(people, work, orders.agg(F.max("o_orderdate").alias("t")).scalar())


W3 = """WITH p AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS team, CASE WHEN c_custkey > 9 THEN c_custkey // 10 END AS manager_id FROM customer),
 w AS (SELECT o_custkey AS id, avg(o_totalprice) AS mean_value, count(DISTINCT o_orderdate) AS days, min(o_orderdate) AS first FROM orders GROUP BY 1)
SELECT p.id, p.name, p.team, m.name AS manager, round(mean_value, 6) AS mean_value, coalesce(days, 0) AS days,
 datesub('year', first, (SELECT max(o_orderdate) FROM orders)) AS years FROM p LEFT JOIN p m ON m.id = p.manager_id LEFT JOIN w ON w.id = p.id"""


def w4(s, d):
    tickets = table(s, d, "events").selectExpr("ts AS at", "event_type AS kind", "value")
    return W.weekly_support(tickets).withColumn("week", F.date_format("week", "yyyy-MM-dd"))


W4 = """SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, count(*) AS tickets, count(*) FILTER (event_type = 'error') AS failed,
 count(*) FILTER (event_type = 'purchase') AS purchases, round(avg(value) FILTER (event_type <> 'error'), 4) AS mean_closed FROM events GROUP BY 1"""


def w5(s, d):
    return W.monthly_revenue(table(s, d, "orders")).withColumn("month", F.date_format("month", "yyyy-MM"))


W5 = """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_custkey) AS customers,
 round(sum(o_totalprice), 2) AS revenue, round(avg(o_totalprice), 6) AS mean_order, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders GROUP BY 1"""


def w6(s, d):
    return W.inventory_status(*(table(s, d, t) for t in ("lineitem", "part", "supplier", "nation")))


W6 = """SELECT p_partkey, s_suppkey, n_name, units, CASE WHEN units <= 10 THEN 'low' WHEN units <= 40 THEN 'normal' ELSE 'high' END AS level
FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS units FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = l_partkey
JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey"""


def w7(s, d):
    return W.lifetime_value(table(s, d, "customer"), table(s, d, "orders"), ["F"])


W7 = """SELECT c_custkey, v AS value, CASE WHEN v >= 2000000 THEN 'platinum' WHEN v >= 1000000 THEN 'gold' WHEN v >= 250000 THEN 'silver' ELSE 'bronze' END AS tier
FROM (SELECT c_custkey, coalesce((SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus NOT IN ('F')), 0) AS v FROM customer)"""


def w8(s, d):
    options = [r[0] for r in table(s, d, "nation").select("n_nationkey").orderBy("n_nationkey").limit(1000).collect()]
    return W.sample_pairs(table(s, d, "orders"), "o_orderkey", options, 8)


W8 = "SELECT o_orderkey, n_nationkey AS option FROM orders, nation WHERE (o_orderkey * 7919 + n_nationkey * 104729) % 100 < 8"

QUERIES = {
    "W1_order_summary": (w1, W1), "W2_product_performance": (w2, W2), "W3_people_summary": (w3, W3), "W4_weekly_support": (w4, W4),
    "W5_monthly_revenue": (w5, W5), "W6_inventory_status": (w6, W6), "W7_lifetime_value": (w7, W7), "W8_sample_pairs": (w8, W8),
}
