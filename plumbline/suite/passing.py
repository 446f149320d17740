"""SQL handed to Spark as it is, after the read-only checks: one statement per category.

Both engines run the same text unless a function has another name.
"""

from __future__ import annotations

from plumbline.plans import runner
from plumbline.suite.tables import table

SQL = {
    "L1_filter_cte_subquery": (["orders", "customer"], """
        WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders))
        SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM big JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment"""),
    "L2_joins": (["supplier", "nation", "region", "customer"], """
        SELECT r.r_name, n.n_name, count(DISTINCT s.s_suppkey) AS suppliers, count(DISTINCT c.c_custkey) AS customers
        FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey
        LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 5000 GROUP BY r.r_name, n.n_name"""),
    "L3_semi_anti": (["customer", "orders"], """
        SELECT c_custkey, EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderstatus = 'F') AS has_finished FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)"""),
    "L5_having_filter_distinct": (["lineitem"], """
        SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(*) FILTER (WHERE l_returnflag = 'R') AS returned FROM lineitem
        GROUP BY l_suppkey HAVING count(*) > 5"""),
    "L6_grouping_sets": (["lineitem"], """
        SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, CAST(grouping(l_returnflag) AS INT) AS g FROM lineitem
        GROUP BY CUBE (l_returnflag, l_linestatus)"""),
    "L7_windows": (["orders"], """
        SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place,
        round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS change FROM orders"""),
    "L8_top_k": (["lineitem"], "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25 OFFSET 5"),
    "L9_set_operations": (["orders", "customer"], """
        SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders
        UNION ALL (SELECT c_custkey FROM customer WHERE c_acctbal < 0 INTERSECT SELECT o_custkey FROM orders)"""),
    "L10_functions": (["customer"], """
        SELECT c_custkey, upper(substr(c_mktsegment, 1, 3)) AS code, abs(round(c_acctbal)) AS rounded, coalesce(nullif(c_nationkey, 0), -1) AS nation,
        length(concat(c_name, '-', c_mktsegment)) AS size, CAST(c_acctbal AS DECIMAL(12, 1)) AS tenths FROM customer"""),
}


# Views whose rows a statement's joins multiply, and the key they are dealt over all cores by: read from one small
# file they would be one task, and so would all rows that meet them. The statement and the rows stay as they are.
DEALT = {"L2_joins": {"nation": "n_nationkey"}}


def _query(names, sql, dealt=None):
    def view(spark, d, name):
        rows = table(spark, d, name)
        return rows.repartition(4 * spark.sparkContext.defaultParallelism, dealt[name]) if name in (dealt or {}) else rows

    return lambda spark, d: runner.statement(spark, sql, {n: view(spark, d, n) for n in names})


QUERIES = {name: (_query(names, sql, DEALT.get(name)), sql) for name, (names, sql) in SQL.items()}

# Statements that call functions registered by ``functions.tables``, with what they mean in plain SQL.
_SESSIONS = """SELECT user_id, date_format(first_seen, 'yyyy-MM-dd HH:mm:ss') AS first_seen, date_format(last_seen, 'yyyy-MM-dd HH:mm:ss') AS last_seen, events
 FROM sessions(TABLE(SELECT user_id, ts FROM events), 21600)"""
_SESSIONS_SQL = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, count(*) AS events FROM s GROUP BY user_id, n"""
_STATES = """WITH parts AS (SELECT event_type, user_id, moments_of(count(value), avg(value), var_pop(value)) AS state FROM events GROUP BY event_type, user_id),
 merged AS (SELECT event_type, merge_moments(collect_list(state)) AS state FROM parts GROUP BY event_type)
SELECT event_type, state.n AS n, round(state.mean, 6) AS mean, round(moments_std(state), 6) AS std FROM merged"""
_STATES_SQL = "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY event_type"

QUERIES["L11_table_function"] = (_query(["events"], _SESSIONS), _SESSIONS_SQL)
QUERIES["L11_mergeable_states"] = (_query(["events"], _STATES), _STATES_SQL)
