"""Metrics, filters, relationships and definitions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import definitions as D, match as X, metrics as M
from plumbline.suite.governance import META, QUESTIONS, annotated, questions, tokens_sql
from plumbline.suite.tables import table, union_all

NET = "SUM(lineitem.l_extendedprice * (1 - lineitem.l_discount))"
REVENUE = M.Metric(
    NET, ("lineitem", "orders", "customer"),
    (M.Relationship("lineitem", "l_orderkey", "orders", "o_orderkey"), M.Relationship("orders", "o_custkey", "customer", "c_custkey", "left")),
    (M.Filter("customer", (M.Condition("c_mktsegment", "in", ("BUILDING", "MACHINERY")), M.Condition("c_acctbal", "gt", 0))),
     M.Filter("orders", (M.Condition("o_orderstatus", "eq", "F"), M.Condition("o_orderstatus", "eq", "O")), "or")),
    M.DatePolicy("orders", "o_orderdate", "quarter"),
)


def _tables(s, d):
    return {t: table(s, d, t) for t in ("lineitem", "orders", "customer")}


# One definition per customer: what it adds up depends on the customer's nation, names come from the row.
_FORMS = [
    ("'SUM(orders.o_totalprice) / NULLIF(COUNT(*), 0)'", "", False), ("'SUM(orders.o_totalprice) / COUNT(*)'", "", True),
    ("concat('orders.', 'o_totalprice')", "metric_aggregation_required", False), ("'SUM(upper(orders.o_orderstatus))'", "metric_function_not_allowed", False),
    ("'SUM(o_totalprice)'", "metric_column_unqualified", False), ("concat('SUM(', lower(c_mktsegment), '.p_size)')", "metric_table_not_declared", False),
    ("concat('SUM(orders.', lower(c_mktsegment), ')')", "column_not_found", False), ("'SUM(orders.o_totalprice) OVER ()'", "unsafe_metric_expression", False),
    ("'SUM((SELECT 1))'", "unsafe_metric_expression", False), ("concat('SUM(orders.o_totalprice) -- ', c_name)", "unsafe_metric_expression", False),
    ("'SUM(*)'", "metric_wildcard_not_allowed", False), ("'SUM('", "invalid_metric_expression", False),
]


def _by_form(values) -> str:
    return "CASE c_nationkey % 12 " + " ".join(f"WHEN {n} THEN {v}" for n, v in enumerate(values)) + " END"


def k1(s, d):
    definitions = table(s, d, "customer").selectExpr("c_custkey", f"{_by_form(f for f, _, _ in _FORMS)} AS expression")
    judged = M.check_definitions(definitions, ("orders",), {"orders": table(s, d, "orders").columns})
    return judged.select("c_custkey", F.array_join(F.array_sort("errors"), ",").alias("errors"),
                         F.array_contains("warnings", "metric_division_by_zero").alias("may_divide"))


K1 = f"""SELECT c_custkey, {_by_form(f"'{e}'" for _, e, _ in _FORMS)} AS errors, {_by_form(f"{w}" for _, _, w in _FORMS)} AS may_divide FROM customer"""

_FROM = """FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0 AND (o_orderstatus = 'F' OR o_orderstatus = 'O')"""


def k2(s, d):
    return M.compute_metric(_tables(s, d), REVENUE).select(F.round("metric_value", 2).alias("metric_value"))


def k2_by(s, d):
    period = M.grain_column(REVENUE.date_policy, qualified=True)
    out = M.compute_metric(_tables(s, d), REVENUE, [F.date_format(period, "yyyy-MM-dd").alias("period"), F.col("customer.c_mktsegment").alias("segment")])
    return out.withColumn("metric_value", F.round("metric_value", 2))


_RULES = {
    "eq": ("c_mktsegment", "BUILDING", "c_mktsegment = 'BUILDING'"), "neq": ("c_mktsegment", "BUILDING", "c_mktsegment <> 'BUILDING'"),
    "in": ("c_nationkey", [1, 2, 3], "c_nationkey IN (1, 2, 3)"), "not_in": ("c_nationkey", [1, 2, 3], "c_nationkey NOT IN (1, 2, 3)"),
    "gt": ("c_acctbal", 100.0, "c_acctbal > 100"), "gte": ("c_acctbal", 100.0, "c_acctbal >= 100"), "lt": ("c_acctbal", 100.0, "c_acctbal < 100"),
    "lte": ("c_acctbal", 100.0, "c_acctbal <= 100"), "between": ("c_acctbal", [0.0, 500.0], "c_acctbal BETWEEN 0 AND 500"),
    "is_null": ("balance", None, "balance IS NULL"), "is_not_null": ("balance", None, "balance IS NOT NULL"),
    "contains": ("c_name", "00_1", "c_name LIKE '%00_1%'"), "starts_with": ("c_mktsegment", "M", "c_mktsegment LIKE 'M%'"),
    "ends_with": ("c_mktsegment", "E", "c_mktsegment LIKE '%E'"),
}
_CUST = "(SELECT *, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer)"


def _customer(s, d):
    return table(s, d, "customer").withColumn("balance", F.expr("CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END"))


def k3(s, d):
    cells = [
        F.struct(F.lit(op).alias("operator"), F.count_if(M.filter_column(M.Filter("customer", (M.Condition(c, op, v),)))).alias("n"))
        for op, (c, v, _) in _RULES.items()
    ]
    return _customer(s, d).agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


K3 = union_all(f"SELECT '{op}' AS operator, count(*) AS n FROM {_CUST} WHERE {sql}" for op, (_, _, sql) in _RULES.items())


# One condition per order: ``(column, value)`` as SQL expressions of its row.
_CONDITIONS = [
    ("'o_totalprice'", "CAST(o_totalprice AS STRING)"), ("'o_totalprice'", "concat(o_orderstatus, CAST(o_orderkey AS STRING))"),
    ("'o_orderdate'", "CAST(CAST(o_orderdate AS DATE) AS STRING)"), ("'o_orderdate'", "concat('1996-13-', CAST(10 + o_orderkey % 20 AS STRING))"),
    ("'o_orderstatus'", "o_orderstatus"), ("'o_orderdate'", "o_orderpriority"), ("'o_custkey'", "concat(' ', CAST(o_custkey AS STRING))"),
]


def _condition(part: int) -> str:
    return f"CASE o_orderkey % {len(_CONDITIONS)} " + " ".join(f"WHEN {n} THEN {c[part]}" for n, c in enumerate(_CONDITIONS)) + " END"


def k4(s, d):
    orders = table(s, d, "orders")
    asked = orders.selectExpr("o_orderkey", f"{_condition(0)} AS `column`", f"{_condition(1)} AS value")
    kinds = F.create_map(*[F.lit(x) for f in orders.schema for x in (f.name, f.dataType.simpleString())])
    fits = M.values_fit(F.array("value"), F.element_at(kinds, F.col("column")), F.lit("eq"))
    return asked.select("o_orderkey", "column", fits.alias("fits"))


K4 = f"""WITH c AS (SELECT o_orderkey, {_condition(0)} AS "column", {_condition(1)} AS value FROM orders)
SELECT o_orderkey, "column", CASE WHEN "column" IN ('o_totalprice', 'o_custkey') THEN try_cast(value AS DOUBLE) IS NOT NULL
 WHEN "column" = 'o_orderdate' THEN try_cast(value AS DATE) IS NOT NULL ELSE true END AS fits FROM c"""


def k5(s, d):
    return M.filter_impact(_customer(s, d), M.Filter("customer", (M.Condition("c_acctbal", "gt", 1000), M.Condition("balance", "is_not_null"))))


def k6(s, d):
    one = M.relationship_probe(table(s, d, "orders"), "o_custkey", table(s, d, "customer"), "c_custkey")
    two = M.relationship_probe(table(s, d, "documents"), "doc_id", table(s, d, "labels"), "doc_id")
    return one.withColumn("pair", F.lit("orders")).unionByName(two.withColumn("pair", F.lit("documents")))


def _probe_sql(pair, lt, lc, rt, rc):
    return f"""SELECT '{pair}' AS pair, (SELECT count({lc}) FROM {lt}) AS left_count, (SELECT count({rc}) FROM {rt}) AS right_count,
 (SELECT count(*) FROM {lt} l JOIN {rt} r ON l.{lc} = r.{rc}) AS matched_count,
 (SELECT count(*) FROM (SELECT 1 FROM {lt} GROUP BY {lc} HAVING count(*) > 1)) AS left_duplicate_keys,
 (SELECT count(*) FROM (SELECT 1 FROM {rt} GROUP BY {rc} HAVING count(*) > 1)) AS right_duplicate_keys"""


K6 = _probe_sql("orders", "orders", "o_custkey", "customer", "c_custkey") + " UNION ALL " + _probe_sql("documents", "documents", "doc_id", "labels", "doc_id")


def _dates(s, d):
    return table(s, d, "orders").withColumn("closed", F.expr("CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate END"))


def k7(s, d):
    out = M.date_probe(_dates(s, d), "closed")
    return out.select(F.date_format("minimum", "yyyy-MM-dd").alias("minimum"), F.date_format("maximum", "yyyy-MM-dd").alias("maximum"), "total_count", "null_count", "null_pct")


K7 = """SELECT strftime(min(c), '%Y-%m-%d') AS minimum, strftime(max(c), '%Y-%m-%d') AS maximum, count(*) AS total_count, count(*) - count(c) AS null_count,
 round(100.0 * (count(*) - count(c)) / count(*), 2) AS null_pct FROM (SELECT CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate END AS c FROM orders)"""

# Definitions derived from the part list: kinds, tables and columns by key.
DEF = {
    "id": "p_partkey",
    "kind": "CASE p_partkey % 7 WHEN 0 THEN 'table' WHEN 1 THEN 'column' WHEN 2 THEN 'dimension' WHEN 3 THEN 'filter' WHEN 4 THEN 'date_policy' WHEN 5 THEN 'entity' ELSE 'relationship' END",
    "key": "lower(replace(p_name, ' ', '_'))", "name": "p_name", "description": "concat(p_type, ' ', p_brand)",
    "table_name": "CASE p_partkey % 5 WHEN 0 THEN 'orders' WHEN 1 THEN 'customer' WHEN 2 THEN 'lineitem' WHEN 3 THEN 'events' ELSE 'archive' END",
    "column_name": "CASE p_partkey % 6 WHEN 0 THEN 'o_orderdate' WHEN 1 THEN 'c_name' WHEN 2 THEN 'l_orderkey' WHEN 3 THEN 'ts' WHEN 4 THEN 'o_custkey' ELSE 'event_id' END",
    "ref_table": "CASE WHEN p_partkey % 7 = 6 THEN CASE WHEN p_partkey % 3 = 0 THEN 'customer' ELSE 'orders' END END",
    "ref_column": "CASE WHEN p_partkey % 7 = 6 THEN CASE WHEN p_partkey % 3 = 0 THEN 'c_custkey' ELSE 'o_orderkey' END END",
    "classification": "CASE WHEN p_partkey % 2 = 0 THEN 'public' ELSE 'restricted' END",
    "status": "CASE WHEN p_partkey % 4 = 3 THEN 'draft' ELSE 'verified' END",
}
DEFS = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in DEF.items()) + ", p_brand, p_type FROM part)"


def definitions(s, d):
    df = table(s, d, "part").selectExpr(*[f"{e} AS {n}" for n, e in DEF.items()], "p_brand", "p_type")
    return df.withColumn("synonyms", F.array(F.concat(F.lit(" "), F.lower("p_brand")), "p_type"))


_J = f"""(SELECT d.*, a."column" IS NOT NULL AS have_a, b."column" IS NOT NULL AS have_b, a.sensitive AS a_sensitive, a.is_key AS a_key, a.dtype AS a_dtype, b.dtype AS b_dtype,
 a.meaning AS a_meaning, d.table_name IN (SELECT "table" FROM {META}) AS have_table, d.ref_table IN (SELECT "table" FROM {META}) AS have_ref,
 coalesce(a.ref = d.ref_table, false) OR coalesce(b.ref = d.table_name, false) AS physical
 FROM {DEFS} d LEFT JOIN {META} a ON a."table" = d.table_name AND a."column" = d.column_name LEFT JOIN {META} b ON b."table" = d.ref_table AND b."column" = d.ref_column)"""
_CHECKS = [
    ("error", "table_not_found", "NOT have_table OR (kind = 'relationship' AND NOT have_ref)"),
    ("error", "column_not_found", "kind <> 'table' AND have_table AND NOT have_a"),
    ("error", "column_not_found_right", "kind = 'relationship' AND have_ref AND NOT have_b"),
    ("error", "sensitivity_cannot_be_weakened", "kind = 'column' AND a_sensitive AND classification = 'public'"),
    ("error", "sensitive_dimension", "kind = 'dimension' AND a_sensitive"),
    ("error", "sensitive_filter", "kind = 'filter' AND a_sensitive"),
    ("error", "date_column_required", "kind = 'date_policy' AND have_a AND NOT (a_dtype LIKE '%time%' OR a_meaning IN ('date', 'datetime'))"),
    ("warning", "entity_key_not_physical_pk", "kind = 'entity' AND have_a AND NOT a_key"),
    ("warning", "relationship_type_mismatch", "kind = 'relationship' AND have_a AND have_b AND a_dtype <> b_dtype"),
    ("warning", "relationship_not_physical_fk", "kind = 'relationship' AND have_table AND NOT physical"),
]
K8 = " UNION ALL ".join(f"SELECT id, '{lv}' AS level, '{code}' AS code FROM {_J} WHERE {rule}" for lv, code, rule in _CHECKS)


def k8(s, d):
    return D.structural_findings(definitions(s, d), annotated(s, d))


def k9(s, d):
    return D.drift_counts(definitions(s, d), annotated(s, d))


K9 = f"""SELECT count(*) FILTER (id NOT IN (SELECT id FROM ({K8}) WHERE level = 'error')) AS valid,
 count(*) FILTER (id IN (SELECT id FROM ({K8}) WHERE level = 'error')) AS stale FROM {DEFS} WHERE status = 'verified'"""

KNOWN = [
    ("metric", "net_revenue", ["net revenue", "turnover"], [""], "money earned from orders after discount", 180),
    ("table", "orders", ["order list"], ["orders"], "orders of a customer with price and status", 90),
    ("column", "o_totalprice", ["order value"], ["orders", "o_totalprice"], "total price of one order", 75),
    ("entity", "supplier", ["vendor"], [""], "supplier with account balance", 60),
    ("dimension", "brand", ["brand#1", "make"], [""], "brand of a part", 55),
    ("synonym", "sales", ["purchase"], [""], "events of type purchase", 40),
]


def _known(s):
    return s.createDataFrame(KNOWN, "kind string, key string, phrases array<string>, physical array<string>, description string, size long")


def k10(s, d):
    return X.match_definitions(questions(s, d), _known(s)).select("question_id", "kind", "key", "score")


def _sql_list(items):
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


_KNOWN_SQL = "(VALUES " + ", ".join(
    f"('{k}', '{key}', {_sql_list(ph)}, {_sql_list(phys)}, '{desc}')" for k, key, ph, phys, desc, _ in KNOWN
) + ") AS k(kind, key, phrases, physical, description)"
K10 = f"""SELECT question_id, kind, key, CASE WHEN named THEN greatest(spoken, 80) ELSE spoken END::BIGINT AS score FROM
 (SELECT question_id, kind, key, CASE WHEN len(list_filter(phrases, lambda p: p <> '' AND contains(lower(text), p))) > 0 THEN 100
   ELSE 10 * len(list_intersect({tokens_sql('text')}, {tokens_sql('description')})) END AS spoken,
  kind IN ('table', 'column') AND len(list_filter(physical, lambda p: p <> '' AND contains(lower(text), p))) > 0 AS named FROM {QUESTIONS}, {_KNOWN_SQL})
WHERE spoken > 0 OR named"""


def k10_budget(s, d):
    return X.within_budget(X.match_definitions(questions(s, d), _known(s)), 2, 150).select("question_id", "rank", "key", "score")


def k11(s, d):
    hits, total = D.search(definitions(s, d), "Ring", page=2, size=30)
    return hits.select("id", "kind", "key").withColumn("total", total.scalar())


K11 = f"""SELECT id, kind, key, (SELECT count(*) FROM {DEFS} WHERE concat(key, '|', name, '|', description) ILIKE '%ring%') AS total FROM {DEFS}
WHERE key ILIKE '%ring%' OR name ILIKE '%ring%' OR description ILIKE '%ring%' ORDER BY key, id LIMIT 30 OFFSET 30"""


def k12(s, d):
    out = None
    for grain in sorted(M.GRAINS):
        period = M.grain_column(M.DatePolicy("events", "ts", grain, "Asia/Kolkata"))
        part = table(s, d, "events").groupBy(F.date_format(period, "yyyy-MM-dd").alias("period")).agg(F.count("*").alias("n"))
        part = part.select(F.lit(grain).alias("grain"), "period", "n")
        out = part if out is None else out.unionByName(part)
    return out


K12 = " UNION ALL ".join(
    f"SELECT '{g}' AS grain, strftime(date_trunc('{g}', ts + INTERVAL 330 MINUTE), '%Y-%m-%d') AS period, count(*) AS n FROM events GROUP BY 2" for g in sorted(M.GRAINS)
)


def k13(s, d):
    probe = M.relationship_probe(table(s, d, "orders"), "o_custkey", table(s, d, "customer"), "c_custkey")
    out = None
    for c in ("one_to_one", "one_to_many", "many_to_one"):
        part = M.check_cardinality(probe, c).select("declared", F.coalesce("warning", F.lit("")).alias("warning"), "left_duplicate_keys")
        out = part if out is None else out.unionByName(part)
    return out


K13 = """SELECT declared, CASE WHEN declared <> 'many_to_one' AND n > 0 THEN 'cardinality_mismatch' ELSE '' END AS warning, n AS left_duplicate_keys
FROM (SELECT count(*) AS n FROM (SELECT 1 FROM orders GROUP BY o_custkey HAVING count(*) > 1)), (VALUES ('one_to_one'), ('one_to_many'), ('many_to_one')) AS v(declared)"""


def k14(s, d):
    orders = table(s, d, "orders")
    old = orders.groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("metric_value"))
    new = orders.filter("o_custkey % 5 <> 0 OR o_orderpriority = '5-LOW'").groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("metric_value"))
    return M.change_warning(old, new, ["o_orderpriority"]).select("o_orderpriority", "old_value", "new_value", F.round("change", 8).alias("change"), "warning")


K14 = """WITH c AS (SELECT o_orderpriority, round(sum(o_totalprice), 2) AS old_value,
 round(sum(o_totalprice) FILTER (o_custkey % 5 <> 0 OR o_orderpriority = '5-LOW'), 2) AS new_value FROM orders GROUP BY 1)
SELECT *, round(abs(new_value - old_value) / greatest(abs(old_value), 1), 8) AS change,
 CASE WHEN abs(new_value - old_value) / greatest(abs(old_value), 1) >= 0.2 THEN 'large_change' END AS warning FROM c"""


def k15(s, d):
    return M.date_probe(_dates(s, d), "closed").select("null_pct").unionByName(M.date_probe(_dates(s, d).filter("o_orderkey < 0"), "closed").select("null_pct"))


K15 = """SELECT round(100.0 * count(*) FILTER (o_orderkey % 6 = 0) / count(*), 2) AS null_pct FROM orders UNION ALL SELECT 0.0::DOUBLE"""


def k16(s, d):
    return D.ambiguous_synonyms(definitions(s, d))


K16 = f"""SELECT kind, phrase, count(DISTINCT id) AS targets FROM (SELECT kind, id, lower(p_brand) AS phrase FROM {DEFS} UNION ALL SELECT kind, id, lower(p_type) FROM {DEFS})
GROUP BY 1, 2 HAVING count(DISTINCT id) > 1"""

QUERIES = {
    "K1_check_metric": (k1, K1), "K2_compute_metric": (k2, f"SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS metric_value {_FROM}"),
    "K2_metric_by_period": (k2_by, f"SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS period, c_mktsegment AS segment, round(sum(l_extendedprice * (1 - l_discount)), 2) AS metric_value {_FROM} GROUP BY 1, 2"),
    "K3_filter_operators": (k3, K3), "K4_value_types": (k4, K4),
    "K5_filter_impact": (k5, f"SELECT count(*) AS before_count, count(*) FILTER (c_acctbal > 1000 AND balance IS NOT NULL) AS after_count FROM {_CUST}"),
    "K6_relationship_probe": (k6, K6), "K7_date_probe": (k7, K7), "K8_structural_findings": (k8, K8), "K9_drift_counts": (k9, K9),
    "K10_match_definitions": (k10, K10), "K10_within_budget": (k10_budget, None), "K11_search_definitions": (k11, K11), "K12_grains": (k12, K12),
    "K13_cardinality": (k13, K13), "K14_change_warning": (k14, K14), "K15_null_share": (k15, K15), "K16_ambiguous_synonyms": (k16, K16),
}
