"""Catalog, guarded queries and text rules over the given tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from plumbline.functions import text as T
from plumbline.operators import catalog as G, match as X, sketches
from plumbline.plans import guard, runner
from plumbline.session import checkpoint_dir
from plumbline.suite.tables import table, union_all

NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
        "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id"}
FOREIGN = {("nation", "n_regionkey"): ("region", "r_regionkey"), ("customer", "c_nationkey"): ("nation", "n_nationkey"),
           ("supplier", "s_nationkey"): ("nation", "n_nationkey"), ("orders", "o_custkey"): ("customer", "c_custkey"),
           ("lineitem", "l_orderkey"): ("orders", "o_orderkey"), ("lineitem", "l_partkey"): ("part", "p_partkey"),
           ("lineitem", "l_suppkey"): ("supplier", "s_suppkey"), ("labels", "doc_id"): ("documents", "doc_id")}


QUESTION = """CASE p_partkey % 6 WHEN 0 THEN concat('Show net revenue by customer and month for ', p_brand)
 WHEN 1 THEN concat('Which lineitem prices fit the part size ', p_name) WHEN 2 THEN 'List supplier accounts and balances'
 WHEN 3 THEN concat('events per user over time of type ', p_type) WHEN 4 THEN concat('How many documents have source ', CAST(p_size AS STRING))
 ELSE concat('orders with high o_totalprice, ', p_name) END"""
QUESTIONS = f"(SELECT p_partkey AS question_id, {QUESTION} AS text FROM part)"


def questions(s, d):
    return table(s, d, "part").selectExpr("p_partkey AS question_id", f"{QUESTION} AS text")


def tokens_sql(text: str) -> str:
    words = f"regexp_extract_all(lower({text}), '[a-z0-9]+')"
    one = ("CASE WHEN w IN (" + ", ".join(f"'{t}'" for t in X.KEPT_TERMS) + ") THEN w WHEN w LIKE '%ies' AND length(w) > 4 THEN w[:-4] || 'y' "
           "WHEN w LIKE '%es' AND length(w) > 3 THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' AND length(w) > 3 THEN w[:-2] ELSE w END")
    return f"list_distinct(list_concat({words}, list_transform({words}, lambda w: {one})))"


def frames(s, d):
    return {t: table(s, d, t) for t in NAMES}


def extracted(s, d):
    return G.extract(s, frames(s, d), KEYS, FOREIGN)


def annotated(s, d):
    return G.annotate(extracted(s, d))


# The catalog as DuckDB describes it, with types renamed to Spark's names.
_LIST = ", ".join(f"'{t}'" for t in NAMES)
_KEY_SQL = " OR ".join(f"(table_name = '{t}' AND column_name = '{c}')" for t, c in KEYS.items())
_REF = lambda i: "CASE " + " ".join(f"WHEN table_name = '{t}' AND column_name = '{c}' THEN '{r[i]}'" for (t, c), r in FOREIGN.items()) + " END"
CATALOG = f"""(SELECT table_name AS "table", (column_index - 1)::INTEGER AS ordinal, column_name AS "column",
 CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' ELSE lower(data_type) END AS dtype,
 coalesce({_KEY_SQL}, false) AS is_key, {_REF(0)} AS ref_table, {_REF(1)} AS ref_column FROM duckdb_columns() WHERE table_name IN ({_LIST}))"""
_R = G.SEMANTIC_RULES
_TEXT, _NUM = f"regexp_matches(dtype, '{_R['text_type']}')", f"regexp_matches(dtype, '{_R['numeric_type']}')"
_MEANING = f"""CASE WHEN "column" LIKE '%email%' THEN 'email' WHEN regexp_matches("column", '{_R['phone_name']}') THEN 'phone'
 WHEN regexp_matches("column", '{_R['person_name']}') THEN 'name' WHEN regexp_matches("column", '{_R['money_name']}') AND {_NUM} THEN 'money'
 WHEN regexp_matches("column", '{_R['date_name']}') THEN CASE WHEN dtype LIKE '%timestamp%' OR "column" LIKE '%\\_at%' ESCAPE '\\' THEN 'datetime' ELSE 'date' END
 WHEN regexp_matches("column", '{_R['category_name']}') AND {_TEXT} THEN 'category' WHEN dtype LIKE '%bool%' THEN 'boolean' WHEN dtype LIKE '%json%' THEN 'json'
 WHEN {_NUM} THEN CASE WHEN "column" LIKE '%count%' OR "column" LIKE '%qty%' THEN 'quantity' ELSE 'numeric' END
 WHEN {_TEXT} THEN CASE WHEN length("column") <= 4 OR "column" LIKE '%\\_id' ESCAPE '\\' THEN 'identifier' ELSE 'free_text' END ELSE 'unknown' END"""
_SENS = f"""(meaning IN ('email', 'phone', 'name', 'address', 'free_text') OR regexp_matches("column", '(?:^|_)(?:{"|".join(G.SENSITIVE_NAMES)})(?:$|_)')
 OR (meaning = 'identifier' AND regexp_matches("column", '{G.OPAQUE_ID_WORDS}')))"""
_COUNTS = "(" + " UNION ALL ".join(f"SELECT '{t}' AS tn, count(*) AS rows FROM {t}" for t in NAMES) + ")"
META = f"""(SELECT *, {_SENS} AS sensitive, ref_table AS ref, regexp_matches("table", '{G.INTERNAL_NAMES}') AS internal
 FROM (SELECT *, {_MEANING} AS meaning FROM {CATALOG}) JOIN {_COUNTS} ON tn = "table")"""


def g1(s, d):
    for name, df in frames(s, d).items():
        df.createOrReplaceTempView(name)
    listed = G.list_tables(s).filter(F.col("is_temporary") & F.col("table").isin(NAMES)).select("table").distinct()
    counts = None
    for name in NAMES:
        part = s.table(name).agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        counts = part if counts is None else counts.unionByName(part)
    return listed.join(counts, "table")


def g2(s, d):
    return extracted(s, d).select("table", "ordinal", "column", "dtype", "is_key", "ref_table", "ref_column", "rows")


def g3(s, d):
    parts = [
        G.enum_samples(table(s, d, t)).select(F.lit(t).alias("table"), "column", F.array_join("values", ",").alias("values"))
        for t in ("orders", "events", "documents", "part", "conversations")
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


G3 = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) <= 15 THEN string_agg(DISTINCT {c}, ',' ORDER BY {c}) END AS values FROM {t}"
    for t, c in (("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("events", "event_type"), ("documents", "source"), ("part", "p_type"), ("conversations", "role"))
) + ") WHERE values IS NOT NULL"


def g4(s, d):
    return annotated(s, d).select("table", "column", "semantic_type", "is_sensitive", "rows")


def g6(s, d):
    return G.importance(annotated(s, d))


G6 = f"""SELECT m."table", any_value(rows) AS rows, bool_or(internal) AS is_internal, CASE WHEN bool_or(internal) THEN 0 ELSE
 round(0.6 * least(any_value(coalesce(n, 0)) / 10, 1) + 0.4 * least(log10(any_value(rows) + 1) / 6, 1), 3) END::DOUBLE AS importance
FROM {META} m LEFT JOIN (SELECT t, count(*) AS n FROM (SELECT "table" AS t FROM {CATALOG} WHERE ref_table IS NOT NULL UNION ALL SELECT ref_table FROM {CATALOG} WHERE ref_table IS NOT NULL) GROUP BY 1) ON t = m."table" GROUP BY 1"""


def g7(s, d):
    return G.schema_hash(extracted(s, d))


G7 = f"""SELECT substr(sha256(string_agg(line, chr(10) ORDER BY line)), 1, 16) AS hash FROM (
 SELECT concat("table", ':', "column", ':', dtype, ':', CASE WHEN is_key THEN 'true' ELSE 'false' END) AS line FROM {CATALOG}
 UNION ALL SELECT concat('fk:', "table", ':', "column", '->', ref_table, '.', ref_column) FROM {CATALOG} WHERE ref_table IS NOT NULL)"""


def g8(s, d):
    notes = annotated(s, d)
    terms = X.catalog_terms(notes, G.importance(notes))
    return X.search_schema(questions(s, d), terms).select("question_id", "rank", "table", "score")


def g8_sql() -> str:
    groups = "[" + ", ".join("[" + ", ".join(f"'{w}'" for w in [h, *o]) + "]" for h, o in X.SYNONYMS.items()) + "]"
    return f"""
WITH g AS (SELECT {groups} AS groups),
 q AS (SELECT question_id, lower(text) AS ql, {tokens_sql('text')} AS tk FROM {QUESTIONS}),
 qt AS (SELECT question_id, ql, list_distinct(list_concat(tk, flatten(list_filter(groups, lambda x: list_has_any(x, tk))))) AS terms, groups FROM q, g),
 c AS (SELECT m."table" AS t, {tokens_sql('m."table"')} AS words, list({{'w': {tokens_sql('"column"')}, 's': meaning}}) AS entries, any_value(imp.importance) AS importance, bool_or(internal) AS internal
   FROM {META} m JOIN ({G6}) imp ON imp."table" = m."table" GROUP BY 1, 2),
 x AS (SELECT question_id, t, importance, internal, CASE WHEN contains(ql, t) THEN 3.0 ELSE 0.0 END + 1.5 * len(list_intersect(terms, words))
   + len(list_filter(entries, lambda e: list_has_any(terms, e.w))) + 0.5 * len(list_filter(entries, lambda e: e.s <> 'unknown' AND list_contains(terms, e.s)))
   + len(list_filter(groups, lambda x: list_has_any(x, terms) AND list_has_any(x, words))) AS lexical FROM qt, c),
 y AS (SELECT question_id, t AS "table", round(lexical::DOUBLE + 0.5::DOUBLE * importance - CASE WHEN internal THEN 2.0 ELSE 0.0 END, 2) AS score FROM x WHERE lexical > 0)
SELECT question_id, rank, "table", score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, "table")::INTEGER AS rank FROM y WHERE score > 0) WHERE rank <= 8"""


def g9(s, d):
    names = extracted(s, d).select(F.col("column").alias("name")).unionByName(extracted(s, d).select(F.col("table").alias("name"))).distinct()
    return X.ground(questions(s, d), names)


def g9_sql() -> str:
    return f"""
WITH n AS (SELECT DISTINCT name, {tokens_sql('name')} AS words FROM (SELECT "column" AS name FROM {CATALOG} UNION ALL SELECT "table" FROM {CATALOG})),
 q AS (SELECT question_id, ' ' || regexp_replace(lower(text), '[^a-z0-9_]+', ' ', 'g') || ' ' AS ql, {tokens_sql('text')} AS tk FROM {QUESTIONS})
SELECT question_id, name, CASE WHEN contains(ql, ' ' || name || ' ') THEN 'phrase' ELSE 'token' END AS how FROM q, n
WHERE contains(ql, ' ' || name || ' ') OR list_has_any(tk, words)"""


# A catalog with a table per part: names and types of its columns, in order, as expressions of the part.
_PART_COLUMNS = [
    ("'id'", "'bigint'"), ("concat('x_', CAST(p_size AS STRING))", "CASE WHEN p_partkey % 5 = 0 THEN 'string' ELSE 'date' END"),
    ("CASE p_size % 3 WHEN 0 THEN 'created_on' WHEN 1 THEN 'placed_at' ELSE 'updated_on' END", "'timestamp'"),
    ("CASE WHEN p_partkey % 2 = 0 THEN 'Order_Date' ELSE 'note' END", "'string'"),
]


def g10(s, d):
    cells = ", ".join(f"struct({n} AS ordinal, {c} AS `column`, {t} AS dtype)" for n, (c, t) in enumerate(_PART_COLUMNS))
    made = table(s, d, "part").selectExpr("concat('part_', CAST(p_partkey AS STRING)) AS `table`", f"inline(array({cells}))")
    both = made.unionByName(annotated(s, d).select("table", "ordinal", "column", "dtype"))
    return G.default_date_column(both.withColumn("semantic_type", G.semantic_type()))


G10 = f"""SELECT 'part_' || p_partkey AS "table", CASE WHEN p_size % 3 < 2 THEN {_PART_COLUMNS[2][0]} WHEN p_partkey % 2 = 0 THEN 'Order_Date'
 WHEN p_partkey % 5 <> 0 THEN 'x_' || p_size ELSE 'updated_on' END AS date_column FROM part
UNION ALL SELECT * FROM (VALUES ('orders', 'o_orderdate'), ('lineitem', 'l_shipdate'), ('events', 'ts')) AS v(t, c)"""


def g11(s, d):
    out = G.preview(table(s, d, "customer"), annotated(s, d), "customer", "c_custkey")
    return out.withColumn("columns", F.lit(",".join(out.columns)))


def g12(s, d):
    few = G.sample_values(table(s, d, "orders"), "o_orderpriority").select(F.lit("priority").alias("kind"), "value")
    many = G.sample_values(table(s, d, "documents"), "source").select(F.lit("source").alias("kind"), "value")
    return few.unionByName(many)


def g13(s, d):
    return G.quick_profile(table(s, d, "orders"))


G13 = union_all(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS count, count(DISTINCT {c}) AS \"distinct\" FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
)


def g14(s, d):
    part = table(s, d, "part")
    both = G.filtered_count(part, [("p_name", "ilike", "%RING%"), ("p_size", ">=", 10), ("p_brand", "is_not_null")])
    either = G.filtered_count(part, [("p_type", "=", "ECONOMY"), ("p_retailprice", "<", 950.0)], any_of=True)
    return both.select(F.lit("and").alias("mode"), "n").unionByName(either.select(F.lit("or").alias("mode"), "n"))


def g15(s, d):
    from plumbline.functions.order import number_rows

    ranked = number_rows(G.importance(annotated(s, d)), [F.col("is_internal").asc(), F.desc("importance"), F.col("table").asc()])
    return ranked.select("position", "table", "importance")


def g15_describe(s, d):
    return G.describe(annotated(s, d), "orders").withColumn("rows", table(s, d, "orders").agg(F.count("*").alias("n")).scalar())


# References as table rows: every line of an order points at one of 50 part groups, every part group at an order.
_LINKS = """SELECT concat('order_', CAST(l_orderkey AS STRING)) AS source, concat('line_', CAST(l_linenumber AS STRING)) AS source_column,
 concat('group_', CAST(l_partkey % 50 AS STRING)) AS target FROM lineitem
UNION ALL SELECT concat('group_', CAST(p_partkey % 50 AS STRING)), concat('part_', CAST(p_partkey AS STRING)), concat('order_', CAST(p_size AS STRING)) FROM part"""


def g16(s, d):
    made = runner.statement(s, _LINKS, {t: table(s, d, t) for t in ("lineitem", "part")}).select(
        F.col("source").alias("table"), F.col("source_column").alias("column"), F.col("target").alias("ref_table"), F.lit("id").alias("ref_column"))
    both = made.unionByName(annotated(s, d).select("table", "column", "ref_table", "ref_column"))
    return G.relationships(both, "group_7").unionByName(G.relationships(both, "orders"))


G16 = f"""WITH e AS (SELECT source, source_column, target, 'id' AS target_column FROM ({_LINKS})
 UNION ALL SELECT "table", "column", ref_table, ref_column FROM {CATALOG} WHERE ref_table IS NOT NULL)
SELECT 'outbound' AS direction, * FROM e WHERE source IN ('group_7', 'orders') UNION ALL SELECT 'inbound', * FROM e WHERE target IN ('group_7', 'orders')"""


def g17(s, d):
    df = runner.statement(s, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_orderstatus", {"orders": table(s, d, "orders")})
    lines = runner.explain(df)
    return s.createDataFrame([(i, t) for i, t in enumerate(lines)], "line int, text string").withColumn("rows", df.agg(F.sum("n").alias("rows")).scalar())


# Texts that look like statements, derived from the part list.
STATEMENT = """CASE p_partkey % 8 WHEN 0 THEN concat('SELECT * FROM orders WHERE note = ''drop ', p_name, '''') WHEN 1 THEN concat('DROP TABLE ', p_type)
 WHEN 2 THEN concat('SELECT 1; DELETE FROM t', CAST(p_size AS STRING)) WHEN 3 THEN concat('-- ', p_name) WHEN 4 THEN 'WITH a AS (SELECT 1) SELECT * FROM a -- insert'
 WHEN 5 THEN concat('/* update */ SELECT ', CAST(p_size AS STRING), ';') WHEN 6 THEN 'EXPLAIN SELECT 1' ELSE concat('VALUES (', CAST(p_size AS STRING), ')') END"""


def g18(s, d):
    texts = table(s, d, "part").selectExpr(f"{STATEMENT} AS sql").groupBy("sql").agg(F.count("*").alias("n"))
    return texts.groupBy(F.coalesce(guard.read_only_verdict(F.col("sql")), F.lit("ok")).alias("verdict")).agg(F.sum("n").alias("n"))


G18 = """SELECT CASE p_partkey % 8 WHEN 1 THEN 'blocked word DROP' WHEN 2 THEN 'more than one statement' WHEN 3 THEN 'empty query'
 WHEN 7 THEN 'only SELECT queries may run, not VALUES' ELSE 'ok' END AS verdict, count(*) AS n FROM part GROUP BY 1"""


def g19(s, d):
    texts = table(s, d, "part").selectExpr(f"{STATEMENT} AS sql").groupBy("sql").agg(F.count("*").alias("n"))
    return texts.groupBy(guard.dataset_verdict(F.col("sql")).isNull().alias("allowed")).agg(F.sum("n").alias("n"))


def g20(s, d):
    short = runner.statement(s, "SELECT r_regionkey AS k FROM region ORDER BY r_regionkey", {"region": table(s, d, "region")})
    long = runner.statement(s, "SELECT l_orderkey * 10 + l_linenumber AS k FROM lineitem ORDER BY k", {"lineitem": table(s, d, "lineitem")})
    return runner.capped(short, 5).withColumn("asked", F.lit("region")).unionByName(runner.capped(long, 500).withColumn("asked", F.lit("lineitem")))


G20 = """(SELECT r_regionkey AS k, (SELECT count(*) FROM region) > 5 AS truncated, 'region' AS asked FROM region ORDER BY k LIMIT 5)
UNION ALL (SELECT l_orderkey * 10 + l_linenumber, (SELECT count(*) FROM lineitem) > 500, 'lineitem' FROM lineitem ORDER BY 1 LIMIT 500)"""


def g21(s, d):
    good = runner.run_on_dataset(table(s, d, "customer"), "SELECT c_mktsegment, count(*) AS n FROM data GROUP BY 1")
    bad = runner.run_on_dataset(table(s, d, "customer"), "SELECT nothing FROM data")
    rows = [(r["c_mktsegment"], r["n"], bad.error_code) for r in good.rows]
    return s.createDataFrame(rows, "segment string, n long, other_error string")


def g22(s, d):
    views = {"orders": table(s, d, "orders")}
    got = runner.run_on_tables(s, "SELECT o_orderstatus AS k, count(*) AS n FROM orders WHERE o_totalprice > :least GROUP BY 1", views, args={"least": 1000})
    errors = [runner.run_on_tables(s, q, views).error_code for q in ("SELECT ( FROM orders", "SELECT x FROM orders", "DROP TABLE orders", "SELECT * FROM nothing")]
    return s.createDataFrame([(r["k"], r["n"], ",".join(errors)) for r in got.rows], "k string, n long, errors string")


G22 = """SELECT o_orderstatus AS k, count(*) AS n, 'refused,unknown_column,refused,refused' AS errors FROM orders WHERE o_totalprice > 1000 GROUP BY 1"""

# One statement per row of a table, with names and values of that row: ``(statement, verdict)`` as SQL expressions.
_QUOTED = "chr(39)"
_SCOPED = [
    (f"concat('WITH a AS (SELECT * FROM orders) SELECT * FROM a JOIN customer c ON a.o_custkey = c.c_custkey WHERE o_orderstatus = ', {_QUOTED}, o_orderstatus, {_QUOTED})", "'ok'"),
    ("'SELECT * FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier)'", "'supplier is outside the allowed scope'"),
    ("concat('SELECT * FROM secrets_', lower(o_orderstatus))", "concat('secrets_', lower(o_orderstatus), ' is unknown')"),
    ("concat('SELECT tablename AS ', lower(o_orderstatus), ' FROM pg_catalog.pg_tables')", "'pg_catalog.pg_tables is a system object'"),
    ("concat('SELECT ( FROM orders ', o_orderstatus)", "'the query could not be parsed'"),
]
POLICY = guard.Policy({"supplier"}, {"customer.c_acctbal"}, {"customer.c_name"})
_RAW = "'column customer.c_name is sensitive and must be aggregated'"
_SEGMENT = f"{_QUOTED}, c_mktsegment, {_QUOTED}"
_POLICED = [
    ("'SELECT * FROM supplier'", "'table supplier is hidden'"), ("'SELECT c.c_acctbal FROM customer c'", "'column customer.c_acctbal is restricted'"),
    (f"concat('SELECT c_name FROM customer WHERE c_mktsegment = ', {_SEGMENT})", _RAW),
    (f"concat('SELECT count(*) FROM customer WHERE c_name = ', {_SEGMENT})", _RAW),
    (f"concat('SELECT count(DISTINCT c.c_name) AS n FROM customer AS c WHERE c_mktsegment = ', {_SEGMENT})", "'ok'"),
    ("'SELECT * FROM customer'", "'* would expose customer.c_acctbal'"), ("'SELECT max(c_name) OVER (PARTITION BY c_custkey) FROM customer'", _RAW),
    ("concat('SELECT c_mktsegment AS ', lower(c_mktsegment), ' FROM customer')", "'ok'"),
]


def _one_of(forms, key: str, part: int) -> str:
    return f"CASE {key} % {len(forms)} " + " ".join(f"WHEN {n} THEN {f[part]}" for n, f in enumerate(forms)) + " END"


def g23(s, d):
    orders = table(s, d, "orders").selectExpr("o_orderkey", f"{_one_of(_SCOPED, 'o_orderkey', 0)} AS statement")
    found = guard.judged(orders, "statement", lambda sql: guard.check_scope(s, sql, set(NAMES), {"orders", "customer"}))
    return found.select("o_orderkey", F.coalesce("verdict", F.lit("ok")).alias("verdict"))


G23 = f"SELECT o_orderkey, {_one_of(_SCOPED, 'o_orderkey', 1)} AS verdict FROM orders"


def g24(s, d):
    customers = table(s, d, "customer").selectExpr("c_custkey", f"{_one_of(_POLICED, 'c_custkey', 0)} AS statement")
    found = guard.judged(customers, "statement", lambda sql: guard.check_policy(s, sql, POLICY))
    return found.select("c_custkey", F.coalesce("verdict", F.lit("ok")).alias("verdict"))


G24 = f"SELECT c_custkey, {_one_of(_POLICED, 'c_custkey', 1)} AS verdict FROM customer"


def g24_view(s, d):
    return guard.governed(table(s, d, "customer"), ["c_acctbal"], ["c_name"])


def g25(s, d):
    return G.overlay(annotated(s, d), ["supplier", "pages"], ["customer.c_acctbal"]).select("table", "column", "rows")


def usages(s, d):
    return table(s, d, "lineitem").selectExpr(
        "CASE WHEN l_linenumber < 4 THEN 'query' ELSE 'widget' END AS kind", "l_orderkey AS id",
        "CASE l_returnflag WHEN 'A' THEN 'orders' WHEN 'N' THEN 'customer' ELSE 'supplier' END AS table",
    )


def g26(s, d):
    return G.scope_impact(usages(s, d), ["orders"]).select("kind", "id", F.array_join("tables", ",").alias("tables"))


G26 = """SELECT kind, id, string_agg(DISTINCT t, ',' ORDER BY t) AS tables FROM (SELECT CASE WHEN l_linenumber < 4 THEN 'query' ELSE 'widget' END AS kind, l_orderkey AS id,
 CASE l_returnflag WHEN 'A' THEN 'orders' WHEN 'N' THEN 'customer' ELSE 'supplier' END AS t FROM lineitem) WHERE t <> 'orders' GROUP BY 1, 2"""


def g27(s, d):
    names = table(s, d, "part").select(F.concat_ws("_", "p_name", "p_type").alias("name")).distinct()
    return G.closest_names(names, "smal ring_economi").select("name", F.round("score", 6).alias("score"))


G27 = """SELECT name, round(1 - levenshtein(lower(name), 'smal ring_economi') / greatest(length(name), 17, 1)::DOUBLE, 6) AS score
FROM (SELECT DISTINCT p_name || '_' || p_type AS name FROM part) WHERE 1 - levenshtein(lower(name), 'smal ring_economi') / greatest(length(name), 17, 1)::DOUBLE >= 0.5
ORDER BY score DESC, name LIMIT 5"""


def g28(s, d):
    docs = table(s, d, "documents")
    clean = T.redact(F.col("text"))
    marks = F.size(F.split(clean, r"\[REDACTED\]")) - 1
    return docs.select("doc_id", marks.cast("long").alias("marks"), F.md5(clean).alias("digest"))


def _redact_sql(c):
    for shape in T.SECRET_SHAPES.values():
        c = f"regexp_replace({c}, '{shape}', '[REDACTED]', 'g')"
    return c


G28 = f"""SELECT doc_id, ((length(t) - length(replace(t, '[REDACTED]', ''))) // 10)::BIGINT AS marks, md5(t) AS digest FROM (SELECT doc_id, {_redact_sql('text')} AS t FROM documents)"""

# Chat inputs derived from the documents: words, symbols, repeats, smash and opaque tokens.
INPUT = """CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '[^.,!?]', '') WHEN 2 THEN repeat('ab', 2 + CAST(doc_id % 9 AS INT))
 WHEN 3 THEN concat('xkcdbrtzplmnwq', substr(md5(text), 1, 0), 'trwskdfg') WHEN 4 THEN md5(text) ELSE concat('Zq', substr(md5(text), 1, 12), '-', upper(substr(md5(text), 13, 14))) END"""


def g29(s, d):
    inputs = table(s, d, "documents").selectExpr("doc_id", f"{INPUT} AS input")
    return inputs.select("doc_id", T.is_noise(F.col("input")).alias("noise"))


G29 = """
WITH i AS (SELECT doc_id, """ + INPUT.replace("'[^.,!?]', '')", "'[^.,!?]', '', 'g')") + """ AS v FROM documents),
 p AS (SELECT doc_id, trim(regexp_replace(v, '[[:cntrl:]]', '', 'g')) AS v, regexp_replace(trim(regexp_replace(v, '[[:cntrl:]]', '', 'g')), '\\s+', '', 'g') AS c FROM i),
 e AS (SELECT *, CASE WHEN length(c) BETWEEN 1 AND 2000 THEN (SELECT -sum(n / length(c) * log2(n / length(c))) FROM (SELECT count(*)::DOUBLE AS n FROM unnest(string_split(c, '')) AS u(ch) GROUP BY ch)) ELSE 0 END AS entropy FROM p)
SELECT doc_id, NOT regexp_matches(v, '[\\p{L}\\p{N}]') OR (length(c) >= 8 AND len(list_distinct(string_split(lower(c), ''))) <= 2)
 OR (length(c) >= 16 AND regexp_full_match(c, '[A-Za-z]+') AND (length(regexp_replace(lower(c), '[^aeiouy]', '', 'g')) / length(c) < 0.28 OR regexp_matches(lower(c), '[^aeiouy]{6,}')))
 OR (regexp_full_match(c, '[A-Za-z0-9_+./=-]{24,}') AND NOT (regexp_matches(v, '\\s') AND len(regexp_extract_all(v, '[A-Za-z]{2,}')) >= 2)
  AND regexp_matches(c, '[a-z]')::INT + regexp_matches(c, '[A-Z]')::INT + regexp_matches(c, '[0-9]')::INT + regexp_matches(c, '[_+./=-]')::INT >= 2 AND entropy >= 3.5) AS noise FROM e"""


def g30(s, d):
    return G.slice_rows(table(s, d, "orders"), ["o_totalprice", "o_orderkey"], 100, 80).select("o_orderkey")


def g31(s, d):
    return G.schema_card(table(s, d, "customer").selectExpr("c_custkey", "nullif(c_mktsegment, 'BUILDING') AS segment", "c_nationkey"), "c_custkey").select(
        "ordinal", "column", F.array_join("samples", "|").alias("samples")
    )


G31 = union_all(
    f"SELECT {i} AS ordinal, '{n}' AS \"column\", string_agg(v, '|' ORDER BY k) AS samples FROM (SELECT c_custkey AS k, ({e})::VARCHAR AS v FROM customer WHERE ({e}) IS NOT NULL ORDER BY k LIMIT 3)"
    for i, (n, e) in enumerate((("c_custkey", "c_custkey"), ("segment", "nullif(c_mktsegment, 'BUILDING')"), ("c_nationkey", "c_nationkey")))
)


_SKETCHED = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"]


def g13_sketches(s, d):
    """Sketches of the lines of each month, stored in two goes and merged, held against the exact figures."""
    lines = table(s, d, "lineitem")
    store = sketches.SketchStore(f"{checkpoint_dir(s)}/sketches/{uuid.uuid4().hex}", _SKETCHED)
    month, late = F.date_format("l_shipdate", "yyyy-MM"), F.col("l_shipdate") >= "1998-01-01"
    store.put(lines.where(~late), month)
    store.put(lines.where(late), month)
    found = store.profile(s).collect()  # one row per column
    parts = []
    for r in found:
        # Everything exact comes from how often each value occurs: one shuffle of distinct values a column.
        c, n = F.col("value"), F.col("n")
        counted = lines.groupBy(F.col(r["column"]).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        rows_where = lambda keep: F.coalesce(F.sum(F.when(keep, n)), F.lit(0))  # noqa: B023, E731
        exact, total = F.count(c), rows_where(c.isNotNull())
        ranks = [(rows_where(c < q) / total - sketches.RANK_ERROR <= p) & (rows_where(c <= q) / total + sketches.RANK_ERROR >= p)
                 for p, q in zip(sketches.PROBABILITIES, r["quantiles"] or [])]
        within = F.lit(True)
        for rank in ranks:
            within = within & rank
        most = F.lit(True)
        for item in r["top"]:
            missed = rows_where(c.cast("string") == item["item"]) - item["count"]
            most = most & (missed >= 0) & (missed <= total / (0.75 * sketches.TRACKED))
        parts.append(counted.agg(F.lit(r["column"]).alias("column"), F.lit(r["rows"]).alias("rows"), F.lit(r["count"]).alias("count"),
                                 (F.abs(F.lit(r["distinct"]) - exact) <= sketches.DISTINCT_ERROR * exact + 1).alias("distinct_within"),
                                 within.alias("quantiles_within"), most.alias("top_within")))
    return reduce(DataFrame.unionByName, parts)


G13_SKETCHES = union_all(
    f"SELECT '{c}' AS column, count(*) AS rows, count({c}) AS count, true AS distinct_within, true AS quantiles_within, true AS top_within FROM lineitem" for c in _SKETCHED)

QUERIES = {
    "G1_list_tables": (g1, f'SELECT tn AS "table", rows FROM {_COUNTS}'),
    "G2_extract_schema": (g2, f'SELECT "table", ordinal, "column", dtype, is_key, ref_table, ref_column, rows FROM {META}'),
    "G3_enum_samples": (g3, G3),
    "G4_G5_semantic_types": (g4, f'SELECT "table", "column", meaning AS semantic_type, sensitive AS is_sensitive, rows FROM {META}'),
    "G6_importance": (g6, G6), "G7_schema_hash": (g7, G7), "G8_search_schema": (g8, g8_sql()), "G9_ground": (g9, g9_sql()),
    "G10_default_date": (g10, G10),
    "G11_preview": (g11, """SELECT c_custkey, c_nationkey, c_acctbal, 'c_custkey,c_nationkey,c_acctbal' AS columns FROM customer ORDER BY c_custkey LIMIT 5"""),
    "G12_sample_values": (g12, """SELECT DISTINCT 'priority' AS kind, o_orderpriority AS value FROM orders
 UNION ALL SELECT DISTINCT 'source', source FROM documents WHERE (SELECT count(DISTINCT source) FROM documents) <= 15"""),
    "G13_quick_profile": (g13, G13), "G13_from_sketches": (g13_sketches, G13_SKETCHES),
    "G14_filtered_count": (g14, """SELECT 'and' AS mode, count(*) AS n FROM part WHERE p_name ILIKE '%RING%' AND p_size >= 10 AND p_brand IS NOT NULL
 UNION ALL SELECT 'or', count(*) FROM part WHERE p_type = 'ECONOMY' OR p_retailprice < 950"""),
    "G15_ranked_tables": (g15, f'SELECT row_number() OVER (ORDER BY is_internal, importance DESC, "table") - 1 AS position, "table", importance FROM ({G6})'),
    "G15_describe": (g15_describe, f"""SELECT ordinal, "column", dtype, is_key, ref_table, meaning AS semantic_type, rows FROM {META} WHERE "table" = 'orders'"""),
    "G16_relationships": (g16, G16),
    "G17_explain": (g17, None), "G18_read_only": (g18, G18),
    "G19_dataset_sql": (g19, "SELECT p_partkey % 8 IN (0, 4, 5) AS allowed, count(*) AS n FROM part GROUP BY 1"),
    "G20_row_cap": (g20, G20),
    "G21_run_on_dataset": (g21, "SELECT c_mktsegment AS segment, count(*) AS n, 'unknown_column' AS other_error FROM customer GROUP BY 1"),
    "G22_run_on_tables": (g22, G22), "G23_scope": (g23, G23), "G24_column_policy": (g24, G24),
    "G24_governed_view": (g24_view, "SELECT c_custkey, sha256(c_name) AS c_name, c_nationkey, c_mktsegment FROM customer"),
    "G25_overlay": (g25, f"""SELECT "table", "column", rows FROM {META} WHERE "table" NOT IN ('supplier', 'pages') AND NOT ("table" = 'customer' AND "column" = 'c_acctbal')"""),
    "G26_scope_impact": (g26, G26), "G27_closest_names": (g27, G27), "G28_redact": (g28, G28), "G29_noise": (g29, G29),
    "G30_slice": (g30, "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 80 OFFSET 100"), "G31_schema_card": (g31, G31),
}

