"""Usage and health aggregates over ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import usage as U
from plumbline.suite.tables import table

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]

# The event log seen as query runs: an error event is a failed run, its value the
# latency, its user the source; every third run belongs to a saved query.
RUN = {
    "id": "event_id", "source": "user_id", "ok": "event_type <> 'error'", "latency": "value", "ran_at": "ts",
    "owner": "event_type", "query_id": "CASE WHEN event_id % 3 = 0 THEN event_id END",
    "error": "CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN props END",
}
RUNS = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in RUN.items()) + " FROM events)"
NAMES = "(SELECT c_custkey AS source, c_name AS name FROM customer WHERE c_custkey % 2 = 0)"
NOW = "(SELECT max(ts) FROM events)"
# The event log seen as a query library and as background runs.
LIBRARY = {
    "id": "event_id", "name": "concat('query ', CAST(event_id % 97 AS STRING))", "folder": "CASE WHEN event_type <> 'view' THEN event_type END",
    "scheduled": "event_id % 5 = 0", "runs": "user_id", "last_run_at": "CASE WHEN event_id % 4 <> 0 THEN ts END", "created_at": "ts",
}
LIB = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in LIBRARY.items()) + ", event_type, event_id % 3 AS third FROM events)"
_STAMP = "%Y-%m-%d %H:%M:%S"


def runs(spark, d):
    return table(spark, d, "events").selectExpr(*[f"{e} AS {n}" for n, e in RUN.items()])


def names(spark, d):
    return table(spark, d, "customer").filter("c_custkey % 2 = 0").selectExpr("c_custkey AS source", "c_name AS name")


def now(spark, d):
    return table(spark, d, "events").agg(F.max("ts").alias("t")).scalar()


def library(spark, d):
    df = table(spark, d, "events").selectExpr(*[f"{e} AS {n}" for n, e in LIBRARY.items()], "event_type", "event_id % 3 AS third")
    return df.withColumn("tags", F.array("event_type", F.concat(F.lit("t"), F.col("third").cast("string"))))


def _time(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


TOTALS = """count(*) AS total, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed,
 coalesce(round(100.0 * avg(CASE WHEN ok THEN 1 ELSE 0 END), 1), 0) AS success_pct, coalesce(round(avg(latency), 2), 0) AS mean_ms"""


def u4(spark, d):
    return U.history(runs(spark, d), "click", n=50).select("id", "source", _time("ran_at"))


def u5(spark, d):
    return U.source_stats(runs(spark, d), 7)


def u9(spark, d):
    rows, cursor = U.page(runs(spark, d), "ran_at", before=F.lit("2024-01-20").cast("timestamp_ntz"), size=20)
    return rows.withColumn("cursor", F.date_format(F.substring_index(cursor, "|", 1).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")).select("id", "cursor")


def u9_tied(spark, d):
    """The second page where whole days share one time."""
    days = runs(spark, d).withColumn("ran_at", F.date_trunc("day", "ran_at"))
    rows, cursor = U.page(days, "ran_at", size=30)
    at = rows.select(cursor.alias("c")).first()["c"]
    rows, _ = U.page(days, "ran_at", before=F.lit(at), size=30)
    return rows.select("id")


def u12(spark, d):
    return U.child_counts(table(spark, d, "customer").select("c_custkey"), "c_custkey", table(spark, d, "orders"), "o_custkey", "orders")


def u17(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id AS id", "CASE WHEN doc_id % 2 = 0 THEN replace(text, ' ', '   ') ELSE concat(text, '  ') END AS sql")
    out = U.duplicate_sql(docs)
    return out.select("copies", "first_id", F.length("text").cast("long").alias("size"))


def u18(spark, d):
    defs = table(spark, d, "events").selectExpr("event_type AS status", "CASE WHEN value > 50 THEN 'valid' ELSE 'stale' END AS validation", "ts AS validated_at")
    return U.definition_summary(defs).select("status", "validation", "n", _time("last_validated"))


_BG = [
    "event_id AS id",
    "CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'running' WHEN 'click' THEN 'queued' ELSE 'completed' END AS status",
    "ts AS started_at", "ts AS heartbeat",
]
_BG_SQL = ", ".join(_BG)


def background(spark, d):
    df = table(spark, d, "events").selectExpr(*_BG, "value")
    return df.withColumn("ended_at", F.col("started_at") + F.make_interval(secs=F.floor("value")))


def u20(spark, d):
    cutoff = now(spark, d) - F.make_interval(days=F.lit(10))
    return U.stale_runs(background(spark, d), cutoff, ["running", "queued"]).select("id", "status")


def u21(spark, d):
    return U.question_answers(table(spark, d, "conversations")).select("conv_id", "turn", F.length("question").alias("q"), F.length("answer").alias("a"))


PAIRS = """(SELECT a.conv_id, a.turn, q.text AS question, a.text AS answer FROM conversations a JOIN conversations q
 ON q.conv_id = a.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant' AND q.role = 'user')"""


def u22(spark, d):
    talk = table(spark, d, "conversations")
    asked = talk.filter("role = 'user'").selectExpr("conv_id", "turn + 1 AS turn", "text AS question")
    pairs = talk.filter("role = 'assistant'").selectExpr("conv_id", "turn", "text AS answer").join(asked, ["conv_id", "turn"])
    out = U.within_token_budget(pairs.withColumn("lot", F.col("conv_id") % 5).withColumn("at", F.col("conv_id") * 1000 + F.col("turn")), ["lot"], "at")
    return out.select("conv_id", "turn", F.col("tokens").cast("long").alias("tokens"), F.col("used").cast("long").alias("used"))


def u23(spark, d):
    usages = table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS usage_id", "l_partkey AS version_id", "l_shipdate AS used_at")
    versions = table(spark, d, "part").filter("p_size = 1").selectExpr("p_partkey AS version_id", "p_brand AS definition")
    return U.impact(usages, versions).select("usage_id", "version_id", "definition")


def u24(spark, d):
    return U.table_counts({t: table(spark, d, t) for t in TABLES})


def u25(spark, d):
    return U.disposition_page(runs(spark, d), 3).select("id", "state")


def u26(spark, d):
    parts = []
    for by in U.SORTS:
        top = U.sort_library(library(spark, d), by).limit(5)
        parts.append(top.select(F.lit(by).alias("sort"), "id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_ORDER = {"last_run": "last_run_at DESC NULLS LAST", "name": "name", "runs": "runs DESC", "newest": "created_at DESC", "oldest": "created_at"}


def u28(spark, d):
    """How often each part is referred to by lines."""
    edges = table(spark, d, "lineitem").selectExpr("CAST(l_orderkey AS STRING) AS source", "CAST(l_partkey AS STRING) AS target")
    return U.inbound_references(table(spark, d, "part").selectExpr("CAST(p_partkey AS STRING) AS table"), edges)


U28_SQL = """SELECT p_partkey::VARCHAR AS "table", count(l_partkey) AS inbound FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey"""

QUERIES = {
    "U1_usage_overview": (lambda s, d: U.overview(runs(s, d)), f"SELECT {TOTALS} FROM (SELECT * FROM {RUNS} ORDER BY ran_at DESC, id DESC LIMIT 500)"),
    "U2_top_sources": (lambda s, d: U.top_sources(runs(s, d), names(s, d)), f"""
SELECT source, coalesce(name, 'Unknown') AS name, runs FROM (SELECT source, count(*) AS runs FROM {RUNS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) LEFT JOIN {NAMES} USING (source)"""),
    "U3_recent_runs": (lambda s, d: U.recent_runs(runs(s, d), names(s, d)).select("id", "source", "name", "ok"), f"""
SELECT id, source, coalesce(name, 'Unknown') AS name, ok FROM (SELECT * FROM {RUNS} ORDER BY ran_at DESC, id DESC LIMIT 10) LEFT JOIN {NAMES} USING (source)"""),
    "U4_history": (u4, f"""SELECT id, source, strftime(ran_at, '{_STAMP}') AS ran_at FROM
 (SELECT * FROM {RUNS} WHERE owner = 'click' AND query_id IS NULL ORDER BY ran_at DESC, id DESC LIMIT 50)"""),
    "U5_source_stats": (u5, f"SELECT {TOTALS} FROM (SELECT * FROM {RUNS} WHERE source = 7 ORDER BY ran_at DESC, id DESC LIMIT 100)"),
    "U6_runs_per_source": (lambda s, d: U.runs_per_source(runs(s, d)), f"SELECT source, count(*) AS runs FROM {RUNS} GROUP BY 1"),
    "U7_success_rates": (lambda s, d: U.success_rates(runs(s, d), now(s, d), {"24h": 24, "7d": 168}), " UNION ALL ".join(
        f"SELECT '{n}' AS span, count(*) AS events, coalesce(round(100.0 * avg(CASE WHEN ok THEN 1 ELSE 0 END), 2), 0) AS success_pct FROM {RUNS} WHERE ran_at >= {NOW} - INTERVAL {h} HOUR"
        for n, h in (("24h", 24), ("7d", 168)))),
    "U8_latency_percentiles": (lambda s, d: U.latency_percentiles(runs(s, d), ["source"]), f"""
WITH r AS (SELECT source, latency, row_number() OVER (PARTITION BY source ORDER BY latency) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM {RUNS})
SELECT source, p, latency AS value FROM r, (VALUES (0.5::DOUBLE), (0.95::DOUBLE)) AS v(p) WHERE i = round_even((n - 1) * p, 0)"""),
    "U9_keyset_page": (u9, f"""
WITH a AS (SELECT id, ran_at FROM {RUNS} WHERE ran_at < TIMESTAMP '2024-01-20' ORDER BY ran_at DESC, id DESC LIMIT 21), r AS (SELECT * FROM a ORDER BY ran_at DESC, id DESC LIMIT 20)
SELECT id, CASE WHEN (SELECT count(*) FROM a) > 20 THEN strftime((SELECT min(ran_at) FROM r), '{_STAMP}') END AS cursor FROM r"""),
    "U9_tied_times": (u9_tied, f"SELECT id FROM {RUNS} ORDER BY date_trunc('day', ran_at) DESC, id DESC LIMIT 30 OFFSET 30"),
    "U10_last_good": (lambda s, d: U.last_good(runs(s, d), ["source"]).select("source", _time("last_good")),
                      f"SELECT source, strftime(max(ran_at) FILTER (ok), '{_STAMP}') AS last_good FROM {RUNS} GROUP BY 1"),
    "U11_retained": (lambda s, d: U.retained(runs(s, d), now(s, d), 9).select("id", "source"), f"SELECT id, source FROM {RUNS} WHERE ran_at >= {NOW} - INTERVAL 9 DAY"),
    "U12_child_counts": (u12, "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    "U13_count_by_type": (lambda s, d: U.count_by(table(s, d, "events"), "event_type"), "SELECT event_type, count(*) AS n FROM events GROUP BY 1"),
    "U14_library_stats": (lambda s, d: U.library_stats(library(s, d), now(s, d)), f"""
SELECT count(*) AS total, count(*) FILTER (scheduled) AS scheduled, sum(runs)::BIGINT AS runs,
 count(*) FILTER (last_run_at >= {NOW} - INTERVAL 7 DAY) AS recently_run, count(DISTINCT folder) AS folders FROM {LIB}"""),
    "U15_folders": (lambda s, d: U.folders(library(s, d)), f"SELECT folder, count(*) AS queries FROM {LIB} WHERE folder IS NOT NULL GROUP BY 1"),
    "U15_tags": (lambda s, d: U.tags(library(s, d)), f"SELECT DISTINCT tag FROM (SELECT event_type AS tag FROM {LIB} UNION ALL SELECT 't' || third FROM {LIB})"),
    "U16_filter_library": (lambda s, d: U.filter_library(library(s, d), "click", "t1", now(s, d) - F.make_interval(days=F.lit(20))).select("id", "runs"),
                           f"SELECT id, runs FROM {LIB} WHERE folder = 'click' AND third = 1 AND last_run_at >= {NOW} - INTERVAL 20 DAY"),
    "U17_duplicate_sql": (u17, r"""SELECT count(*) AS copies, min(doc_id) AS first_id, length(t) AS size FROM
 (SELECT doc_id, lower(trim(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN replace(text, ' ', '   ') ELSE text || '  ' END, '\s+', ' ', 'g'))) AS t FROM documents) GROUP BY t HAVING count(*) > 1"""),
    "U18_definition_summary": (u18, f"""SELECT event_type AS status, CASE WHEN value > 50 THEN 'valid' ELSE 'stale' END AS validation, count(*) AS n,
 strftime(max(ts), '{_STAMP}') AS last_validated FROM events GROUP BY 1, 2"""),
    "U19_run_health": (lambda s, d: U.run_health(background(s, d)), f"""
SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
 count(*) FILTER (status NOT IN ('completed', 'failed')) AS other, round(avg(CASE WHEN status = 'failed' THEN 1 ELSE 0 END), 4) AS failure_rate,
 round(avg(floor(value)), 3) AS mean_seconds FROM (SELECT {_BG_SQL}, value FROM events)"""),
    "U20_stale_runs": (u20, f"SELECT id, status FROM (SELECT {_BG_SQL} FROM events) WHERE status IN ('running', 'queued') AND heartbeat < {NOW} - INTERVAL 10 DAY"),
    "U21_question_answers": (u21, f"SELECT conv_id, turn, length(question)::INTEGER AS q, length(answer)::INTEGER AS a FROM {PAIRS} ORDER BY conv_id DESC, turn DESC LIMIT 50"),
    "U22_token_budget": (u22, f"""
WITH p AS (SELECT conv_id, turn, conv_id % 5 AS lot, conv_id * 1000 + turn AS at_, (ceil((length(question) + length(answer)) / 4.0) + 32)::BIGINT AS tokens FROM {PAIRS}),
 r AS (SELECT *, row_number() OVER w AS rn, (sum(tokens) OVER w)::BIGINT AS used FROM p WINDOW w AS (PARTITION BY lot ORDER BY at_ DESC ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, tokens, used FROM r WHERE rn = 1 OR used <= 6000"""),
    "U23_impact": (u23, "SELECT l_orderkey * 10 + l_linenumber AS usage_id, l_partkey AS version_id, p_brand AS definition FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 1"),
    "U24_table_counts": (u24, " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in TABLES)
                         + " UNION ALL SELECT 'TOTAL', sum(n)::BIGINT FROM (" + " UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in TABLES) + ")"),
    "U25_disposition_page": (u25, f"SELECT id, CASE WHEN ok THEN 'success' WHEN error IS NOT NULL THEN 'failed' ELSE 'pending' END AS state FROM {RUNS} ORDER BY ran_at DESC, id DESC LIMIT 8 OFFSET 16"),
    "U26_sort_library": (u26, " UNION ALL ".join(f"SELECT * FROM (SELECT '{k}' AS sort, id FROM {LIB} ORDER BY {o}, id LIMIT 5)" for k, o in _ORDER.items())),
    "U27_category_counts": (lambda s, d: U.category_counts(table(s, d, "documents"), "lang"), "SELECT lang, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT 'All', count(*) FROM documents"),
    "U28_inbound_references": (u28, U28_SQL),
}
