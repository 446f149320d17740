"""Usage and health aggregates over query logs, health events and libraries.

A log frame has ``id, source, ok, latency, ran_at``; the helpers take column
names where callers differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions import ranks as R, text as X
from plumbline.session import col, cut_lineage, lookup_join

RECENT, TOP_SOURCES, LATEST = 500, 5, 10
UNKNOWN = "Unknown"


def newest(df: DataFrame, time: str, key: str, n: int) -> DataFrame:
    """The ``n`` newest rows, ties by key; Spark keeps a bounded heap per task."""
    return df.orderBy(F.desc(time), F.desc(key)).limit(n)


def rate(condition: Column, digits: int = 1) -> Column:
    """Share of true rows in percent, 0 for no rows."""
    return F.coalesce(F.round(100.0 * F.avg(condition.cast("int")), digits), F.lit(0.0))


def run_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count("*").alias("total"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"),
        rate(F.col("ok")).alias("success_pct"), F.coalesce(F.round(F.avg("latency"), 2), F.lit(0.0)).alias("mean_ms"),
    )


def overview(runs: DataFrame, n: int = RECENT) -> DataFrame:
    """Totals over the last ``n`` runs."""
    return run_totals(newest(runs, "ran_at", "id", n))


def with_names(few: DataFrame, names: DataFrame) -> DataFrame:
    """A top list with source names. The few rows are worked out once and written; the
    name table is reduced to them by a broadcast semi join before it is joined."""
    few = cut_lineage(few)
    met = names.join(F.broadcast(few.select("source").distinct()), "source", "left_semi")
    return few.join(met, "source", "left").withColumn("name", F.coalesce("name", F.lit(UNKNOWN)))


def top_sources(runs: DataFrame, names: DataFrame, k: int = TOP_SOURCES) -> DataFrame:
    """The ``k`` busiest sources with their name, ``Unknown`` where none is registered."""
    busiest = runs.groupBy("source").agg(F.count("*").alias("runs")).orderBy(F.desc("runs"), "source").limit(k)
    return with_names(busiest, names).select("source", "name", "runs")


def recent_runs(runs: DataFrame, names: DataFrame, n: int = LATEST) -> DataFrame:
    return with_names(newest(runs, "ran_at", "id", n), names).select("id", "source", "name", "ok", "ran_at")


def history(runs: DataFrame, owner, source=None, n: int = 50) -> DataFrame:
    """Ad-hoc runs (no saved query) of one owner, newest first."""
    kept = runs.filter((F.col("owner") == F.lit(owner)) & F.col("query_id").isNull())
    if source is not None:
        kept = kept.filter(F.col("source") == F.lit(source))
    return newest(kept, "ran_at", "id", n)


def source_stats(runs: DataFrame, source, n: int = 100) -> DataFrame:
    """Totals over the newest ``n`` runs of one source."""
    return run_totals(newest(runs.filter(F.col("source") == F.lit(source)), "ran_at", "id", n))


def runs_per_source(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source").agg(F.count("*").alias("runs"))


def success_rates(events: DataFrame, now: Column, spans: dict[str, int]) -> DataFrame:
    """``(span, events, success_pct)`` for the last hours named in ``spans``."""
    cells = []
    for name, hours in spans.items():
        recent = F.col("ran_at") >= now - F.make_interval(hours=F.lit(hours))
        ok = F.when(recent, F.col("ok"))
        cells.append(F.struct(
            F.lit(name).alias("span"), F.count_if(recent).alias("events"), rate(ok, 2).alias("success_pct")
        ))
    return events.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def latency_percentiles(events: DataFrame, keys: list[str], probabilities: list[float] = [0.5, 0.95]) -> DataFrame:
    """Nearest-rank latency per group, exact for groups of any size."""
    return R.grouped_quantiles(events, keys, F.col("latency"), probabilities, nearest=True)


def page(df: DataFrame, time: str, before=None, size: int = 20, key: str = "id") -> tuple[DataFrame, Column]:
    """The newest rows before a cursor and the cursor of the next page, NULL at the end.

    The cursor names time and key of the last row in one text, so that rows of one time are not lost between pages.
    ``before`` is such a text, or a time alone, which stands before all rows of that time.
    """
    kept = df
    if before is not None:
        if isinstance(df.select(before).schema[0].dataType, T.StringType):
            at = F.substring_index(before, "|", 1).cast(df.schema[time].dataType)
            last = F.regexp_replace(before, r"^[^|]*\|", "").cast(df.schema[key].dataType)
            kept = df.filter((col(time) < at) | ((col(time) == at) & (col(key) < last)))
        else:
            kept = df.filter(col(time) < before)
    ahead = newest(kept, time, key, size + 1)
    rows = newest(ahead, time, key, size)
    more = ahead.agg(F.when(F.count("*") > size, F.lit(True)).alias("m")).scalar()
    end = F.min(F.struct(col(time).alias("time"), col(key).alias("key")))
    last = rows.agg(F.concat_ws("|", end["time"].cast("string"), end["key"].cast("string")).alias("t")).scalar()
    return rows, F.when(more, last)


def last_good(events: DataFrame, keys: list[str]) -> DataFrame:
    """Time of the latest successful event per group."""
    return events.groupBy(*keys).agg(F.max(F.when(F.col("ok"), F.col("ran_at"))).alias("last_good"))


def retained(events: DataFrame, now: Column, days: int = 90, time: str = "ran_at") -> DataFrame:
    """Rows younger than the retention; write them back by partition to drop the rest."""
    return events.filter(col(time) >= now - F.make_interval(days=F.lit(days)))


def child_counts(parents: DataFrame, key: str, children: DataFrame, foreign: str, name: str = "children") -> DataFrame:
    """Parents with the number of children, 0 if none. Children are counted before the join."""
    counted = children.groupBy(col(foreign).alias(key)).agg(F.count("*").alias(name))
    return parents.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(col(column)).agg(F.count("*").alias("n"))


def library_stats(queries: DataFrame, now: Column, days: int = 7) -> DataFrame:
    recent = F.col("last_run_at") >= now - F.make_interval(days=F.lit(days))
    return queries.agg(
        F.count("*").alias("total"), F.count_if("scheduled").alias("scheduled"), F.coalesce(F.sum("runs"), F.lit(0)).alias("runs"),
        F.count_if(recent).alias("recently_run"), F.count_distinct("folder").alias("folders"),
    )


def folders(queries: DataFrame) -> DataFrame:
    return queries.filter(F.col("folder").isNotNull()).groupBy("folder").agg(F.count("*").alias("queries")).orderBy("folder")


def tags(queries: DataFrame) -> DataFrame:
    return queries.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def filter_library(queries: DataFrame, folder=None, tag=None, since: Column | None = None) -> DataFrame:
    if folder is not None:
        queries = queries.filter(F.col("folder") == F.lit(folder))
    if tag is not None:
        queries = queries.filter(F.array_contains("tags", tag))
    if since is not None:
        queries = queries.filter(F.col("last_run_at") >= since)
    return queries.orderBy(F.desc("created_at"), F.desc("id"))


def duplicate_sql(queries: DataFrame, sql: str = "sql") -> DataFrame:
    """Texts saved more than once, ignoring case and spacing."""
    return queries.groupBy(X.normalised_sql(col(sql)).alias("text")).agg(
        F.count("*").alias("copies"), F.min("id").alias("first_id")
    ).filter(F.col("copies") > 1)


def definition_summary(definitions: DataFrame) -> DataFrame:
    return definitions.groupBy("status", "validation").agg(
        F.count("*").alias("n"), F.max("validated_at").alias("last_validated")
    )


def run_health(runs: DataFrame) -> DataFrame:
    """Runs per status, failure rate (4 digits) and mean seconds (3 digits)."""
    took = F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    failed = F.col("status") == "failed"
    return runs.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(failed).alias("failed"),
        F.count_if(~F.col("status").isin("completed", "failed")).alias("other"),
        F.round(F.avg(failed.cast("int")), 4).alias("failure_rate"), F.round(F.avg(took / 1e6), 3).alias("mean_seconds"),
    )


def stale_runs(runs: DataFrame, cutoff: Column, statuses: list[str]) -> DataFrame:
    return runs.filter(F.col("status").isin(statuses) & (F.col("heartbeat") < cutoff))


def question_answers(messages: DataFrame, runs: DataFrame | None = None, n: int = 50) -> DataFrame:
    """Answers with the question before them; the newest ``n``, oldest first.

    ``messages`` has ``conv_id, turn, role, text``; a question is the user turn
    right before an assistant turn.
    """
    answers = messages.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("answer"))
    asked = messages.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    pairs = answers.join(asked, ["conv_id", "turn"])
    if runs is not None:
        pairs = pairs.join(runs, ["conv_id", "turn"], "left").filter(F.coalesce("status", F.lit("completed")) == "completed")
    return pairs.orderBy(F.desc("conv_id"), F.desc("turn")).limit(n).orderBy("conv_id", "turn")


TOKEN_BUDGET, PAIR_OVERHEAD, CHARS_PER_TOKEN = 6_000, 32, 4


def within_token_budget(pairs: DataFrame, keys: list[str], order: str, budget: int = TOKEN_BUDGET) -> DataFrame:
    """The newest pairs of each group whose summed size stays within the budget; the
    newest one always stays.

    Every pair costs at least the overhead, so no more than ``budget / overhead``
    pairs can fit. Ranking first drops all older ones before the running sum, and
    Spark applies that rank limit on the map side.
    """
    from pyspark.sql import Window

    newest_first = Window.partitionBy(*keys).orderBy(F.desc(order))
    size = F.ceil((F.length("question") + F.length("answer")) / CHARS_PER_TOKEN) + PAIR_OVERHEAD
    candidates = pairs.withColumn("rank", F.row_number().over(newest_first)).filter(F.col("rank") <= budget // PAIR_OVERHEAD + 1)
    running = F.sum("tokens").over(newest_first.rowsBetween(Window.unboundedPreceding, 0))
    summed = candidates.withColumn("tokens", size).withColumn("used", running)
    return summed.filter((F.col("rank") == 1) | (F.col("used") <= budget))


def impact(usages: DataFrame, versions: DataFrame) -> DataFrame:
    """Usages of definition versions, newest first."""
    return lookup_join(usages, versions, "version_id", "inner").orderBy(F.desc("used_at"), F.desc("usage_id"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, rows)`` for all tables, and their total."""
    parts = [df.agg(F.lit(name).alias("table"), F.count("*").alias("rows")) for name, df in tables.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.rollup("table").agg(F.sum("rows").alias("rows")).select(F.coalesce("table", F.lit("TOTAL")).alias("table"), "rows")


def disposition(ok: Column, error: Column) -> Column:
    return F.when(ok, "success").when(error.isNotNull(), "failed").otherwise("pending")


def disposition_page(runs: DataFrame, number: int, size: int = 8) -> DataFrame:
    state = disposition(F.col("ok"), F.col("error"))
    return runs.withColumn("state", state).orderBy(F.desc("ran_at"), F.desc("id")).offset((number - 1) * size).limit(size)


SORTS = {
    "last_run": [("last_run_at", True)], "name": [("name", False)], "runs": [("runs", True)],
    "newest": [("created_at", True)], "oldest": [("created_at", False)],
}


def sort_library(queries: DataFrame, by: str) -> DataFrame:
    order = [F.desc_nulls_last(c) if down else F.asc(c) for c, down in SORTS[by]]
    return queries.orderBy(*order, "id")


def category_counts(templates: DataFrame, column: str = "category") -> DataFrame:
    """Templates per category and ``All``."""
    return templates.rollup(col(column)).agg(F.count("*").alias("n"), F.grouping(col(column)).alias("g")).select(
        F.when(F.col("g") == 1, "All").otherwise(col(column)).alias(column), "n"
    )


def inbound_references(tables: DataFrame, edges: DataFrame) -> DataFrame:
    """``(table, inbound)``, most referenced first; ``edges`` has ``source, target``."""
    counted = edges.groupBy(F.col("target").alias("table")).agg(F.count("*").alias("inbound"))
    return tables.join(counted, "table", "left").select(
        "table", F.coalesce("inbound", F.lit(0).cast("long")).alias("inbound")
    ).orderBy(F.desc("inbound"), "table")
