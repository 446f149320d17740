"""A tidy report: ``(section, ordinal, key, value_json)``.

Sections arrive as summary frames and are turned into JSON by Spark; nothing in
a report is larger than a few rows per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions import values as V

TOP_ISSUES, TOP_FEATURES = 8, 10
REPORT = "section string, ordinal int, key string, value_json string"


def _section(name: str, ordinal: int, key: str, frame: DataFrame) -> DataFrame:
    rows = V.json_safe(frame).select(F.struct("*").alias("r"))
    packed = F.to_json(F.collect_list("r"), {"ignoreNullFields": "false"})
    return rows.agg(packed.alias("value_json")).select(
        F.lit(name).alias("section"), F.lit(ordinal).alias("ordinal"), F.lit(key).alias("key"), "value_json"
    )


def kind_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy("kind").agg(F.count("*").alias("columns")).orderBy("kind")


def recommendations(score: DataFrame, issues: DataFrame, cleaned: bool, best_model: str | None) -> DataFrame:
    """Next steps that follow from the other sections, most pressing first."""
    row = score.first()
    steps = []
    if row["overall"] < 75 and not cleaned:
        steps.append("clean the data before drawing conclusions")
    severe = issues.filter(F.col("severity") == "high").select("title").limit(3).collect()
    steps += [f"resolve first: {r['title']}" for r in severe]
    if best_model:
        steps.append(f"check {best_model} on new data before using it")
    if not steps:
        steps.append("no pressing step; the data is ready for analysis")
    return issues.sparkSession.createDataFrame(list(enumerate(steps)), "position int, step string")


def summary_text(name: str, rows: int, columns: int, score: DataFrame, best_model: str | None = None, metric: str | None = None, value=None) -> str:
    row = score.first()
    text = f"{name} has {rows:,} rows and {columns} columns; its quality is {row['grade']} ({row['overall']:.1f} of 100, {row['issues']} issues)."
    if best_model:
        text += f" The best model is {best_model} ({metric} {value:.3f})."
    return text


def build_report(name: str, facts: DataFrame, issues: DataFrame, score: DataFrame, dimensions: DataFrame, cleaning: DataFrame | None = None,
                 numeric: DataFrame | None = None, categorical: DataFrame | None = None, pairs: DataFrame | None = None,
                 findings: DataFrame | None = None, trained=None, narrative: str | None = None) -> DataFrame:
    """Overview, quality, cleaning, exploration, models, next steps and a summary."""
    size = facts.agg(F.max("rows").alias("rows"), F.count("*").alias("columns"))
    listed = [("overview", "size", size), ("overview", "kinds", kind_counts(facts)), ("quality", "score", score), ("quality", "dimensions", dimensions),
              ("quality", "top_issues", issues.select("title", "severity", "recommendation").limit(TOP_ISSUES))]
    listed += [(s, k, f) for s, k, f in (
        ("cleaning", "before_after", cleaning), ("exploration", "numeric_summary", numeric), ("exploration", "categorical_summary", categorical),
        ("exploration", "top_correlations", pairs), ("exploration", "findings", findings)) if f is not None]
    best = None
    if trained is not None:
        best = trained.best_model
        listed.append(("models", "comparison", trained.comparison_frame()))
        if trained.importance is not None:
            listed.append(("models", "importance", trained.importance.limit(TOP_FEATURES)))
    listed.append(("next_steps", "steps", recommendations(score, issues, cleaning is not None, best)))
    out = None
    for i, (section, key, frame) in enumerate(listed):
        part = _section(section, i, key, frame)
        out = part if out is None else out.unionByName(part)
    counts = size.first()
    value = next((r[trained.primary_metric] for r in trained.comparison if r["model"] == best), None) if trained else None
    text = narrative or summary_text(name, counts["rows"], counts["columns"], score, best, trained.primary_metric if trained else None, value)
    closing = out.sparkSession.createDataFrame([("summary", len(listed), "text", text)], REPORT)
    return out.unionByName(closing)
