"""Cleaning recommendations derived from quality issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def recommend(issues: DataFrame, facts: DataFrame) -> DataFrame:
    """``(id, column, operation, params, solution, reason, impact, risk)`` per fixable issue.

    Skew and missing counts are read from the facts, so no pass over the table
    is needed.
    """
    known = facts.select("column", "kind", "skew", "missing", "rows")
    wanted = issues.filter(F.col("operation").isNotNull()).withColumn("column", F.get("columns", F.lit(0)))
    joined = wanted.join(F.broadcast(known), "column", "left")
    numeric = F.col("kind") == "numeric"
    skewed = F.abs("skew") > 1
    strategy = F.when(numeric, F.when(skewed, "median").otherwise("mean")).otherwise("mode")
    op = F.col("operation")
    impute = op == "impute_missing"
    params = F.when(
        impute, F.create_map(F.lit("column"), F.col("column"), F.lit("strategy"), strategy)
    ).otherwise(F.col("params"))
    solution = (
        F.when(impute, F.concat(strategy, F.lit(" imputation")))
        .when(op == "drop_column", F.concat(F.lit("drop "), "column"))
        .when(op == "drop_duplicates", F.lit("drop repeated rows, keep the first"))
        .when(op == "standardize_categories", F.lit("one spelling per label"))
        .when(op == "trim_whitespace", F.lit("trim blanks"))
        .when(op == "to_numeric", F.lit("convert to numbers"))
        .when(op == "to_datetime", F.lit("convert to times"))
        .when(op == "handle_outliers", F.lit("flag outliers, remove nothing"))
    )
    reason = (
        F.when(impute & numeric & skewed, F.lit("skewed numbers: the median resists extreme values"))
        .when(impute & numeric, F.lit("roughly symmetric numbers: the mean fits"))
        .when(impute, F.lit("the most frequent label keeps the distribution stable"))
        .when(op == "drop_column", F.col("recommendation"))
        .when(op == "drop_duplicates", F.lit("repeated rows inflate counts and bias every statistic"))
        .when(op.isin("standardize_categories", "trim_whitespace"), F.lit("label variants split groups and charts"))
        .when(op.isin("to_numeric", "to_datetime"), F.lit("text cannot be summed, scaled or ordered in time"))
        .when(op == "handle_outliers", F.lit("outliers are often real; a flag keeps the choice open"))
    )
    impact = (
        F.when(impute, F.concat(F.lit("fills "), F.col("missing").cast("string"), F.lit(" cells, keeps all rows")))
        .when(op == "drop_column", F.lit("removes one column, keeps all rows"))
        .when(op == "drop_duplicates", F.lit("removes all but the first of each group of equal rows"))
        .when(op == "handle_outliers", F.lit("adds one boolean column"))
        .when(op.isin("to_numeric", "to_datetime"), F.lit("changes the type; values that do not parse become missing"))
        .otherwise(F.lit("changes labels, keeps all rows"))
    )
    risk = (
        F.when(impute, F.when(F.col("severity").isin("low", "info"), "low").otherwise("medium"))
        .when(op == "drop_column", "medium").otherwise("low")
    )
    return joined.select(
        F.col("code").alias("id"), "column", op.alias("operation"), params.alias("params"),
        solution.alias("solution"), reason.alias("reason"), impact.alias("impact"), risk.alias("risk"),
        "severity", "severity_rank", "detector", "ordinal",
    ).orderBy(F.desc("severity_rank"), "detector", "ordinal")


def safe_fixes(recommendations: DataFrame) -> DataFrame:
    """The recommendations that carry no risk."""
    return recommendations.filter(F.col("risk") == "low")


def as_operations(recommendations: DataFrame) -> list[dict]:
    """Recommendations as the operator list that ``clean.apply_operations`` takes."""
    return [{"op": r["operation"], "params": dict(r["params"] or {})} for r in recommendations.collect()]
