"""Data-quality detectors and the quality score.

Every detector is a projection over the column facts (one row per column), so
after the profile only three kinds of pass touch the table again: duplicate
rows, label levels, and fence counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions import counts as C, ranks as R, text as X, values as V
from plumbline.operators import duplicates as D, kinds as K, profile as P

# Score dimensions in order, penalties, severity order, name hints, limits.
DIMENSIONS = {
    "missing_values": "Missing Values",
    "duplicates": "Duplicates",
    "data_types": "Data Types",
    "categorical_consistency": "Categorical Consistency",
    "outliers": "Outliers",
    "constant_columns": "Constant Columns",
    "potential_leakage": "Potential Leakage",
}
PENALTY = {"info": 2, "low": 6, "medium": 16, "high": 34}
SEVERITY_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3}
LEAKAGE_HINTS = [
    "prediction", "predicted", "score", "probability", "outcome", "target", "label", "churned", "is_fraud", "future",
]
MIN_OUTLIER_ROWS, MIN_OUTLIER_VALUES = 12, 5

ISSUE_SCHEMA = (
    "detector int, ordinal int, code string, dimension string, severity string, title string, "
    "columns array<string>, evidence map<string,string>, recommendation string, "
    "operation string, params map<string,string>"
)


def _text_map(**entries: Column) -> Column:
    pairs = [part for k, v in entries.items() for part in (F.lit(k), v.cast("string"))]
    return F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")


def _issue(frame: DataFrame, detector: int, dimension: str, code: Column, severity: Column, title: Column,
           evidence: Column, recommendation: Column, operation: Column | None = None,
           params: Column | None = None, whole_table: bool = False) -> DataFrame:
    none = F.lit(None)
    return frame.select(
        F.lit(detector).alias("detector"),
        (F.lit(0) if whole_table else F.col("ordinal")).cast("int").alias("ordinal"),
        code.alias("code"),
        F.lit(dimension).alias("dimension"),
        severity.alias("severity"),
        title.alias("title"),
        (F.expr("cast(array() as array<string>)") if whole_table else F.array("column")).alias("columns"),
        evidence.alias("evidence"),
        recommendation.alias("recommendation"),
        (none if operation is None else operation).cast("string").alias("operation"),
        (none if params is None else params).cast("map<string,string>").alias("params"),
    )


def _named(text: str) -> Column:
    """A sentence with the column name in place of ``{}``."""
    before, after = text.split("{}")
    return F.concat(F.lit(before), F.col("column"), F.lit(after))


def missing_issues(facts: DataFrame) -> DataFrame:
    share = 100.0 * F.col("missing") / F.col("rows")
    drop = (F.col("missing") == F.col("rows")) | (share >= 40)
    severity = F.when(drop, "high").when(share >= 5, "medium").otherwise("low")
    text = F.concat(F.format_number(share, 1), F.lit("% of the values are missing; "))
    advice = (
        F.when(F.col("missing") == F.col("rows"), F.lit("the column is empty, drop it"))
        .when(share >= 40, F.concat(text, F.lit("drop the column or the affected rows")))
        .when(share >= 5, F.concat(text, F.lit("impute with a strategy that suits the column")))
        .otherwise(F.concat(text, F.lit("safe to impute")))
    )
    params = F.when(drop, _text_map(column=F.col("column"))).otherwise(
        _text_map(column=F.col("column"), strategy=F.lit("auto"))
    )
    return _issue(
        facts.filter((F.col("missing") > 0) & (F.col("rows") > 0)), 1, "missing_values",
        F.concat(F.lit("missing::"), "column"), severity, _named("'{}' has missing values"),
        _text_map(missing=F.col("missing"), missing_pct=V.pct(F.col("missing"), F.col("rows"))),
        advice, F.when(drop, "drop_column").otherwise("impute_missing"), params,
    )


def duplicate_issues(duplicates: DataFrame, rows: int) -> DataFrame:
    """From the one-row frame of ``duplicates.duplicate_rows``."""
    n = F.col("duplicate_rows")
    share = F.try_divide(100.0 * n, F.lit(rows))
    return _issue(
        duplicates.filter(n > 0), 2, "duplicates", F.lit("duplicates::rows"),
        F.when(share >= 5, "high").when(share >= 1, "medium").otherwise("low"),
        F.lit("Exact duplicate rows"),
        _text_map(duplicate_rows=n, duplicate_pct=V.pct(n, F.lit(rows))),
        F.concat(n.cast("string"), F.lit(" rows share all values with another row; keep the first of each group")),
        F.lit("drop_duplicates"), _text_map(keep=F.lit("first")), whole_table=True,
    )


def looks_like_id() -> Column:
    """``id``, ``*_id``, or ``*id`` on a column that is not text."""
    name = F.lower("column")
    return (name == "id") | name.endswith("_id") | (name.endswith("id") & (F.col("dtype") != "string"))


def identifier_issues(facts: DataFrame) -> DataFrame:
    return _issue(
        facts.filter(looks_like_id() & (F.col("repeated") > 0)), 3, "duplicates",
        F.concat(F.lit("duplicates::id::"), "column"), F.lit("medium"), _named("Identifier '{}' is not unique"),
        _text_map(duplicate_values=F.col("repeated")),
        _named("'{}' is named like an identifier but repeats values; look into it before modelling"),
    )


def type_issues(facts: DataFrame) -> DataFrame:
    labels = facts.filter(F.col("kind").isin(K.CATEGORICAL, K.TEXT))
    numbers = _issue(
        labels.filter(F.col("numeric_like") >= 0.9), 4, "data_types",
        F.concat(F.lit("dtype::numeric_string::"), "column"), F.lit("medium"),
        _named("'{}' holds numbers stored as text"),
        _text_map(numeric_like_pct=F.round(100 * F.col("numeric_like"), 2)),
        _named("Convert '{}' to numbers before analysis"),
        F.lit("to_numeric"), _text_map(column=F.col("column")),
    )
    dates = _issue(
        labels.filter((F.col("numeric_like") < 0.9) & (F.col("date_like") >= 0.9)), 4, "data_types",
        F.concat(F.lit("dtype::date_string::"), "column"), F.lit("low"), _named("'{}' holds dates stored as text"),
        _text_map(date_like_pct=F.round(100 * F.col("date_like"), 2)),
        _named("Parse '{}' as a time to allow analysis over time"),
        F.lit("to_datetime"), _text_map(column=F.col("column")),
    )
    return numbers.unionByName(dates)


def label_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """``grouped_levels`` of the columns of a table."""
    return grouped_levels(C.value_counts(df, columns))


def grouped_levels(counts: DataFrame) -> DataFrame:
    """Per column of a value-count frame: raw levels, canonical levels, colliding groups (five examples) and untrimmed levels (ten examples).

    Examples are chosen by rank, which Spark cuts before the shuffle, so a column may have any number of levels.
    """
    levels = counts.select("column", F.col("txt").alias("label"))
    levels = levels.withColumn("canon", X.canonical(F.col("label")))
    groups = levels.groupBy("column", "canon").agg(F.count("*").alias("raw"))
    counted = groups.groupBy("column").agg(
        F.sum("raw").alias("raw_levels"), F.count("*").alias("canonical_levels"), F.count_if(F.col("raw") > 1).alias("collisions"))
    first = Window.partitionBy("column").orderBy("canon")
    clash = groups.filter(F.col("raw") > 1).withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= 5)
    shown = clash.join(levels, ["column", "canon"]).groupBy("column", "canon").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    shown = shown.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("canon", "labels"))).alias("examples"))
    loose = levels.filter(F.col("label") != X.strip(F.col("label")))
    loose = loose.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy("label"))).filter(F.col("rank") <= 10)
    loose = loose.groupBy("column").agg(F.sort_array(F.collect_list("label")).alias("untrimmed_levels"))
    none = F.expr("cast(array() as array<string>)")
    return counted.join(shown, "column", "left").join(loose, "column", "left").select(
        *counted.columns, F.coalesce("examples", F.expr("cast(array() as array<struct<canon:string,labels:array<string>>>)")).alias("examples"),
        F.coalesce("untrimmed_levels", none).alias("untrimmed_levels"))


def label_columns(facts: DataFrame) -> list[str]:
    rows = facts.filter(F.col("kind") == K.CATEGORICAL).orderBy("ordinal")
    return [r["column"] for r in rows.select("column").collect()]


def label_issues(df: DataFrame, facts: DataFrame) -> DataFrame:
    columns = label_columns(facts)
    if not columns:
        return df.sparkSession.createDataFrame([], ISSUE_SCHEMA)
    return level_issues(label_groups(df, columns), facts)


def level_issues(groups: DataFrame, facts: DataFrame) -> DataFrame:
    """From the frame of ``grouped_levels``."""
    found = groups.join(facts.select("column", "ordinal"), "column")
    examples = F.to_json(F.transform("examples", lambda e: e["labels"]))
    mixed = _issue(
        found.filter(F.col("collisions") > 0), 5, "categorical_consistency",
        F.concat(F.lit("category::inconsistent::"), "column"), F.lit("medium"),
        _named("'{}' has inconsistent category labels"),
        _text_map(raw_level_count=F.col("raw_levels"), canonical_level_count=F.col("canonical_levels"), examples=examples),
        F.concat(F.col("collisions").cast("string"), _named(" label groups of '{}' differ only by case or spacing")),
        F.lit("standardize_categories"), _text_map(column=F.col("column")),
    )
    loose = _issue(
        found.filter((F.col("collisions") == 0) & (F.size("untrimmed_levels") > 0)), 5, "categorical_consistency",
        F.concat(F.lit("category::whitespace::"), "column"), F.lit("low"),
        _named("'{}' has leading or trailing blanks"),
        _text_map(affected_levels=F.to_json("untrimmed_levels")), _named("Trim the labels of '{}'"),
        F.lit("trim_whitespace"), _text_map(column=F.col("column")),
    )
    return mixed.unionByName(loose)


def outlier_columns(facts: DataFrame) -> list[str]:
    rows = facts.filter(
        (F.col("kind") == K.NUMERIC) & (F.col("count") >= MIN_OUTLIER_ROWS) & (F.col("unique") >= MIN_OUTLIER_VALUES)
    ).orderBy("ordinal")
    return [r["column"] for r in rows.select("column").collect()]


def outlier_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, count, iqr_outliers, modified_z_outliers, lower_fence, upper_fence)``.

    Three bounded passes: quartiles and medians, medians of the absolute
    deviations, then both counts together.
    """
    schema = ("column string, count long, iqr_outliers long, modified_z_outliers long, "
              "lower_fence double, upper_fence double")
    q = R.quantile_map(df, columns, [0.25, 0.5, 0.75])
    limits = {c: f for c, f in P.fences(q).items() if f[0] < f[1]}
    if not limits:
        return df.sparkSession.createDataFrame([], schema)
    names = list(limits)
    deviations = df.select([F.abs(V.as_number(df, c) - q[c][0.5]).alias(c) for c in names])
    mad = {c: m.get(0.5) or 1e-9 for c, m in R.quantile_map(deviations, names, [0.5]).items()}
    cells = [
        F.struct(
            F.lit(c).alias("column"), V.as_number(df, c).alias("num"), F.lit(limits[c][0]).alias("lo"),
            F.lit(limits[c][1]).alias("hi"), F.lit(q[c][0.5]).alias("med"), F.lit(mad[c]).alias("mad"),
        )
        for c in names
    ]
    x = F.col("num")
    z = 0.6745 * F.abs(x - F.col("med")) / F.col("mad")
    return df.select(F.inline(F.array(*cells))).filter(x.isNotNull()).groupBy("column").agg(
        F.count("*").alias("count"),
        F.count_if((x < F.col("lo")) | (x > F.col("hi"))).alias("iqr_outliers"),
        F.count_if(z > 3.5).alias("modified_z_outliers"),
        F.round(F.max("lo"), 4).alias("lower_fence"),
        F.round(F.max("hi"), 4).alias("upper_fence"),
    )


def outlier_issues(counted: DataFrame, facts: DataFrame) -> DataFrame:
    found = counted.filter(F.col("iqr_outliers") > 0).join(facts.select("column", "ordinal"), "column")
    share = 100.0 * F.col("iqr_outliers") / F.col("count")
    return _issue(
        found, 6, "outliers", F.concat(F.lit("outliers::"), "column"),
        F.when(share >= 5, "medium").otherwise("low"), _named("'{}' contains outliers"),
        _text_map(
            iqr_outliers=F.col("iqr_outliers"), outlier_pct=F.round(share, 2),
            modified_zscore_outliers=F.col("modified_z_outliers"),
            lower_fence=F.col("lower_fence"), upper_fence=F.col("upper_fence"),
        ),
        F.concat(F.col("iqr_outliers").cast("string"), _named(" values of '{}' lie outside the 1.5 IQR fences; review them first")),
        F.lit("handle_outliers"), _text_map(column=F.col("column"), strategy=F.lit("flag")),
    )


def constant_issues(facts: DataFrame) -> DataFrame:
    constant = _issue(
        facts.filter(P.is_constant()), 7, "constant_columns", F.concat(F.lit("constant::"), "column"), F.lit("low"),
        _named("'{}' is constant"), _text_map(unique_values=F.col("unique")),
        _named("'{}' has one value only and carries no signal; drop it"),
        F.lit("drop_column"), _text_map(column=F.col("column")),
    )
    near = _issue(
        facts.filter(P.is_near_constant() & (F.col("kind") != K.BOOLEAN)), 7, "constant_columns",
        F.concat(F.lit("near_constant::"), "column"), F.lit("info"), _named("'{}' is near-constant"),
        _text_map(dominant_value_pct=F.round(100 * P.top_share(), 2)),
        _named("Almost all of '{}' is one value; it adds little"),
    )
    return constant.unionByName(near)


def leakage_issues(facts: DataFrame) -> DataFrame:
    return _issue(
        facts.filter(F.lower("column").rlike("|".join(LEAKAGE_HINTS))), 8, "potential_leakage",
        F.concat(F.lit("leakage::name::"), "column"), F.lit("info"), _named("'{}' may leak the target"),
        _text_map(reason=F.lit("the name suggests a value known only after the outcome")),
        _named("Check '{}' before modelling and leave it out if it is known only after the outcome"),
    )


def analyze_quality(df: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """All issues, most severe first, then in detector and column order."""
    facts = P.column_facts(df) if facts is None else facts
    rows = facts.agg(F.max("rows")).first()[0] or 0
    parts = [
        missing_issues(facts),
        duplicate_issues(D.duplicate_rows(df), rows),
        identifier_issues(facts),
        type_issues(facts),
        label_issues(df, facts),
        outlier_issues(outlier_counts(df, outlier_columns(facts)), facts),
        constant_issues(facts),
        leakage_issues(facts),
    ]
    issues = parts[0]
    for part in parts[1:]:
        issues = issues.unionByName(part)
    # At most a few issues per column: hold them locally, so score and advice need no further pass.
    found = df.sparkSession.createDataFrame(issues.collect(), ISSUE_SCHEMA)
    return found.withColumn("severity_rank", severity_rank()).orderBy(F.desc("severity_rank"), "detector", "ordinal")


def severity_rank() -> Column:
    return _lookup(SEVERITY_RANK, F.col("severity"))


def _lookup(table: dict[str, int], key: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def dimension_scores(issues: DataFrame) -> DataFrame:
    """``(ordinal, dimension, label, score, issues)`` for all seven dimensions."""
    listed = issues.sparkSession.createDataFrame(
        [(i, k, label) for i, (k, label) in enumerate(DIMENSIONS.items())], "ordinal int, dimension string, label string"
    )
    lost = issues.groupBy("dimension").agg(
        F.sum(_lookup(PENALTY, F.col("severity"))).alias("lost"), F.count("*").alias("issues")
    )
    return listed.join(F.broadcast(lost), "dimension", "left").select(
        "ordinal", "dimension", "label",
        F.greatest(F.lit(0.0), 100.0 - F.coalesce("lost", F.lit(0))).alias("score"),
        F.coalesce("issues", F.lit(0).cast("long")).alias("issues"),
    )


def grade(score: Column) -> Column:
    return (
        F.when(score >= 90, "excellent").when(score >= 75, "good").when(score >= 60, "fair")
        .when(score >= 40, "poor").otherwise("critical")
    )


def overall_score(issues: DataFrame) -> DataFrame:
    """One row ``(overall, grade, issues)``."""
    overall = F.round(F.avg("score"), 1)
    return dimension_scores(issues).agg(overall.alias("overall"), F.sum("issues").alias("issues")).select(
        "overall", grade(F.col("overall")).alias("grade"), "issues"
    )
