"""Governed metrics: declared metrics, filters, relationships and date policies
compiled to joins, predicates and aggregates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, datetime
from functools import reduce

from pyspark.errors import ParseException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions import values as V
from plumbline.plans import guard
from plumbline.session import col

# What a metric expression may use, grains, and the change worth a warning.
METRIC_FUNCTIONS = {"SUM", "COUNT", "AVG", "MIN", "MAX", "COALESCE", "NULLIF", "ROUND"}
METRIC_AGGREGATES = {"SUM", "COUNT", "AVG", "MIN", "MAX"}
GRAINS = {"day", "week", "month", "quarter", "year"}
CHANGE_LIMIT = 0.2
SAMPLE_ROWS = 1000


@dataclass(frozen=True)
class Relationship:
    left_table: str
    left_column: str
    right_table: str
    right_column: str
    join_type: str = "inner"
    cardinality: str | None = None


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str
    value: object = None


@dataclass(frozen=True)
class Filter:
    table: str
    conditions: tuple[Condition, ...]
    conjunction: str = "and"


@dataclass(frozen=True)
class DatePolicy:
    table: str
    column: str
    grain: str = "month"
    time_zone: str = "UTC"


@dataclass(frozen=True)
class Metric:
    expression: str
    tables: tuple[str, ...]
    relationships: tuple[Relationship, ...] = ()
    filters: tuple[Filter, ...] = ()
    date_policy: DatePolicy | None = None


@dataclass
class Check:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


_NESTED = ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "UnresolvedWindowExpression", "WindowExpression")


def check_metric(spark: SparkSession, metric: Metric, schemas: dict[str, list[str]]) -> Check:
    """Only aggregate arithmetic over declared, qualified columns passes."""
    found = Check()
    if re.search(r";|--|/\*|\*/|#", metric.expression):
        found.errors.append("unsafe_metric_expression")
        return found
    try:
        plan = guard.parse(spark, f"SELECT {metric.expression}")
    except ParseException:
        found.errors.append("invalid_metric_expression")
        return found
    declared = {t.lower(): {c.lower() for c in schemas.get(t, [])} for t in metric.tables}
    nodes = guard.statement_parts(plan)
    functions = set()
    if any(kind not in ("Project", "OneRowRelation") for kind, _, _ in nodes.plans):
        found.errors.append("unsafe_metric_expression")
    for kind, expr, parent in nodes.expressions:
        if kind in _NESTED:
            found.errors.append("unsafe_metric_expression")
        elif kind == "UnresolvedFunction":
            functions.add(guard.function_name(expr))
        elif kind == "UnresolvedAttribute":
            found.errors += _column_problem([p.lower() for p in guard._items(expr.nameParts())], declared)
        elif kind.startswith("UnresolvedStar") and not (parent is not None and guard.function_name(parent) == "COUNT"):
            found.errors.append("metric_wildcard_not_allowed")
        elif kind == "Divide":
            below = guard._items(expr.children())[1]
            if guard._name(below) != "Literal" and guard.function_name(below) != "NULLIF":
                found.warnings.append("metric_division_by_zero")
    if functions - METRIC_FUNCTIONS:
        found.errors.append("metric_function_not_allowed")
    if not functions & METRIC_AGGREGATES:
        found.errors.append("metric_aggregation_required")
    if len(metric.tables) > 1 and not metric.relationships:
        found.errors.append("metric_relationship_required")
    if metric.date_policy is None:
        found.warnings.append("metric_without_date_policy")
    found.errors = list(dict.fromkeys(found.errors))
    return found


def _column_problem(parts: list[str], declared: dict[str, set[str]]) -> list[str]:
    if len(parts) < 2:
        return ["metric_column_unqualified"]
    if parts[-2] not in declared:
        return ["metric_table_not_declared"]
    return [] if parts[-1] in declared[parts[-2]] else ["column_not_found"]


def check_definitions(definitions: DataFrame, tables: tuple[str, ...], schemas: dict[str, list[str]], expression: str = "expression") -> DataFrame:
    """The definitions with ``errors`` and ``warnings``.

    Spark's parser lives on the driver, so distinct expressions are read there one partition at a time and only the verdicts
    go back; they are joined to the definitions, of which there may be any number.
    """
    spark = definitions.sparkSession
    verdicts = []
    for (text,) in definitions.select(col(expression)).distinct().toLocalIterator():
        check = check_metric(spark, Metric(text or "", tables), schemas)
        verdicts.append((text, check.errors, check.warnings))
    judged = spark.createDataFrame(verdicts, "_text string, errors array<string>, warnings array<string>")
    return definitions.join(judged, col(expression).eqNullSafe(F.col("_text"))).drop("_text")


def condition_column(target: Column, condition: Condition) -> Column:
    value = condition.value
    like = lambda pattern: target.like(pattern)
    # ``%`` and ``_`` in the value keep their pattern meaning.
    return {
        "eq": lambda: target == F.lit(value), "neq": lambda: target != F.lit(value),
        "in": lambda: target.isin(list(value)), "not_in": lambda: ~target.isin(list(value)),
        "gt": lambda: target > F.lit(value), "gte": lambda: target >= F.lit(value),
        "lt": lambda: target < F.lit(value), "lte": lambda: target <= F.lit(value),
        "between": lambda: target.between(*[F.lit(v) for v in value]),
        "is_null": target.isNull, "is_not_null": target.isNotNull,
        "contains": lambda: like(f"%{value}%"), "starts_with": lambda: like(f"{value}%"), "ends_with": lambda: like(f"%{value}"),
    }[condition.operator]()


def filter_column(rule: Filter, qualified: bool = False) -> Column:
    """The rule as one predicate."""
    target = lambda c: F.col(f"{rule.table}.{c}") if qualified else col(c)
    parts = [condition_column(target(c.column), c) for c in rule.conditions]
    return reduce((lambda a, b: a | b) if rule.conjunction == "or" else (lambda a, b: a & b), parts)


def value_fits(condition: Condition, dtype: str) -> bool:
    """Whether the values of a condition suit a column type."""
    if condition.operator in ("is_null", "is_not_null"):
        return True
    values = condition.value if isinstance(condition.value, (list, tuple)) else [condition.value]

    def number(v):
        float(v)
        return True

    def moment(v):
        return isinstance(v, (date, datetime)) or bool(datetime.fromisoformat(str(v).replace("Z", "+00:00")))

    kind = dtype.lower()
    try:
        if re.search("int|numeric|decimal|float|double|real|money", kind):
            return all(number(v) for v in values)
        if "bool" in kind:
            return all(isinstance(v, bool) or str(v).strip().lower() in ("true", "false", "1", "0") for v in values)
        if re.search("date|time", kind):
            return all(moment(v) for v in values)
    except (TypeError, ValueError):
        return False
    return all(isinstance(v, (str, int, float, bool)) for v in values)


_NUMBER = r"(?i)^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"
_MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"


def values_fit(values: Column, dtype: Column, operator: Column) -> Column:
    """``value_fits`` for conditions kept as rows: ``values`` is an array of texts; a condition without values, or with a null among
    them, fits only where its operator needs none."""
    kind = F.lower(dtype)
    each = lambda rule: (F.size(values) > 0) & F.forall(values, lambda v: F.coalesce(rule(v), F.lit(False)))
    return F.coalesce(
        F.when(operator.isin("is_null", "is_not_null"), True)
        .when(kind.rlike("int|numeric|decimal|float|double|real|money"), each(lambda v: v.rlike(_NUMBER)))
        .when(kind.contains("bool"), each(lambda v: F.lower(F.trim(v)).isin("true", "false", "1", "0")))
        .when(kind.rlike("date|time"), each(lambda v: v.rlike(_MOMENT) & v.try_cast("timestamp").isNotNull()))
        .otherwise(each(lambda v: v.isNotNull())), F.lit(False))


def metric_source(tables: dict[str, DataFrame], metric: Metric) -> DataFrame:
    """The declared joins and filters; filters on one table go to its scan."""
    df = tables[metric.tables[0]].alias(metric.tables[0])
    for r in metric.relationships:
        right = tables[r.right_table].alias(r.right_table)
        on = F.col(f"{r.left_table}.{r.left_column}") == F.col(f"{r.right_table}.{r.right_column}")
        df = df.join(right, on, "left" if r.join_type == "left" else "inner")
    for rule in metric.filters:
        df = df.filter(filter_column(rule, qualified=True))
    return df


def grain_column(policy: DatePolicy, qualified: bool = False) -> Column:
    """Start of the period in the policy's time zone."""
    if policy.grain not in GRAINS:
        raise ValueError(f"unknown grain {policy.grain!r}")
    at = F.col(f"{policy.table}.{policy.column}") if qualified else col(policy.column)
    local = at if policy.time_zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(policy.time_zone), at.cast("timestamp_ntz"))
    return F.date_trunc(policy.grain, local)


def compute_metric(tables: dict[str, DataFrame], metric: Metric, by: list[Column] | None = None) -> DataFrame:
    """``metric_value``, in all or per dimension and period."""
    value = F.expr(metric.expression).alias("metric_value")
    source = metric_source(tables, metric)
    return source.groupBy(*by).agg(value) if by else source.agg(value)


def _sample(df: DataFrame, rows: int | None, key: Column) -> DataFrame:
    """Rows with the smallest key hashes: the same sample on every run."""
    return df if rows is None else df.orderBy(F.xxhash64(key), key).limit(rows)


def filter_impact(df: DataFrame, rule: Filter, rows: int | None = None, key: str | None = None) -> DataFrame:
    """Rows before and after a filter; over the whole table, or a sample when asked."""
    source = _sample(df, rows, col(key)) if rows else df
    return source.agg(F.count("*").alias("before_count"), F.count_if(filter_column(rule)).alias("after_count"))


def relationship_probe(left: DataFrame, left_column: str, right: DataFrame, right_column: str, rows: int | None = None) -> DataFrame:
    """Key counts, matched pairs and duplicate keys of both sides.

    Each side is reduced to one row per key before the join, so a key that fills
    a third of a table is a single row there and pairs are counted by product.
    """
    def keys(df, name, out):
        kept = _sample(df.select(col(name).alias("k")).filter(F.col("k").isNotNull()), rows, F.col("k"))
        return kept.groupBy("k").agg(F.count("*").alias(out))

    joined = keys(left, left_column, "l").join(keys(right, right_column, "r"), "k", "full_outer")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return joined.agg(
        total("l").alias("left_count"), total("r").alias("right_count"), total(F.col("l") * F.col("r")).alias("matched_count"),
        F.count_if(F.col("l") > 1).alias("left_duplicate_keys"), F.count_if(F.col("r") > 1).alias("right_duplicate_keys"),
    )


def check_cardinality(probe: DataFrame, declared: str) -> DataFrame:
    """Warn where duplicate keys contradict the declared cardinality."""
    left, right = F.col("left_duplicate_keys") > 0, F.col("right_duplicate_keys") > 0
    broken = {"one_to_one": left | right, "one_to_many": left, "many_to_one": right}.get(declared, F.lit(False))
    return probe.withColumn("declared", F.lit(declared)).withColumn(
        "warning", F.when(broken, F.lit("cardinality_mismatch"))
    )


def date_probe(df: DataFrame, column: str) -> DataFrame:
    """Range, rows, nulls and the share of nulls of a date column."""
    nulls = F.count_if(col(column).isNull())
    return df.agg(
        F.min(col(column)).alias("minimum"), F.max(col(column)).alias("maximum"), F.count("*").alias("total_count"),
        nulls.alias("null_count"), V.pct(nulls, F.count("*")).alias("null_pct"),
    )


def change_warning(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old and new metric values per key, with a warning for a change of a fifth or more."""
    joined = old.withColumnRenamed("metric_value", "old_value").join(new.withColumnRenamed("metric_value", "new_value"), keys, "full_outer")
    change = F.abs(F.col("new_value") - F.col("old_value")) / F.greatest(F.abs("old_value"), F.lit(1.0))
    return joined.withColumn("change", change).withColumn("warning", F.when(F.col("change") >= CHANGE_LIMIT, F.lit("large_change")))
