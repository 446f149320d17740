"""Catalog metadata as frames: inventory, semantic types, sensitivity, importance, search."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions import values as V
from plumbline.plans import guard
from plumbline.session import col

# Name and type patterns of semantic types, sensitive names, label-like names.
SEMANTIC_RULES = {
    "money_name": "amount|price|revenue|cost|total|fee|salary|payment|paid",
    "date_name": "^date$|_date$|_at$|timestamp|datetime",
    "category_name": "type|status|category|tier|kind|mode|state|level|role|gender|priority|source|method|format",
    "person_name": "^name$|_name$|first_name|last_name|full_name",
    "phone_name": "phone|mobile",
    "numeric_type": "int|numeric|decimal|float|double|real|money",
    "text_type": "text|varchar|char|string",
}
SENSITIVE_NAMES = [
    "email", "phone", "mobile", "address", "token", "secret", "password", "passwd", "ssn", "iban", "card", "dob", "birth", "salary",
    "api_key", "auth_key",
]
SENSITIVE_TYPES = ["email", "phone", "name", "address", "free_text"]
OPAQUE_ID_WORDS = "uuid|guid|token|hash"
INTERNAL_NAMES = "audit|log|migration|_history|alembic|celery|pg_|information_schema"
DATE_COLUMNS = ["created_at", "order_date", "placed_at", "timestamp"]
ENUM_LEVELS = 15
FILTER_OPERATORS = ["=", "!=", ">", ">=", "<", "<=", "like", "ilike", "is_null", "is_not_null"]


def list_tables(spark: SparkSession, schemas: list[str] | None = None, pattern: str = "*") -> DataFrame:
    """``(schema, table, is_temporary)`` without system schemas."""
    rows = []
    for db in schemas or [d.name for d in spark.catalog.listDatabases()]:
        if guard.is_system_schema(db):
            continue
        rows += [(db, t.name, t.isTemporary) for t in spark.catalog.listTables(db) if fnmatch.fnmatch(t.name, pattern)]
    return spark.createDataFrame(rows, "schema string, table string, is_temporary boolean")


def extract(spark: SparkSession, tables: dict[str, DataFrame], keys: dict[str, str] | None = None,
            foreign: dict[tuple[str, str], tuple[str, str]] | None = None) -> DataFrame:
    """``(table, ordinal, column, dtype, nullable, is_key, ref_table, ref_column, rows)``.

    Row counts come from one counting job over all tables; a parquet count
    reads file footers only.
    """
    keys, foreign = keys or {}, foreign or {}
    rows = []
    for name, df in tables.items():
        for i, f in enumerate(df.schema.fields):
            target = foreign.get((name, f.name), (None, None))
            rows.append((name, i, f.name, f.dataType.simpleString(), f.nullable, keys.get(name) == f.name, *target))
    described = spark.createDataFrame(
        rows, "table string, ordinal int, column string, dtype string, nullable boolean, is_key boolean, ref_table string, ref_column string"
    )
    counts = None
    for name, df in tables.items():
        part = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        counts = part if counts is None else counts.unionByName(part)
    return described.join(F.broadcast(counts), "table")


def semantic_type() -> Column:
    """Meaning of a column from its name and type; the first rule that fits wins."""
    name, dtype = F.lower("column"), F.lower("dtype")
    rule = lambda c, key: c.rlike(SEMANTIC_RULES[key])
    text = rule(dtype, "text_type")
    number = rule(dtype, "numeric_type")
    return (
        F.when(name.contains("email"), "email")
        .when(rule(name, "phone_name"), "phone")
        .when(rule(name, "person_name"), "name")
        .when(rule(name, "money_name") & number, "money")
        .when(rule(name, "date_name"), F.when(dtype.contains("timestamp") | name.contains("_at"), "datetime").otherwise("date"))
        .when(rule(name, "category_name") & text, "category")
        .when(dtype.contains("bool"), "boolean")
        .when(dtype.contains("json") | dtype.contains("variant"), "json")
        .when(number, F.when(name.contains("count") | name.contains("qty"), "quantity").otherwise("numeric"))
        .when(text, F.when((F.length(name) <= 4) | name.endswith("_id"), "identifier").otherwise("free_text"))
        .otherwise("unknown")
    )


def is_sensitive(meaning: Column) -> Column:
    name = F.lower("column")
    named = name.rlike(f"(?:^|_)(?:{'|'.join(SENSITIVE_NAMES)})(?:$|_)")
    return meaning.isin(SENSITIVE_TYPES) | named | ((meaning == "identifier") & name.rlike(OPAQUE_ID_WORDS))


def annotate(catalog: DataFrame) -> DataFrame:
    meaning = semantic_type()
    internal = F.regexp_replace(F.lower("table"), r"^.*\.", "").rlike(INTERNAL_NAMES)
    return catalog.withColumn("semantic_type", meaning).withColumn("is_sensitive", is_sensitive(F.col("semantic_type"))).withColumn(
        "is_internal", internal
    )


def edges(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("ref_table").isNotNull()).select(
        F.col("table").alias("source"), F.col("column").alias("source_column"), F.col("ref_table").alias("target"),
        F.col("ref_column").alias("target_column"),
    )


def importance(annotated: DataFrame) -> DataFrame:
    """``(table, rows, is_internal, importance)`` from references and size; internal tables get 0."""
    linked = edges(annotated).select(F.explode(F.array("source", "target")).alias("table")).groupBy("table").agg(F.count("*").alias("links"))
    tables = annotated.groupBy("table").agg(F.max("rows").alias("rows"), F.bool_or("is_internal").alias("is_internal"))
    by_links = F.least(F.coalesce("links", F.lit(0)) / 10, F.lit(1.0))
    by_rows = F.when(F.col("rows") > 0, F.least(F.log10(F.col("rows") + 1) / 6, F.lit(1.0))).otherwise(0.0)
    score = F.when(F.col("is_internal"), 0.0).otherwise(F.round(0.6 * by_links + 0.4 * by_rows, 3))
    return tables.join(linked, "table", "left").select("table", "rows", "is_internal", score.alias("importance"))


def schema_hash(catalog: DataFrame) -> DataFrame:
    """A 16-digit fingerprint of all columns and references; the catalog is small by nature."""
    line = F.concat_ws(":", "table", "column", "dtype", F.col("is_key").cast("string"))
    link = F.when(F.col("ref_table").isNotNull(), F.concat(F.lit("fk:"), "table", F.lit(":"), "column", F.lit("->"), "ref_table", F.lit("."), "ref_column"))
    lines = catalog.select(F.explode(F.array_compact(F.array(line, link))).alias("line"))
    text = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    return lines.agg(F.substring(F.sha2(text, 256), 1, 16).alias("hash"))


def enum_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if V.is_text(df, c) and any(w in c.lower() for w in SEMANTIC_RULES["category_name"].split("|"))]


def enum_samples(df: DataFrame, columns: list[str] | None = None, levels: int = ENUM_LEVELS) -> DataFrame:
    """``(column, values)`` of label-like columns with at most ``levels`` distinct values.

    Labels are grouped first; per column only the smallest ``levels + 1`` are kept.
    """
    from pyspark.sql import Window

    names = enum_columns(df) if columns is None else columns
    if not names:
        return df.sparkSession.createDataFrame([], "column string, values array<string>")
    cells = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in names]
    labels = df.select(F.inline(F.array(*cells))).filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("column").orderBy("value")
    few = labels.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= levels + 1)
    return few.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("values")).filter(F.size("values") <= levels)


def sample_values(df: DataFrame, column: str, levels: int = ENUM_LEVELS) -> DataFrame:
    """Sorted distinct labels of one column; refused when there are more than ``levels``."""
    found = df.select(col(column).alias("value")).filter(F.col("value").isNotNull()).distinct().orderBy("value").limit(levels + 1)
    total = found.agg(F.count("*").alias("n")).scalar()
    return found.filter(total <= levels)


def default_date_column(annotated: DataFrame) -> DataFrame:
    """``(table, date_column)``: a well-known name, a creation time, else the first date-like column."""
    name = F.lower("column")
    dated = F.col("semantic_type").isin("datetime", "date") | F.col("dtype").startswith("timestamp") | (F.col("dtype") == "date")
    rank = F.when(name.isin(DATE_COLUMNS) | (dated & name.contains("created")), 0).when(dated, 1)
    ranked = annotated.withColumn("rank", rank).filter(F.col("rank").isNotNull())
    return ranked.groupBy("table").agg(F.min_by("column", F.struct("rank", "ordinal")).alias("date_column"))


def safe_columns(annotated: DataFrame, table: str) -> list[str]:
    rows = annotated.filter((F.col("table") == table) & ~F.col("is_sensitive")).orderBy("ordinal").select("column").collect()
    return [r["column"] for r in rows]


def preview(df: DataFrame, annotated: DataFrame, table: str, order_by: str, rows: int = 5) -> DataFrame:
    return df.orderBy(col(order_by)).limit(rows).select([col(c) for c in safe_columns(annotated, table)])


def quick_profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """``(column, rows, count, distinct)``; ``approximate`` counts distinct values with a sketch."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    cells = [
        F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count(col(c)).alias("count"), distinct(col(c)).alias("distinct"))
        for c in columns or df.columns
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def filtered_count(df: DataFrame, filters: list[tuple], sensitive: list[str] = (), any_of: bool = False) -> DataFrame:
    """Rows that pass up to five simple filters ``(column, operator, value)``."""
    if len(filters) > 5:
        raise ValueError("at most five filters")
    parts = []
    for name, operator, *value in filters:
        if operator not in FILTER_OPERATORS:
            raise ValueError(f"unknown operator {operator!r}")
        if name not in df.columns or name in sensitive:
            raise ValueError(f"column {name!r} may not be filtered")
        c, v = col(name), F.lit(value[0]) if value else None
        parts.append({
            "=": lambda: c == v, "!=": lambda: c != v, ">": lambda: c > v, ">=": lambda: c >= v, "<": lambda: c < v, "<=": lambda: c <= v,
            "like": lambda: c.like(value[0]), "ilike": lambda: c.ilike(value[0]), "is_null": c.isNull, "is_not_null": c.isNotNull,
        }[operator]())
    keep = parts[0] if parts else F.lit(True)
    for p in parts[1:]:
        keep = (keep | p) if any_of else (keep & p)
    return df.filter(keep).agg(F.count("*").alias("n"))


def ranked_tables(annotated: DataFrame) -> DataFrame:
    return importance(annotated).orderBy("is_internal", F.desc("importance"), "table")


def describe(annotated: DataFrame, table: str) -> DataFrame:
    return annotated.filter(F.col("table") == table).orderBy("ordinal").select(
        "ordinal", "column", "dtype", "is_key", "ref_table", "semantic_type"
    )


def relationships(annotated: DataFrame, table: str) -> DataFrame:
    """References from and to a table."""
    e = edges(annotated)
    out = e.filter(F.col("source") == table).select(F.lit("outbound").alias("direction"), "*")
    return out.unionByName(e.filter(F.col("target") == table).select(F.lit("inbound").alias("direction"), "*"))


def overlay(annotated: DataFrame, hidden_tables: list[str], restricted: list[str]) -> DataFrame:
    """The catalog without hidden tables and restricted ``table.column`` entries."""
    spark = annotated.sparkSession
    hidden = spark.createDataFrame([(t,) for t in hidden_tables], "table string")
    closed = spark.createDataFrame([tuple(r.split(".")) for r in restricted], "table string, column string")
    return annotated.join(F.broadcast(hidden), "table", "left_anti").join(F.broadcast(closed), ["table", "column"], "left_anti")


def scope_impact(usages: DataFrame, allowed: list[str]) -> DataFrame:
    """Objects that refer to a table outside a new scope: ``usages`` has ``kind, id, table``."""
    scope = usages.sparkSession.createDataFrame([(t,) for t in allowed], "table string")
    return usages.join(F.broadcast(scope), "table", "left_anti").groupBy("kind", "id").agg(
        F.sort_array(F.collect_set("table")).alias("tables")
    )


def name_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return 1 - F.levenshtein(F.lower(a), F.lower(b)) / longest


def closest_names(names: DataFrame, wanted: str, least: float = 0.5, k: int = 5) -> DataFrame:
    """The names most like a given one; the bound lets the edit distance stop early."""
    score = name_similarity(F.col("name"), F.lit(wanted))
    return names.select("name", score.alias("score")).filter(F.col("score") >= least).orderBy(F.desc("score"), "name").limit(k)


def slice_rows(df: DataFrame, order_by: list[str], offset: int, rows: int) -> DataFrame:
    """Rows ``[offset, offset + rows)`` of a stored result."""
    return df.orderBy(*[col(c) for c in order_by]).offset(offset).limit(rows)


def schema_card(df: DataFrame, order_by: str, samples: int = 3) -> DataFrame:
    """``(ordinal, column, dtype, samples)`` with the first non-missing values.

    The smallest order keys per column are found with a rank limit, which Spark
    applies before the shuffle.
    """
    from pyspark.sql import Window

    cells = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.lit(V.data_type(df, c).simpleString()).alias("dtype"), V.present(df, c).cast("string").alias("value"))
        for i, c in enumerate(df.columns)
    ]
    long = df.select(col(order_by).alias("at"), F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
    order = Window.partitionBy("ordinal").orderBy("at")
    first = long.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= samples)
    return first.groupBy("ordinal", "column", "dtype").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("samples")
    )
