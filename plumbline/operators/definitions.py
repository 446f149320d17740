"""Checks and searches over semantic definitions held as a frame.

``id, kind, key, name, description, table_name, column_name, ref_table,
ref_column, classification, synonyms, status``; the catalog is the annotated
frame of ``catalog.annotate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WITH_COLUMN = ["column", "dimension", "filter", "date_policy", "entity", "relationship"]


def _catalog_columns(annotated: DataFrame, prefix: str) -> DataFrame:
    return annotated.select(
        F.lower("table").alias(f"{prefix}_table"), F.lower("column").alias(f"{prefix}_column"), F.col("dtype").alias(f"{prefix}_dtype"),
        F.col("is_key").alias(f"{prefix}_key"), F.col("is_sensitive").alias(f"{prefix}_sensitive"),
        F.col("semantic_type").alias(f"{prefix}_meaning"), F.lower("ref_table").alias(f"{prefix}_ref"),
    )


def _tables(annotated: DataFrame, name: str) -> DataFrame:
    return annotated.select(F.lower("table").alias(name), F.lit(True).alias(f"{name}_known")).distinct()


def structural_findings(definitions: DataFrame, annotated: DataFrame) -> DataFrame:
    """``(id, level, code)`` for definitions that do not fit the catalog.

    The catalog has one row per column and is broadcast by size; definitions are
    joined to it once per side.
    """
    d = definitions.withColumn("a_table", F.lower("table_name")).withColumn("a_column", F.lower("column_name"))
    d = d.withColumn("b_table", F.lower("ref_table")).withColumn("b_column", F.lower("ref_column"))
    left, right = _catalog_columns(annotated, "a"), _catalog_columns(annotated, "b")
    j = d.join(_tables(annotated, "a_table"), "a_table", "left").join(_tables(annotated, "b_table"), "b_table", "left")
    j = j.join(left, ["a_table", "a_column"], "left").join(right, ["b_table", "b_column"], "left")
    kind = F.col("kind")
    linked = kind == "relationship"
    have_table = F.col("a_table_known").isNotNull()
    have_a = have_table & F.col("a_dtype").isNotNull()
    have_b = F.col("b_table_known").isNotNull() & F.col("b_dtype").isNotNull()
    dated = F.col("a_dtype").rlike("date|time") | F.col("a_meaning").isin("date", "datetime")
    physical = (F.col("a_ref") == F.col("b_table")) | (F.col("b_ref") == F.col("a_table"))
    sensitive = have_a & F.col("a_sensitive")
    rules = [
        ("error", "table_not_found", ~have_table | (linked & F.col("b_table_known").isNull())),
        ("error", "column_not_found", kind.isin(WITH_COLUMN) & have_table & F.col("a_dtype").isNull()),
        ("error", "column_not_found_right", linked & F.col("b_table_known").isNotNull() & F.col("b_dtype").isNull()),
        ("error", "sensitivity_cannot_be_weakened", (kind == "column") & sensitive & F.col("classification").isin("public", "internal")),
        ("error", "sensitive_dimension", (kind == "dimension") & sensitive),
        ("error", "sensitive_filter", (kind == "filter") & sensitive),
        ("error", "date_column_required", (kind == "date_policy") & have_a & ~dated),
        ("warning", "entity_key_not_physical_pk", (kind == "entity") & have_a & ~F.col("a_key")),
        ("warning", "relationship_type_mismatch", linked & have_a & have_b & (F.col("a_dtype") != F.col("b_dtype"))),
        ("warning", "relationship_not_physical_fk", linked & have_table & ~F.coalesce(physical, F.lit(False))),
    ]
    found = F.array_compact(F.array(*[
        F.when(F.coalesce(rule, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(code).alias("code"))) for level, code, rule in rules
    ]))
    return j.select("id", F.inline(found))


def revalidate(definitions: DataFrame, annotated: DataFrame) -> DataFrame:
    """``(id, validation)``: verified definitions become stale when a check fails."""
    broken = structural_findings(definitions, annotated).filter(F.col("level") == "error").select("id").distinct()
    verified = definitions.filter(F.col("status") == "verified").select("id")
    return verified.join(broken.withColumn("bad", F.lit(True)), "id", "left").select(
        "id", F.when(F.col("bad"), "stale").otherwise("valid").alias("validation")
    )


def drift_counts(definitions: DataFrame, annotated: DataFrame) -> DataFrame:
    return revalidate(definitions, annotated).agg(
        F.count_if(F.col("validation") == "valid").alias("valid"), F.count_if(F.col("validation") == "stale").alias("stale")
    )


def _matches(text: str) -> Column:
    """Case-insensitive substring in key, name or description."""
    parts = [F.contains(F.lower(c), F.lit(text.lower())) for c in ("key", "name", "description")]
    return parts[0] | parts[1] | parts[2]


def search(definitions: DataFrame, text: str, page: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """One page of hits and the total."""
    hits = definitions.filter(_matches(text)).select("id", "kind", "key", "name").distinct()
    return hits.orderBy("key", "id").offset((page - 1) * size).limit(size), hits.agg(F.count("*").alias("total"))


def ambiguous_synonyms(definitions: DataFrame) -> DataFrame:
    """Phrases that lead to more than one definition of the same kind."""
    phrases = definitions.select("kind", "id", F.explode("synonyms").alias("phrase"))
    phrases = phrases.withColumn("phrase", F.lower(F.trim("phrase"))).filter(F.col("phrase") != "")
    # Distinct pairs first, so a phrase used by a third of all definitions is counted in parts.
    return phrases.distinct().groupBy("kind", "phrase").agg(F.count("*").alias("targets")).filter(F.col("targets") > 1)
