"""A running quality profile of a stream.

What a micro-batch adds is merged into the state of all rows so far: counts, moments
and value ranges per column, and the counts of labels. Rules then read the state, never
the rows, and give the issues of everything seen, as over a table of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.functions import counts as C, values as V
from plumbline.operators import kinds as K, profile as P, quality as Q

SUMS = "column string, rows long, count long, mean double, m2 double, min double, max double, two_valued boolean, integral boolean"
LEVELS = "column string, txt string, n long"
CHANGES = "change string, " + Q.ISSUE_SCHEMA
_NO_LABELS = (T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType)


def label_names(df: DataFrame) -> list[str]:
    """Columns whose values are counted: neither numbers nor times nor truth values."""
    return [c for c in df.columns if not V.is_numeric(df, c) and not isinstance(V.data_type(df, c), _NO_LABELS)]


def batch_sums(df: DataFrame) -> DataFrame:
    """What the rows of ``df`` add to the counts and moments: one row per column."""
    numbers = [c for c in df.columns if V.is_numeric(df, c)]
    labels = [c for c in df.columns if c not in numbers]
    parts = [df.sparkSession.createDataFrame([], SUMS)]
    if numbers:
        n = F.col("num")
        parts.append(C.named(C.number_cells(df, numbers).groupBy("c").agg(
            F.count("*").alias("rows"), F.count(n).alias("count"), F.avg(n).alias("mean"), (F.var_pop(n) * F.count(n)).alias("m2"),
            F.min(n).alias("min"), F.max(n).alias("max"), F.bool_and(n.isin(0.0, 1.0)).alias("two_valued"),
            F.bool_and(V.is_integral(n)).alias("integral")), numbers))
    if labels:
        parts.append(C.named(C.label_cells(df, labels).groupBy("c").agg(F.count("*").alias("rows"), F.count("txt").alias("count")), labels))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def merged_sums(*parts: DataFrame) -> DataFrame:
    """The sums of all rows behind the parts; squared deviations are moved to the common mean."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    known = F.when(F.col("mean").isNotNull(), F.struct("count", "mean", "m2"))
    merged = every.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("count").alias("count"), F.try_divide(F.sum(F.col("count") * F.col("mean")), F.sum(F.when(F.col("mean").isNotNull(), F.col("count")))).alias("mean"),
        F.collect_list(known).alias("parts"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.bool_and("two_valued").alias("two_valued"), F.bool_and("integral").alias("integral"))
    moved = F.expr("aggregate(parts, 0D, (s, p) -> s + p.m2 + p.count * (p.mean - mean) * (p.mean - mean))")
    return merged.withColumn("m2", F.when(F.col("mean").isNotNull(), moved)).select("column", "rows", "count", "mean", "m2", "min", "max", "two_valued", "integral")


def batch_levels(df: DataFrame) -> DataFrame:
    names = label_names(df)
    return C.value_counts(df, names).select("column", "txt", "n") if names else df.sparkSession.createDataFrame([], LEVELS)


def merged_levels(*parts: DataFrame) -> DataFrame:
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("column", "txt").agg(F.sum("n").alias("n"))


def running_facts(schema: T.StructType, sums: DataFrame, levels: DataFrame) -> DataFrame:
    """The column facts that the rules read, one row per column; what needs the distinct numbers, or third and fourth moments, is null."""
    spark = sums.sparkSession
    listed = spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(schema)], "ordinal int, column string, dtype string")
    texts = [f.name for f in schema if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]
    n, kept = F.col("n"), F.sum("n")
    shapes = levels.where(F.col("column").isin(texts)).groupBy("column").agg(*K._label_shapes(n, kept)).withColumnRenamed("two_valued", "words")
    unique = levels.groupBy("column").agg(F.count("*").alias("unique"), F.max("n").alias("top_count"))
    count = F.coalesce("count", F.lit(0).cast("long"))
    facts = listed.join(sums, "column", "left").join(shapes, "column", "left").join(unique, "column", "left")
    facts = facts.withColumns({
        "rows": F.coalesce("rows", F.lit(0).cast("long")), "count": count, "two_valued": F.coalesce("two_valued", "words"),
        "std": F.sqrt(F.try_divide(F.col("m2"), count - 1)), "unique": F.coalesce("unique", F.lit(0).cast("long"))})
    facts = facts.withColumn("missing", F.col("rows") - F.col("count")).withColumn("kind", K.kind_of(F.col("unique"))).drop("words", "m2")
    return spark.createDataFrame(facts.collect(), facts.schema)


def running_issues(facts: DataFrame, levels: DataFrame) -> DataFrame:
    """Missing values, numbers and dates kept as text, and label variants of all rows so far."""
    out = Q.missing_issues(facts).unionByName(Q.type_issues(facts))
    names = Q.label_columns(facts)
    return out.unionByName(Q.level_issues(Q.grouped_levels(levels.where(F.col("column").isin(names))), facts)) if names else out


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Issues that were raised, resolved, or say something else than before."""
    named = lambda df, name: df.select("code", F.struct(*df.columns).alias(name), F.to_json(F.struct(*df.columns)).alias(f"{name}_text"))
    both = named(before, "old").join(named(after, "new"), "code", "full_outer")
    change = F.when(F.col("old").isNull(), "raised").when(F.col("new").isNull(), "resolved").when(F.col("old_text") != F.col("new_text"), "changed")
    return both.select(change.alias("change"), F.coalesce("new", "old").alias("issue")).where("change IS NOT NULL").select("change", "issue.*")


def latest(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A part of the state (``sums``, ``levels`` or ``issues``) after the last batch; empty before the first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    batches = [int(f.getPath().getName().split("=")[1]) for f in files.listStatus(folder)] if files.exists(folder) else []
    return spark.read.schema(schema).parquet(f"{path}/{name}/batch={max(batches)}") if batches else spark.createDataFrame([], schema)


def watch(stream: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps the profile of all rows seen under ``path`` and writes to ``changes`` what each batch did to the issues.

    Every batch reads the state of the batch before and writes its own, so one that is run again gives the same. State has a row per
    column and a row per distinct label; batches are scanned, counted with map-side combining, and not read again.
    """
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, number: int) -> None:
        def before(name: str, kind: str) -> DataFrame:
            return spark.read.schema(kind).parquet(f"{path}/{name}/batch={number - 1}") if number else spark.createDataFrame([], kind)

        def stored(df: DataFrame, name: str, kind: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
            return spark.read.schema(kind).parquet(f"{path}/{name}/batch={number}")

        sums = stored(merged_sums(before("sums", SUMS), stored(batch_sums(batch), "added_sums", SUMS)), "sums", SUMS)
        levels = stored(merged_levels(before("levels", LEVELS), stored(batch_levels(batch), "added_levels", LEVELS)), "levels", LEVELS)
        issues = stored(running_issues(running_facts(schema, sums, levels), levels), "issues", Q.ISSUE_SCHEMA)
        stored(changes(before("issues", Q.ISSUE_SCHEMA), issues), "changes", CHANGES)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
