"""Column sketches per part of a table, stored and merged without another look at the rows.

One row per part holds, for every column, counts, bounds, and three mergeable sketches: distinct values (HyperLogLog),
quantiles of numbers (KLL) and frequent values (frequent items). Parts are added or replaced one at a time; a profile of
the table merges one small row per part, whatever the number of rows below.

Bounds that go with the figures: distinct counts are within ``3 * 1.04 / sqrt(2^PRECISION)`` of the truth (three standard
errors), ranks of quantiles within ``RANK_ERROR`` of the rows (99 % confidence for this size of sketch), and counts of
frequent values are never above the truth and at most ``rows / (0.75 * TRACKED)`` below it per merged sketch.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions import values as V
from plumbline.session import col

PRECISION, KLL_SIZE, TRACKED = 12, 800, 1024
DISTINCT_ERROR = 3 * 1.04 / math.sqrt(2**PRECISION)
RANK_ERROR = 2.446 / KLL_SIZE**0.9433  # of a KLL sketch, for two-sided ranges
PROBABILITIES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _safe(n: int, what: str) -> str:
    return f"c{n}_{what}"


def sketch(df: DataFrame, columns: list[str], part) -> DataFrame:
    """One row per ``part`` (a column expression): counts, bounds and sketches of each column; one pass over the rows."""
    made = [F.count(F.lit(1)).alias("rows")]
    cells = []
    for n, name in enumerate(columns):
        cells.append(col(name).cast("string").alias(_safe(n, "text")))
        if V.is_numeric(df, name):
            cells.append(V.as_number(df, name).alias(_safe(n, "number")))
            made += [F.expr(f"kll_sketch_agg_double({_safe(n, 'number')}, {KLL_SIZE})").alias(_safe(n, "kll"))]
            made += [F.min(_safe(n, "number")).alias(_safe(n, "low")), F.max(_safe(n, "number")).alias(_safe(n, "high"))]
        made += [F.count(_safe(n, "text")).alias(_safe(n, "count")), F.hll_sketch_agg(_safe(n, "text"), F.lit(PRECISION)).alias(_safe(n, "hll")),
                 F.expr(f"approx_top_k_accumulate({_safe(n, 'text')}, {TRACKED})").alias(_safe(n, "top"))]
    return df.select(part.cast("string").alias("part"), *cells).groupBy("part").agg(*made)


class SketchStore:
    """Sketches of one table below ``path``, a folder per part."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def put(self, df: DataFrame, part) -> None:
        """Add the parts of ``df``, or replace those that are there already."""
        rows = sketch(df, self.columns, part).withColumn("kept", F.col("part"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)

    def parts(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def profile(self, spark: SparkSession, top: int = 10, parts=None) -> DataFrame:
        """``(column, rows, count, distinct, low, high, quantiles, top)`` merged from the stored parts.

        ``quantiles`` holds the values at ``PROBABILITIES``, ``top`` the most frequent values with their counts. ``parts`` is a condition
        on ``kept`` that selects parts.
        """
        held = self.parts(spark)
        if parts is not None:
            held = held.where(parts)
        there, merged = set(held.columns), [F.sum("rows").alias("rows")]
        for n, _ in enumerate(self.columns):
            merged += [F.sum(_safe(n, "count")).alias(_safe(n, "count")), F.hll_union_agg(_safe(n, "hll")).alias(_safe(n, "hll")),
                       F.expr(f"approx_top_k_combine({_safe(n, 'top')}, {TRACKED})").alias(_safe(n, "top"))]
            if _safe(n, "kll") in there:
                merged += [F.expr(f"kll_merge_agg_double({_safe(n, 'kll')})").alias(_safe(n, "kll")), F.min(_safe(n, "low")).alias(_safe(n, "low")),
                           F.max(_safe(n, "high")).alias(_safe(n, "high"))]
        cells = []
        for n, name in enumerate(self.columns):
            number = _safe(n, "kll") in there
            wanted = ", ".join(f"{p}D" for p in PROBABILITIES)
            cells.append(F.struct(
                F.lit(name).alias("column"), F.col("rows"), F.col(_safe(n, "count")).alias("count"), F.hll_sketch_estimate(_safe(n, "hll")).alias("distinct"),
                (F.col(_safe(n, "low")) if number else F.lit(None).cast("double")).alias("low"),
                (F.col(_safe(n, "high")) if number else F.lit(None).cast("double")).alias("high"),
                (F.when(F.col(_safe(n, "count")) > 0, F.expr(f"kll_sketch_get_quantile_double({_safe(n, 'kll')}, array({wanted}))"))
                 if number else F.lit(None)).cast("array<double>").alias("quantiles"),
                F.filter(F.expr(f"approx_top_k_estimate({_safe(n, 'top')}, {top})"), lambda x: x.item.isNotNull()).alias("top")))
        # Frequent-item sketches of an empty task cannot be sent, so tasks without parts must not have a group.
        return held.groupBy(F.col("rows").isNotNull()).agg(*merged).select(F.inline(F.array(*cells)))
