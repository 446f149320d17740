"""Whole-row duplicates and ordered de-duplication.

All forms group and aggregate, which combines on the map side: a row that fills
a third of the table is one record per task, and no task sorts a hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions import values as V
from plumbline.session import col


def _grouped(df: DataFrame, subset: list[str]):
    return df.groupBy(*[V.present(df, c).alias(c) for c in subset])


def duplicate_groups(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Groups of equal rows (missing equals missing) with more than one member."""
    return _grouped(df, subset or df.columns).agg(F.count("*").alias("n")).filter(F.col("n") > 1)


def duplicate_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """One row ``(duplicate_rows)``: all members of duplicate groups."""
    total = F.coalesce(F.sum("n"), F.lit(0)).cast("long")
    return duplicate_groups(df, subset).agg(total.alias("duplicate_rows"))


def count_duplicates(df: DataFrame, subset: list[str] | None = None) -> int:
    return duplicate_rows(df, subset).first()[0]


def drop_duplicates(df: DataFrame, order_by: list[str], subset: list[str] | None = None,
                    keep: str | bool = "first") -> DataFrame:
    """Keep the first, the last or (``False``) none of each group of equal rows."""
    subset = subset or [c for c in df.columns if c not in order_by]
    others = [c for c in df.columns if c not in subset]
    order = F.struct(*[col(c) for c in order_by])
    rest = F.struct(*[col(c) for c in others]) if others else F.struct(F.lit(1).alias("_"))
    pick = {"first": F.min_by(rest, order), "last": F.max_by(rest, order)}.get(keep, F.any_value(rest))
    kept = _grouped(df, subset).agg(F.count("*").alias("_n"), pick.alias("_rest"))
    if keep is False:
        kept = kept.filter(F.col("_n") == 1)
    return kept.select(*[col(c) if c in subset else F.col("_rest").getField(c).alias(c) for c in df.columns])
