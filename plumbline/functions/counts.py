"""The value-count frame: every column unpivoted and counted with one shuffle.

Distinct counts, modes, top values, dominance and label groups all read it.
Counting combines on the map side, so a value that fills a third of the table
costs one row per task, not one hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.functions import values as V
from plumbline.session import col


def as_label(df: DataFrame, name: str) -> Column:
    """Text form of a non-numeric value."""
    return col(name) if V.is_text(df, name) else col(name).cast("string")


def _cells(df: DataFrame, columns: list[str], value, name: str, *beside: str) -> DataFrame:
    """Unpivot to ``(c, <name>)`` keeping missing cells; the table is read once.

    ``c`` is the position in ``columns``: a fixed-width key, turned into the
    column name by ``named`` after grouping.
    """
    cells = [F.struct(F.lit(i).alias("c"), value(c).alias(name)) for i, c in enumerate(columns)]
    return df.select(*beside, F.inline(F.array(*cells)))


def named(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace ``c`` by the column name."""
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("c"))
    return df.select(name.alias("column"), *[c for c in df.columns if c != "c"])


def number_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    return _cells(df, columns, lambda c: V.as_number(df, c), "num")


def label_cells(df: DataFrame, columns: list[str], *beside: str) -> DataFrame:
    return _cells(df, columns, lambda c: as_label(df, c), "txt", *beside)


def long_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(c, num)`` for all non-missing numeric cells."""
    return number_cells(df, columns).filter(F.col("num").isNotNull())


def _exact_type(df: DataFrame, name: str) -> str:
    """``long`` for whole-number columns, the column's own type for decimals."""
    kind = V.data_type(df, name)
    return kind.simpleString() if isinstance(kind, T.DecimalType) else "bigint"


def _decimal_text(value: Column) -> Column:
    """Plain digits without trailing zeros behind the point."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, num, exact, txt, n)`` with one row per distinct value of each column.

    Values are counted in their own type: floats as double, whole numbers as long, decimals per precision and scale, labels as text.
    ``num`` is then a double for reading and order, ``exact`` a decimal that orders what doubles cannot tell apart, and ``txt`` the exact text
    of all but floats.
    """
    floats = [c for c in columns if V.is_float(df, c)]
    labels = [c for c in columns if not V.is_numeric(df, c)]
    parts = []
    if floats:
        counted = named(long_numbers(df, floats).groupBy("c", "num").agg(F.count("*").alias("n")), floats)
        parts.append(counted.withColumns({"exact": F.lit(None), "txt": F.lit(None)}))
    exact: dict[str, list[str]] = {}
    for c in columns:
        if c not in floats and c not in labels:
            exact.setdefault(_exact_type(df, c), []).append(c)
    for kind, names in exact.items():
        cells = _cells(df, names, lambda c: col(c).cast(kind), "v").filter(F.col("v").isNotNull())
        counted = named(cells.groupBy("c", "v").agg(F.count("*").alias("n")), names)
        text = F.col("v").cast("string") if kind == "bigint" else _decimal_text(F.col("v"))
        parts.append(counted.select("column", F.col("v").cast("double").alias("num"), F.col("v").alias("exact"), text.alias("txt"), "n"))
    if labels:
        long = label_cells(df, labels).filter(F.col("txt").isNotNull())
        counted = named(long.groupBy("c", "txt").agg(F.count("*").alias("n")), labels)
        parts.append(counted.withColumns({"num": F.lit(None), "exact": F.lit(None)}))
    wide = f"decimal(38,{_common_scale(df, columns)})"
    typed = [p.select("column", F.col("num").cast("double").alias("num"), F.expr(f"try_cast(exact AS {wide})").alias("exact"),
                      F.col("txt").cast("string").alias("txt"), "n") for p in parts]
    out = typed[0]
    for part in typed[1:]:
        out = out.unionByName(part)
    return out


def _common_scale(df: DataFrame, columns: list[str]) -> int:
    """The largest scale that leaves room for the whole digits of every exact column."""
    kinds = [V.data_type(df, c) for c in columns]
    decimals = [k for k in kinds if isinstance(k, T.DecimalType)]
    whole = max([19] + [k.precision - k.scale for k in decimals])
    return max(0, min(38 - whole, max([k.scale for k in decimals], default=0)))


def shown(num: Column, txt: Column) -> Column:
    """Value as text: labels as they are, whole numbers without a fraction."""
    whole = F.when((num % 1 == 0) & (F.abs(num) < 1e15), num.cast("long").cast("string"))
    return F.coalesce(txt, whole, num.cast("string"))


def count_facts(counts: DataFrame) -> DataFrame:
    """Per column: non-missing cells, distinct values, top count and mode (smallest on ties)."""
    first = F.min(F.struct((-F.col("n")).alias("k"), F.col("num"), F.col("exact"), F.col("txt")))
    return (
        counts.groupBy("column")
        .agg(
            F.sum("n").alias("total"),
            F.count("*").alias("unique"),
            F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"),
            first.alias("first"),
        )
        .select(
            "column", "total", "unique", "repeated",
            (-F.col("first.k")).alias("top_count"),
            F.col("first.num").alias("mode_num"),
            F.col("first.txt").alias("mode_txt"),
        )
    )


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent values per column, ties by value.

    The rank filter is pushed below the shuffle by Spark's window group limit,
    so each task sends at most ``k`` rows per column.
    """
    order = Window.partitionBy("column").orderBy(F.desc("n"), "num", "exact", "txt")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
