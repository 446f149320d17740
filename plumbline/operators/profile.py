"""Table and column profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import counts as C, moments as M, ranks as R, values as V
from plumbline.operators import kinds as K

QUANTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
BINS = 20
NEAR_CONSTANT = 0.98


def column_facts(df: DataFrame) -> DataFrame:
    """One row per column with everything later rules need, computed in one job:
    a scan for the aggregates and one shuffle of value counts.

    The rows are as many as the columns; they come back as a local relation so
    that rules built on top never read the table again.
    """
    counts = C.value_counts(df, df.columns)
    labels = [c for c in df.columns if V.is_text(df, c)]
    scanned = K.scan_columns(df, C.value_counts(df, labels) if labels else None)
    counted = C.count_facts(counts)
    unique = F.coalesce(F.col("unique"), F.lit(0).cast("long"))
    facts = scanned.join(counted, "column", "left").select(
        *scanned.columns,
        unique.alias("unique"),
        F.coalesce("repeated", F.lit(0).cast("long")).alias("repeated"),
        F.coalesce("top_count", F.lit(0).cast("long")).alias("top_count"),
        "mode_num",
        "mode_txt",
        K.kind_of(unique).alias("kind"),
    )
    return df.sparkSession.createDataFrame(facts.collect(), facts.schema)


def kinds_of(facts: DataFrame) -> dict[str, str]:
    return {r["column"]: r["kind"] for r in facts.select("ordinal", "column", "kind").orderBy("ordinal").collect()}


def is_high_cardinality() -> Column:
    return F.col("kind").isin(K.CATEGORICAL, K.TEXT) & (
        F.col("unique") > F.greatest(F.lit(50.0), 0.5 * F.col("count"))
    )


def is_constant() -> Column:
    return (F.col("unique") <= 1) & (F.col("count") > 0)


def top_share() -> Column:
    return F.try_divide(F.col("top_count").cast("double"), F.col("count"))


def is_near_constant() -> Column:
    return F.coalesce((top_share() >= NEAR_CONSTANT) & (F.col("unique") > 1), F.lit(False))


def column_profile(facts: DataFrame) -> DataFrame:
    """Counts, missing and distinct shares, and the constant / cardinality flags."""
    return facts.select(
        "ordinal", "column", "dtype", "kind", "count", "missing",
        V.pct(F.col("missing"), F.col("rows")).alias("missing_pct"),
        "unique",
        V.pct(F.col("unique"), F.col("count")).alias("unique_pct"),
        is_constant().alias("is_constant"),
        is_near_constant().alias("is_near_constant"),
        is_high_cardinality().alias("is_high_cardinality"),
        C.shown(F.col("mode_num"), F.col("mode_txt")).alias("mode"),
    )


def dataset_profile(df: DataFrame, facts: DataFrame, duplicate_rows: int) -> DataFrame:
    """One row about the whole table; ``duplicate_rows`` comes from ``duplicates.count_duplicates``."""
    cells = F.sum("rows")
    in_order = lambda keep: F.transform(
        F.sort_array(F.collect_list(F.when(keep, F.struct("ordinal", "column")))), lambda s: s["column"]
    )
    by_kind = [
        F.count_if(F.col("kind") == k).alias(f"n_{k}")
        for k in (K.NUMERIC, K.CATEGORICAL, K.DATETIME, K.BOOLEAN, K.TEXT, K.EMPTY)
    ]
    dup = F.lit(duplicate_rows).cast("long")
    size = str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return facts.agg(
        F.max("rows").alias("n_rows"),
        F.count("*").alias("n_cols"),
        *by_kind,
        F.sum("missing").alias("missing_cells"),
        V.pct(F.sum("missing"), cells).alias("missing_pct"),
        dup.alias("duplicate_rows"),
        V.pct(dup, F.max("rows")).alias("duplicate_pct"),
        in_order(is_constant()).alias("constant_columns"),
        in_order(is_near_constant() & ~is_constant()).alias("near_constant_columns"),
        in_order(is_high_cardinality()).alias("high_cardinality_columns"),
        F.lit(size).cast("decimal(38,0)").alias("plan_size_bytes"),
    )


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    """``(column, rank, value, n, pct)``; shares are of non-missing cells."""
    counts = C.value_counts(df, columns)
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    top = C.top_values(counts, k)
    # One total per column: as many rows as the table has columns.
    return top.join(F.broadcast(totals), "column").select(
        "column", "rank", C.shown(F.col("num"), F.col("txt")).alias("value"), "n",
        V.pct(F.col("n"), F.col("total")).alias("pct"),
    )


def fences(quantiles: dict[str, dict[float, float]]) -> dict[str, tuple[float, float]]:
    """Lower and upper 1.5-IQR fence per column."""
    out = {}
    for name, q in quantiles.items():
        if 0.25 in q and 0.75 in q:
            reach = 1.5 * (q[0.75] - q[0.25])
            out[name] = (q[0.25] - reach, q[0.75] + reach)
    return out


def numeric_profile(df: DataFrame, columns: list[str], quantiles: dict | None = None) -> DataFrame:
    """Moments, quartiles and the count of values outside the fences.

    The quantiles come first, as a few numbers per column; the second pass then
    counts outliers together with the moments.
    """
    q = quantiles or R.quantile_map(df, columns, QUANTILES)
    limits = fences(q)
    names = [c for c in columns if c in limits]
    spark = df.sparkSession
    marks = spark.createDataFrame(
        [(c, q[c][0.5], q[c][0.25], q[c][0.75]) for c in names],
        "column string, median double, q1 double, q3 double",
    )
    x = F.col("num")
    cells = [
        F.struct(
            F.lit(c).alias("column"), V.as_number(df, c).alias("num"),
            F.lit(limits[c][0]).alias("lo"), F.lit(limits[c][1]).alias("hi"),
        )
        for c in names
    ]
    if not names:
        return spark.createDataFrame([], "column string, count long")
    long = df.select(F.inline(F.array(*cells))).filter(x.isNotNull())
    moments = long.groupBy("column").agg(
        F.count(x).alias("count"),
        V.finite(F.avg(x)).alias("mean"),
        V.finite(F.stddev_samp(x)).alias("std"),
        V.finite(F.min(x)).alias("min"),
        V.finite(F.max(x)).alias("max"),
        V.finite(M.sample_skew(x)).alias("skew"),
        V.finite(M.sample_kurtosis(x)).alias("kurtosis"),
        F.count_if((x < F.col("lo")) | (x > F.col("hi"))).alias("outlier_count"),
    )
    return moments.join(F.broadcast(marks), "column").select(
        "column", "count", "mean", V.finite(F.col("median")).alias("median"), "std", "min", "max",
        V.finite(F.col("q1")).alias("q1"), V.finite(F.col("q3")).alias("q3"),
        V.finite(F.col("q3") - F.col("q1")).alias("iqr"), "skew", "kurtosis", "outlier_count",
    )


def quantile_profile(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """``(column, p, value)`` for the seven standard quantiles."""
    found = R.column_quantiles(df, columns, QUANTILES, approximate=approximate)
    return found.select("column", "p", V.finite(F.col("value")).alias("value"))


def histogram(df: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """``(column, bin, low, high, count)`` with equal widths; the last bin is closed.

    Columns with fewer than ``bins`` distinct values get one bin per value, and
    constant columns none. Counting groups by bin, so at most ``bins`` rows per
    column leave each task; empty bins are filled in afterwards.
    """
    spans = C.named(C.long_numbers(df, columns).groupBy("c").agg(
        F.min("num").alias("lo"), F.max("num").alias("hi"), F.approx_count_distinct("num").alias("about")
    ), columns).collect()
    spans = [s for s in spans if s["lo"] is not None and s["lo"] < s["hi"]]
    spark = df.sparkSession
    out = "column string, bin int, low double, high double, count long"
    if not spans:
        return spark.createDataFrame([], out)
    # Only a column whose estimate is near the bin count needs its exact distinct count.
    few = [s["column"] for s in spans if s["about"] < 2 * bins]
    exact = {}
    if few:
        exact = df.agg(*[F.count_distinct(V.as_number(df, c)).alias(c) for c in few]).first().asDict()
    table = [(s["column"], s["lo"], s["hi"], min(bins, max(exact.get(s["column"], bins), 2))) for s in spans]
    plan = spark.createDataFrame(table, "column string, lo double, hi double, bins int")
    frame = plan.select(
        "column", "lo", "hi", "bins", F.explode(F.sequence(F.lit(1), F.col("bins"))).alias("bin")
    )
    cells = []
    for name, lo, hi, n in table:
        x = V.as_number(df, name)
        cells.append(F.struct(
            F.lit(name).alias("column"),
            F.when(x.isNotNull(), F.least(F.width_bucket(x, F.lit(lo), F.lit(hi), F.lit(n)), F.lit(n)))
            .cast("int").alias("bin"),
        ))
    counted = (
        df.select(F.inline(F.array(*cells))).filter(F.col("bin").isNotNull())
        .groupBy("column", "bin").agg(F.count("*").alias("count"))
    )
    edge = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / F.col("bins")
    return frame.join(counted, ["column", "bin"], "left").select(
        "column", "bin",
        V.finite(edge(F.col("bin") - 1)).alias("low"),
        V.finite(F.when(F.col("bin") == F.col("bins"), F.col("hi")).otherwise(edge(F.col("bin")))).alias("high"),
        F.coalesce("count", F.lit(0).cast("long")).alias("count"),
    )


def time_profile(facts: DataFrame) -> DataFrame:
    """Earliest, latest and most frequent time of the datetime columns."""
    return facts.filter(F.col("kind") == K.DATETIME).select(
        "column",
        F.col("first_time").cast("timestamp").alias("min"),
        F.col("last_time").cast("timestamp").alias("max"),
        F.col("mode_txt").cast("timestamp").alias("mode"),
    )


def overview(df: DataFrame, name: str, source: str = "", order_by: str | None = None) -> dict:
    """Name, counts, kinds and the first ten rows, as frames and plain values."""
    kinds = K.column_kinds(df)
    first = df.orderBy(order_by).limit(10) if order_by else df.limit(10)
    rows = kinds.agg(F.max(F.col("count") + F.col("missing"))).first()[0]
    return {
        "name": name, "source": source, "n_rows": rows, "n_cols": len(df.columns),
        "columns": kinds, "sample_rows": V.json_safe(first),
    }
