"""Exploration: summaries, correlations, chart data and plain findings."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions import counts as C, moments as M, ranks as R, values as V
from plumbline.operators import kinds as K, profile as P
from plumbline.session import col

BARS, PIE_LEVELS = 12, 6
SCATTER_ROWS, SAMPLE_OUTLIERS, TOP_PAIRS = 2000, 20, 10
PAIRS_PER_AGGREGATE = 45

numeric_summary = P.numeric_profile


def categorical_summary(df: DataFrame, columns: list[str], k: int = BARS) -> DataFrame:
    """``(column, rank, value, n, pct, count, unique)`` for the ``k`` most frequent labels."""
    counts = C.value_counts(df, columns)
    facts = counts.groupBy("column").agg(F.sum("n").alias("count"), F.count("*").alias("unique"))
    # One fact row per column.
    return C.top_values(counts, k).join(F.broadcast(facts), "column").select(
        "column", "rank", C.shown(F.col("num"), F.col("txt")).alias("value"), "n",
        V.pct(F.col("n"), F.col("count")).alias("pct"), "count", "unique",
    )


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(a, b, corr)`` for all column pairs over rows where both are present.

    All pairs share one scan; very wide tables are cut into blocks of pairs so
    that no aggregate grows beyond what compiles well.
    """
    pairs = list(combinations(columns, 2))
    out = None
    for start in range(0, len(pairs), PAIRS_PER_AGGREGATE):
        cells = [
            F.struct(
                F.lit(a).alias("a"), F.lit(b).alias("b"),
                F.round(M.pair_correlation(V.as_number(df, a), V.as_number(df, b)), 4).alias("corr"),
            )
            for a, b in pairs[start:start + PAIRS_PER_AGGREGATE]
        ]
        part = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
        out = part if out is None else out.unionByName(part)
    return out


def top_pairs(corr: DataFrame, k: int = TOP_PAIRS) -> DataFrame:
    return corr.filter(F.col("corr").isNotNull()).orderBy(F.desc(F.abs("corr")), "a", "b").limit(k)


def heatmap(corr: DataFrame, columns: list[str]) -> DataFrame:
    """The full matrix as ``(row, column, corr)``."""
    mirrored = corr.select(F.inline(F.array(
        F.struct(F.col("a").alias("row"), F.col("b").alias("column"), "corr"),
        F.struct(F.col("b").alias("row"), F.col("a").alias("column"), "corr"),
    )))
    diagonal = corr.sparkSession.createDataFrame([(c, c, 1.0) for c in columns], "row string, column string, corr double")
    return mirrored.unionByName(diagonal)


def histogram_chart(df: DataFrame, columns: list[str]) -> DataFrame:
    """Histogram bins with a text label."""
    bins = P.histogram(df, columns)
    return bins.withColumn("label", F.format_string("%.2f", "low"))


def _fenced(df: DataFrame, columns: list[str], quantiles: dict, *extra: Column) -> DataFrame:
    limits = P.fences(quantiles)
    cells = [
        F.struct(
            F.lit(c).alias("column"), V.as_number(df, c).alias("num"),
            F.lit(limits[c][0]).alias("lo"), F.lit(limits[c][1]).alias("hi"),
        )
        for c in columns if c in limits
    ]
    return df.select(*extra, F.inline(F.array(*cells))).filter(F.col("num").isNotNull())


def box_stats(df: DataFrame, columns: list[str], quantiles: dict | None = None) -> DataFrame:
    """Quartiles, whiskers (extreme values inside the fences) and the number of outliers."""
    q = quantiles or R.quantile_map(df, columns, [0.25, 0.5, 0.75])
    x = F.col("num")
    inside = (x >= F.col("lo")) & (x <= F.col("hi"))
    known = df.sparkSession.createDataFrame(
        [(c, q[c][0.25], q[c][0.5], q[c][0.75]) for c in columns if q[c]],
        "column string, q1 double, median double, q3 double",
    )
    spans = _fenced(df, columns, q).groupBy("column").agg(
        V.finite(F.min(x)).alias("min"),
        V.finite(F.max(x)).alias("max"),
        V.finite(F.min(F.when(x >= F.col("lo"), x))).alias("whisker_low"),
        V.finite(F.max(F.when(x <= F.col("hi"), x))).alias("whisker_high"),
        F.count_if(~inside).alias("outlier_count"),
    )
    rounded = known.select("column", *[V.finite(F.col(c)).alias(c) for c in ("q1", "median", "q3")])
    return spans.join(F.broadcast(rounded), "column")


def sample_outliers(df: DataFrame, columns: list[str], order_by: str, quantiles: dict | None = None,
                    k: int = SAMPLE_OUTLIERS) -> DataFrame:
    """The first ``k`` values outside the fences, per column."""
    q = quantiles or R.quantile_map(df, columns, [0.25, 0.75])
    out = _fenced(df, columns, q, col(order_by).alias("_order")).filter(
        (F.col("num") < F.col("lo")) | (F.col("num") > F.col("hi"))
    )
    order = Window.partitionBy("column").orderBy("_order")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("column", "rank", V.finite(F.col("num")).alias("value"))


def bar_chart(df: DataFrame, columns: list[str]) -> DataFrame:
    top = categorical_summary(df, columns)
    return top.filter(F.col("unique") > 1).select("column", "rank", F.col("value").alias("label"), F.col("n").alias("count"))


def pie_chart(df: DataFrame, columns: list[str]) -> DataFrame:
    top = categorical_summary(df, columns)
    few = (F.col("unique") > 1) & (F.col("unique") <= PIE_LEVELS)
    return top.filter(few).select("column", "rank", F.col("value").alias("label"), F.col("n").alias("value"))


def scatter(df: DataFrame, a: str, b: str, order_by: list[str], rows: int = SCATTER_ROWS) -> DataFrame:
    """The first complete rows of two columns."""
    x, y = V.as_number(df, a), V.as_number(df, b)
    complete = df.filter(x.isNotNull() & y.isNotNull()).orderBy(*[col(c) for c in order_by]).limit(rows)
    return complete.select(V.finite(x).alias("x"), V.finite(y).alias("y"))


def monthly_mean(df: DataFrame, time: str, value: str) -> DataFrame:
    """``(month, mean)``; empty if fewer than three complete rows exist."""
    x = V.as_number(df, value)
    complete = df.filter(col(time).isNotNull() & x.isNotNull())
    months = complete.groupBy(F.date_format(col(time), "yyyy-MM").alias("month")).agg(
        F.avg(x).alias("m"), F.count("*").alias("n")
    )
    total = months.agg(F.sum("n").alias("n")).scalar()
    return months.filter(total >= 3).select("month", V.finite(F.col("m")).alias("mean"))


# ---------------------------------------------------------------- findings
FINDING = "category string, subject string, text string, evidence map<string,string>"


def _finding(frame: DataFrame, category: str, subject: Column, text: Column, **evidence: Column) -> DataFrame:
    pairs = [part for k, v in evidence.items() for part in (F.lit(k), v.cast("string"))]
    return frame.select(
        F.lit(category).alias("category"), subject.alias("subject"), text.alias("text"),
        F.create_map(*pairs).alias("evidence"),
    )


def skew_findings(summary: DataFrame) -> DataFrame:
    side = F.when(F.col("skew") > 0, "right").otherwise("left")
    return _finding(
        summary.filter((F.abs("skew") >= 1) & (F.col("count") > 10)), "statistical", F.col("column"),
        F.format_string("'%s' leans to the %s (skew %.2f); a few extreme values move its mean", "column", side, "skew"),
        skew=F.col("skew"), mean=F.col("mean"), median=F.col("median"),
    )


def dominance_findings(summary: DataFrame) -> DataFrame:
    return _finding(
        summary.filter((F.col("rank") == 1) & (F.col("pct") >= 80)), "data_quality", F.col("column"),
        F.format_string("'%s' is mostly '%s' (%.1f%% of rows)", "column", "value", "pct"),
        value=F.col("value"), pct=F.col("pct"),
    )


def correlation_findings(pairs: DataFrame) -> DataFrame:
    """The strongest pairs with an absolute correlation of at least 0.6, three at most."""
    strong = pairs.filter(F.abs("corr") >= 0.6).orderBy(F.desc(F.abs("corr")), "a", "b").limit(3)
    degree = F.when(F.abs("corr") >= 0.8, "strongly ").otherwise("")
    sign = F.when(F.col("corr") > 0, "positively").otherwise("negatively")
    return _finding(
        strong, "statistical", F.concat_ws(",", "a", "b"),
        F.format_string("'%s' and '%s' are %s%s correlated (r %.2f)", "a", "b", degree, sign, "corr"),
        corr=F.col("corr"),
    )


def imbalance_findings(df: DataFrame, target: str) -> DataFrame:
    """A target whose rarest class holds less than a fifth of the rows."""
    counted = C.value_counts(df, [target])
    share = counted.agg((100.0 * F.min("n") / F.sum("n")).alias("minority"))
    return _finding(
        share.filter(F.col("minority") < 20), "ml", F.lit(target),
        F.format_string(f"the rarest class of '{target}' holds %.1f%% of the rows; prefer F1 or ROC-AUC", "minority"),
        minority_pct=F.round("minority", 2),
    )


def group_gaps(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """Mean per class of a two-class target, where the classes differ by more than a quarter."""
    cells = [F.struct(F.lit(c).alias("column"), V.as_number(df, c).alias("num")) for c in columns]
    long = df.select(col(target).cast("string").alias("class"), F.inline(F.array(*cells)))
    means = long.filter(F.col("class").isNotNull() & F.col("num").isNotNull()).groupBy("column", "class").agg(F.avg("num").alias("m"))
    ends = means.groupBy("column").agg(
        F.count("*").alias("classes"), F.min(F.struct("m", "class")).alias("low"), F.max(F.struct("m", "class")).alias("high")
    )
    low, high = F.col("low.m"), F.col("high.m")
    gap = F.abs(high - low) / (F.abs(low) + 1e-9)
    return ends.filter((F.col("classes") == 2) & (low != 0) & (gap > 0.25)).select(
        "column", F.col("low.class").alias("low_class"), V.finite(low, 4).alias("low_mean"),
        F.col("high.class").alias("high_class"), V.finite(high, 4).alias("high_mean"),
    )


def gap_findings(gaps: DataFrame, target: str) -> DataFrame:
    return _finding(
        gaps, "business", F.col("column"),
        F.format_string(
            f"the mean of '%s' is %.2f for '%s' and %.2f for '%s' of '{target}'",
            "column", "high_mean", "high_class", "low_mean", "low_class",
        ),
        low=F.col("low_mean"), high=F.col("high_mean"),
    )


def findings(df: DataFrame, facts: DataFrame, target: str | None = None) -> DataFrame:
    """All findings, or one neutral line if nothing stands out."""
    kinds = P.kinds_of(facts)
    numbers = K.of_kind(kinds, K.NUMERIC)
    labels = K.of_kind(kinds, K.CATEGORICAL, K.BOOLEAN)
    parts = []
    if numbers:
        parts.append(skew_findings(numeric_summary(df, numbers)))
    if labels:
        parts.append(dominance_findings(categorical_summary(df, labels)))
    if len(numbers) >= 2:
        parts.append(correlation_findings(top_pairs(correlations(df, numbers))))
    if target in labels:
        parts.append(imbalance_findings(df, target))
        if numbers:
            parts.append(gap_findings(group_gaps(df, target, numbers), target))
    rows = [r for part in parts for r in part.collect()]
    if not rows:
        rows = [("data_quality", "", "no strong skew, imbalance or correlation stands out", {})]
    return df.sparkSession.createDataFrame(rows, FINDING)
