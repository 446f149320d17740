"""Column kinds and date recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions import counts as C, moments as M, ranks as R, text as X, values as V
from plumbline.session import col

NUMERIC, CATEGORICAL, DATETIME, BOOLEAN, TEXT, EMPTY = (
    "numeric", "categorical", "datetime", "boolean", "text", "empty",
)
LONG_TEXT = 40


SCAN_SCHEMA = (
    "ordinal int, column string, dtype string, rows long, count long, missing long, mean double, std double, "
    "min double, max double, skew double, kurtosis double, two_valued boolean, integral boolean, "
    "avg_length double, numeric_like double, date_like double, untrimmed long, first_time string, last_time string"
)


def _number_part(df: DataFrame, columns: list[str]) -> DataFrame:
    n = F.col("num")
    scanned = C.number_cells(df, columns).groupBy("c").agg(
        F.count("*").alias("rows"), F.count(n).alias("count"),
        F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"), F.min(n).alias("min"), F.max(n).alias("max"),
        M.sample_skew(n).alias("skew"), M.sample_kurtosis(n).alias("kurtosis"),
        F.bool_and(n.isin(0.0, 1.0)).alias("two_valued"), F.bool_and(V.is_integral(n)).alias("integral"),
    )
    return C.named(scanned, columns)


def _label_shapes(n: Column, kept: Column) -> list[Column]:
    """Shapes of ``txt`` values that stand for ``n`` cells each."""
    s = F.col("txt")
    share = lambda c: F.try_divide(F.sum(F.when(c, n).otherwise(0)), kept)
    return [
        F.bool_and(X.is_boolean_word(s)).alias("two_valued"),
        F.try_divide(F.sum(F.length(s) * n), kept).cast("double").alias("avg_length"),
        share(X.looks_numeric(s)).cast("double").alias("numeric_like"),
        share(X.looks_dated(s)).cast("double").alias("date_like"),
        F.sum(F.when(s != X.strip(s), n).otherwise(0)).cast("long").alias("untrimmed"),
    ]


def _label_part(df: DataFrame, columns: list[str], counts: DataFrame | None) -> DataFrame:
    """Text shapes from the cells, or from value counts where these are at hand:
    then each distinct label is looked at once."""
    if counts is None:
        one, kept = F.when(F.col("txt").isNotNull(), 1), F.count("txt")
        scanned = C.label_cells(df, columns).groupBy("c").agg(
            F.count("*").alias("rows"), kept.alias("count"), *_label_shapes(one, kept)
        )
        return C.named(scanned, columns)
    total = df.agg(F.count("*").alias("n")).scalar()
    kept = F.sum("n")
    labels = counts.filter(F.col("column").isin(columns))
    scanned = labels.groupBy("column").agg(kept.alias("count"), *_label_shapes(F.col("n"), kept))
    listed = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return listed.join(scanned, "column", "left").withColumn("count", F.coalesce("count", F.lit(0))).withColumn("rows", total)


def _other_part(df: DataFrame, columns: list[str]) -> DataFrame:
    when = lambda c: col(c).cast("timestamp") if V.is_time(df, c) else F.lit(None).cast("timestamp")
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).isNotNull().alias("has"), when(c).alias("t")) for c in columns
    ])))
    return long.groupBy("column").agg(
        F.count("*").alias("rows"), F.count_if("has").alias("count"),
        F.min("t").cast("string").alias("first_time"), F.max("t").cast("string").alias("last_time"),
    )


def scan_columns(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """One row per column: counts, moments, text shapes and time range.

    Columns are unpivoted by type and grouped by name, so the generated code
    stays small for wide tables and each task sends one row per column.
    """
    numbers = [c for c in df.columns if V.is_numeric(df, c)]
    labels = [c for c in df.columns if V.is_text(df, c)]
    others = [c for c in df.columns if c not in numbers and c not in labels]
    parts = [
        make(names)
        for make, names in (
            (lambda c: _number_part(df, c), numbers), (lambda c: _label_part(df, c, counts), labels), (lambda c: _other_part(df, c), others)
        )
        if names
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    listed = df.sparkSession.createDataFrame(
        [(i, c, V.data_type(df, c).simpleString()) for i, c in enumerate(df.columns)],
        "ordinal int, column string, dtype string",
    )
    schema = T._parse_datatype_string(SCAN_SCHEMA)
    joined = listed.join(out, "column", "left").withColumn("missing", F.col("rows") - F.col("count"))
    made = set(joined.columns)
    return joined.select([
        (F.coalesce(f.name, F.lit(0)) if f.name in ("rows", "count", "missing") else F.col(f.name)).cast(f.dataType).alias(f.name)
        if f.name in made else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def kind_of(unique: Column) -> Column:
    """Kind rule over a ``scan_columns`` row and its distinct count."""
    dtype = F.col("dtype")
    text = dtype.isin("string") | dtype.startswith("varchar") | dtype.startswith("char")
    return (
        F.when(F.col("count") == 0, EMPTY)
        .when(dtype == "boolean", BOOLEAN)
        .when(dtype.isin("timestamp", "timestamp_ntz", "date"), DATETIME)
        .when(F.col("mean").isNotNull(), F.when(F.col("two_valued"), BOOLEAN).otherwise(NUMERIC))
        .when(text & F.col("two_valued"), BOOLEAN)
        .when(
            text & (F.col("avg_length") > LONG_TEXT) & (unique > F.greatest(F.lit(50.0), 0.6 * F.col("count"))),
            TEXT,
        )
        .otherwise(CATEGORICAL)
    )


def column_kinds(df: DataFrame) -> DataFrame:
    """``(ordinal, column, dtype, count, missing, kind)``.

    Distinct values are counted only where the kind depends on them: text
    columns with long values.
    """
    rows = scan_columns(df).collect()
    scanned = df.sparkSession.createDataFrame(rows, SCAN_SCHEMA)
    long_text = [r["column"] for r in rows if (r["avg_length"] or 0) > LONG_TEXT]
    if long_text:
        cells = [
            F.struct(F.lit(c).alias("column"), F.count_distinct(col(c)).alias("unique")) for c in long_text
        ]
        distinct = df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    else:
        distinct = df.sparkSession.createDataFrame([], "column string, unique long")
    return scanned.join(distinct, "column", "left").select(
        "ordinal", "column", "dtype", "count", "missing", kind_of(F.col("unique")).alias("kind")
    )


def kind_map(df: DataFrame) -> dict[str, str]:
    return {r["column"]: r["kind"] for r in column_kinds(df).orderBy("ordinal").collect()}


def of_kind(kinds: dict[str, str], *wanted: str) -> list[str]:
    return [c for c, k in kinds.items() if k in wanted]


DATED = 0.8


def coerce_dates(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Turn text columns into timestamps where at least 80 % of all values look like dates and at least 80 % of all rows parse."""
    names = [c for c in df.columns if V.is_text(df, c) and c not in skip]
    if not names:
        return df
    cells = C.label_cells(df, names)
    text = F.col("txt")
    judged = cells.groupBy("c").agg(V.share_if(X.looks_dated(text)).alias("like"), F.avg(X.parse_time(text).isNotNull().cast("int")).alias("parsed"))
    good = [r["column"] for r in C.named(judged, names).collect() if (r["like"] or 0) >= DATED and r["parsed"] >= DATED]
    return df.withColumns({c: X.parse_time(col(c)) for c in names if c in good})


def hash_place(key: Column, seed: int = 42) -> Column:
    """Where a key stands in the order of a sample: 52 bits of a hash of key and seed, as a double."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(seed)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """The ``n`` rows whose unique key comes first in hash order (all rows of a smaller table): the same on every run and layout.

    The cut is the exact ``n``-th place; nothing is sorted in one task, whatever ``n`` is.
    """
    place = hash_place(col(key), seed)
    rows = df.count()
    if n >= rows:
        return df
    if n <= 0:
        return df.limit(0)
    long = df.select(F.lit("all").alias("g"), place.alias("v"))
    want = df.sparkSession.createDataFrame([("all", 0, n - 1)], "g string, slot int, r long")
    cut = R.at_ranks(long, want, ["g"], largest=rows).first()["v"]
    below = df.filter(place < cut)
    tied = df.filter(place == cut).orderBy(col(key)).limit(n - below.count())
    return below.unionByName(tied)
