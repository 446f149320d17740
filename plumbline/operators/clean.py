"""Cleaning operators.

Each takes a frame and parameters and returns ``(frame, record)``. The result is
a lazy plan; statistics an operator needs (a fill value, two fences, a label
mapping) are aggregated first. The figures of a record (cells changed, rows
removed) are counted only when they are read, so a chain of operators costs no
extra pass over the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions import moments as M, ranks as R, text as X, values as V
from plumbline.operators import duplicates as D, profile as P
from plumbline.session import col, cut_lineage, lookup_join



class Record(Mapping):
    """What a step did. Values given as functions are worked out on first reading."""

    def __init__(self, **entries):
        self._entries = entries

    def __getitem__(self, key: str):
        value = self._entries[key]
        if callable(value):
            value = self._entries[key] = value()
        return value

    def __iter__(self) -> Iterator[str]:
        return iter(self._entries)

    def __len__(self) -> int:
        return len(self._entries)

    def __repr__(self) -> str:
        shown = {k: "..." if callable(v) else v for k, v in self._entries.items()}
        return f"Record({shown})"

    def named(self, op: str) -> "Record":
        return Record(op=op, **self._entries)


Result = tuple[DataFrame, Record]


def _with(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Replace a column in place."""
    return df.select([value.alias(c) if c == name else col(c) for c in df.columns])


def _count(df: DataFrame, condition: Column) -> Callable[[], int]:
    return lambda: df.agg(F.count_if(condition)).first()[0]


def trim_whitespace(df: DataFrame, column: str) -> Result:
    old = col(column).cast("string")
    new = X.squeeze(old)
    changed = _count(df, ~old.eqNullSafe(new))
    return _with(df, column, new), Record(column=column, cells_changed=changed)


def label_mapping(df: DataFrame, column: str, order_by: str | None = None) -> DataFrame:
    """``(label, canonical, n)`` for every spelling that is not the most frequent
    of its group; ties go to the spelling seen first, else the smallest."""
    seen = F.min(col(order_by)) if order_by else F.lit(0)
    levels = df.filter(col(column).isNotNull()).groupBy(col(column).cast("string").alias("label")).agg(
        F.count("*").alias("n"), seen.alias("seen")
    )
    levels = levels.withColumn("canon", X.canonical(F.col("label")))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col("seen"), F.col("label")))
    groups = levels.groupBy("canon").agg(best["label"].alias("canonical"), F.count("*").alias("spellings"))
    several = groups.filter(F.col("spellings") > 1).select("canon", "canonical")
    spread = levels.join(several, "canon")
    return spread.filter(F.col("label") != F.col("canonical")).select("label", "canonical", "n")


def standardize_categories(df: DataFrame, column: str, order_by: str | None = None) -> Result:
    mapping = cut_lineage(label_mapping(df, column, order_by))
    marked = mapping.select(F.col("label").alias("_label"), F.col("canonical").alias("_canonical"))
    joined = lookup_join(df, marked, col(column).cast("string") == F.col("_label"))
    out = joined.select([
        F.coalesce(F.col("_canonical"), col(c).cast("string")).alias(c) if c == column else col(c) for c in df.columns
    ])
    row = cache(lambda: mapping.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cells"), F.count("*").alias("labels")).first())
    return out, Record(column=column, cells_changed=lambda: row()["cells"], variants=lambda: row()["labels"])


def _converted(df: DataFrame, column: str, value: Column) -> Result:
    failed = _count(df, col(column).isNotNull() & value.isNull())
    return _with(df, column, value), Record(column=column, failed_conversions=failed)


def to_numeric(df: DataFrame, column: str) -> Result:
    """Text to double; a column that is numeric already keeps its type and every digit."""
    value = V.present(df, column) if V.is_numeric(df, column) else X.parse_number(col(column).cast("string"))
    return _converted(df, column, value)


def to_datetime(df: DataFrame, column: str) -> Result:
    value = col(column).cast("timestamp") if V.is_time(df, column) else X.parse_time(col(column).cast("string"))
    return _converted(df, column, value)


def _rows(before: Callable[[], int], after: Callable[[], int], **more) -> Record:
    return Record(rows_before=before, rows_after=after, rows_removed=lambda: before() - after(), **more)


def drop_duplicates(df: DataFrame, order_by: list[str], subset: list[str] | None = None,
                    keep: str | bool = "first") -> Result:
    out = D.drop_duplicates(df, order_by, subset, keep)
    return out, _rows(cache(df.count), cache(out.count))


def drop_column(df: DataFrame, column: str) -> Result:
    if column not in df.columns:
        raise ValueError(f"no column {column!r}")
    return df.drop(column), Record(column=column)


def drop_rows_missing(df: DataFrame, columns: list[str] | None = None) -> Result:
    names = columns or df.columns
    keep = F.lit(True)
    for c in names:
        keep = keep & ~V.is_missing(df, c)
    out = df.filter(keep)
    row = cache(lambda: df.agg(F.count("*").alias("n"), F.count_if(keep).alias("kept")).first())
    return out, _rows(lambda: row()["n"], lambda: row()["kept"], columns=list(names))


def choose_strategy(df: DataFrame, column: str) -> str:
    """Median for skewed numbers, mean for others, mode for labels."""
    if not V.is_numeric(df, column):
        return "mode"
    skew = df.agg(M.sample_skew(V.as_number(df, column)).alias("s")).first()["s"]
    return "median" if abs(skew or 0.0) > 1.0 else "mean"


def most_frequent(df: DataFrame, column: str):
    """The most frequent value, the smallest on ties; ``None`` if all are missing."""
    value = V.present(df, column)
    counted = df.filter(value.isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("n"))
    return counted.agg(F.min(F.struct((-F.col("n")).alias("k"), "v"))["v"].alias("v")).first()["v"]


def fill_value(df: DataFrame, column: str, strategy: str, value=None):
    if V.is_numeric(df, column):
        if strategy == "mean":
            return df.agg(F.avg(V.as_number(df, column))).first()[0]
        if strategy == "median":
            return R.quantile_map(df, [column], [0.5])[column].get(0.5)
        if strategy == "mode":
            mode = most_frequent(df, column)
            return 0 if mode is None else mode
        return value or 0
    if strategy in ("mode", "auto"):
        mode = most_frequent(df, column)
        return "Unknown" if mode is None else mode
    return "Unknown" if value is None else value


def _filled(df: DataFrame, column: str, fill) -> Column:
    """The column with gaps filled, in its own type. Whole numbers become decimals only where the fill has a fraction."""
    kind = V.data_type(df, column)
    if not V.is_numeric(df, column):
        return F.coalesce(col(column), F.lit(fill))
    if V.is_float(df, column):
        return F.coalesce(V.as_number(df, column), F.lit(float(fill)))
    if isinstance(kind, T.IntegralType) and float(fill) % 1:
        return F.coalesce(col(column).cast("decimal(38,6)"), F.lit(fill).cast("decimal(38,6)"))
    return F.coalesce(col(column), F.lit(fill).cast(kind))


def impute_missing(df: DataFrame, column: str, strategy: str = "auto", value=None, key: str | None = None) -> Result:
    if strategy == "auto":
        strategy = choose_strategy(df, column)
    gaps = _count(df, V.is_missing(df, column))
    if strategy == "knn":
        from plumbline.operators.neighbours import knn_impute

        if key is None:
            raise ValueError("knn imputation needs a unique key column")
        out, k = knn_impute(df, column, key)
        return out, Record(column=column, strategy="knn", neighbours=k, missing_before=gaps)
    fill = fill_value(df, column, strategy, value)
    out = df if fill is None else _with(df, column, _filled(df, column, fill))
    after = gaps if fill is None else 0
    return out, Record(column=column, strategy=strategy, fill_value=fill, missing_before=gaps, missing_after=after)


def handle_outliers(df: DataFrame, column: str, strategy: str = "flag") -> Result:
    """Remove, cap, flag or keep values outside the 1.5-IQR fences."""
    x = V.as_number(df, column) if V.is_numeric(df, column) else X.parse_number(col(column).cast("string"))
    q = R.quantile_map(df.select(x.alias(column)), [column], [0.25, 0.75])
    limits = P.fences(q).get(column)
    outside = F.coalesce((x < limits[0]) | (x > limits[1]), F.lit(False)) if limits else F.lit(False)
    row = cache(lambda: df.agg(F.count("*").alias("n"), F.count_if(outside).alias("out")).first())
    out = df
    if strategy == "remove":
        out = df.filter(~outside)
    elif strategy == "cap" and limits:
        capped = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(limits[0])), F.lit(limits[1])))
        out = _with(df, column, capped)
    elif strategy == "flag":
        out = df.withColumn(f"{column}__is_outlier", outside)
    removed = lambda: row()["out"] if strategy == "remove" else 0
    return out, _rows(lambda: row()["n"], lambda: row()["n"] - removed(), column=column, strategy=strategy, outliers=lambda: row()["out"])


def rare_labels(df: DataFrame, column: str, min_frequency: float = 0.01) -> DataFrame:
    """``(label, n)`` of the labels whose share of non-missing cells is below the threshold."""
    labels = df.filter(col(column).isNotNull()).groupBy(col(column).alias("label")).agg(F.count("*").alias("n"))
    total = labels.agg(F.sum("n").alias("total")).scalar()
    return labels.filter(F.col("n") / total < min_frequency)


def group_rare_categories(df: DataFrame, column: str, min_frequency: float = 0.01, label: str = "Other") -> Result:
    rare = cut_lineage(rare_labels(df, column, min_frequency).select(F.col("label").alias("_rare")))
    joined = lookup_join(df, rare, col(column) == F.col("_rare"))
    out = joined.select([
        F.when(F.col("_rare").isNotNull(), F.lit(label)).otherwise(col(c)).alias(c) if c == column else col(c)
        for c in df.columns
    ])
    return out, Record(column=column, levels_grouped=rare.count, label=label)


def map_categories(df: DataFrame, column: str, mapping: dict[str, str]) -> Result:
    out = df.replace(mapping, subset=[column])
    return out, Record(column=column, cells_changed=_count(df, col(column).isin(list(mapping))))


OPERATIONS: dict[str, Callable[..., Result]] = {
    f.__name__: f
    for f in (
        trim_whitespace, standardize_categories, to_numeric, to_datetime, drop_duplicates, drop_column,
        drop_rows_missing, impute_missing, handle_outliers, group_rare_categories, map_categories,
    )
}
# Operators that may run without a question.
SAFE_OPERATIONS = {"trim_whitespace", "standardize_categories", "to_numeric", "drop_duplicates"}
# Operators that follow the row order, and the parameter it arrives in.
ORDERED = {"drop_duplicates", "standardize_categories"}


def apply_operations(df: DataFrame, operations: list[dict], row_key: str | None = None) -> tuple[DataFrame, list[Record]]:
    """Run operators in order. A column that is gone by then gives a skipped record."""
    records = []
    for step in operations:
        name, params = step["op"], dict(step.get("params") or {})
        if name not in OPERATIONS:
            raise ValueError(f"unknown cleaning operation {name!r}")
        if "column" in params and params["column"] not in df.columns and name != "drop_column":
            records.append(Record(op=name, skipped=True, reason=f"no column {params['column']!r}"))
            continue
        if row_key and name in ORDERED:
            params.setdefault("order_by", [row_key] if name == "drop_duplicates" else row_key)
        if row_key and name == "impute_missing":
            params.setdefault("key", row_key)
        df, record = OPERATIONS[name](df, **params)
        records.append(record.named(name))
    return df, records


def frame_stats(df: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """``(rows, columns, missing_cells, duplicate_rows)`` in one row."""
    names = [c for c in df.columns if c not in ignore]
    missing = sum((F.count_if(V.is_missing(df, c)) for c in names), F.lit(0).cast("long"))
    dup = D.duplicate_rows(df.select([col(c) for c in names])).scalar()
    return df.agg(F.count("*").alias("rows"), missing.alias("missing_cells")).select(
        "rows", F.lit(len(names)).alias("columns"), "missing_cells", dup.alias("duplicate_rows")
    )


def column_summary(df: DataFrame) -> DataFrame:
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(V.data_type(df, c).simpleString()).alias("dtype"),
            F.count_if(V.is_missing(df, c)).alias("missing"),
        )
        for c in df.columns
    ]
    return df.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))


def column_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per column: unchanged, dropped, added or modified, with types and missing counts."""
    a, b = column_summary(before).alias("a"), column_summary(after).alias("b")
    joined = a.join(b, F.col("a.column") == F.col("b.column"), "full_outer")
    same = (F.col("a.dtype") == F.col("b.dtype")) & (F.col("a.missing") == F.col("b.missing"))
    status = (
        F.when(F.col("b.column").isNull(), "dropped").when(F.col("a.column").isNull(), "added")
        .when(same, "unchanged").otherwise("modified")
    )
    return joined.select(
        F.coalesce("a.column", "b.column").alias("column"), status.alias("status"),
        F.col("a.dtype").alias("dtype_before"), F.col("b.dtype").alias("dtype_after"),
        F.col("a.missing").alias("missing_before"), F.col("b.missing").alias("missing_after"),
    )


def preview(df: DataFrame, operations: list[dict], row_key: str | None = None) -> dict:
    """What a list of operators would do; the frame itself is untouched."""
    after, records = apply_operations(df, operations, row_key)
    ignore = (row_key,) if row_key else ()
    return {
        "records": records, "before": frame_stats(df, ignore), "after": frame_stats(after, ignore),
        "columns": column_diff(df, after), "result": after,
    }


