"""Missing values, rounding, safe division and JSON-ready values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.session import col

FLOATS = (T.DoubleType, T.FloatType)
NUMERIC = T.NumericType
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), FLOATS)


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), NUMERIC)


def is_time(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), TIMES)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), T.StringType)


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, or NaN in a floating column."""
    c = col(name)
    return c.isNull() | F.isnan(c) if is_float(df, name) else c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL."""
    c = col(name)
    return F.when(~F.isnan(c), c) if is_float(df, name) else c


def as_number(df: DataFrame, name: str) -> Column:
    """Non-missing numbers as double, with negative zero folded into zero."""
    return present(df, name).cast("double") + F.lit(0.0)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in all floating columns, once, at ingest."""
    return df.select([present(df, c).alias(c) if is_float(df, c) else col(c) for c in df.columns])


def pct(part: Column, whole: Column) -> Column:
    """Share in percent with two digits; 0 for an empty whole."""
    return F.coalesce(F.round(F.try_divide(100.0 * part, whole), 2), F.lit(0.0))


def finite(value: Column, digits: int = 6) -> Column:
    """Rounded value; NaN and infinities become NULL."""
    value = value.cast("double")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, F.round(value, digits))


def share_if(condition: Column) -> Column:
    """Aggregate: share of rows with a true condition among rows where it is not NULL."""
    return F.avg(condition.cast("int"))


def is_integral(value: Column) -> Column:
    return value % 1 == 0


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL, integral decimals to integers, times to ISO text."""
    out = []
    for field in df.schema.fields:
        c, t = col(field.name), field.dataType
        if isinstance(t, FLOATS):
            c = F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
        elif isinstance(t, T.DecimalType):
            c = c.cast("long") if t.scale == 0 else c.cast("double")
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(c, "SSSSSS")
            c = F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
        out.append(c.alias(field.name))
    return df.select(out)


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, missing values written as null."""
    return json_safe(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
