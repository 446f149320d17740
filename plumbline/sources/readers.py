"""Reading uploads and tables into frames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.functions import values as V
from plumbline.operators.kinds import coerce_dates
from plumbline.session import col

ROW_ID = "_row_id"
DELIMITERS = [";", "\t", "|"]


class BadUpload(ValueError):
    """The input holds no usable table."""


def from_records(spark: SparkSession, columns: list[str], rows: list) -> DataFrame:
    """Rows as dicts or lists, numbered by ``_row_id`` in the given order."""
    if not columns or not rows:
        raise BadUpload("no columns or no rows")
    listed = [[r.get(c) for c in columns] if isinstance(r, dict) else list(r) for r in rows]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(listed)], [ROW_ID, *columns])


def sniff_delimiter(header: str) -> str:
    """Comma unless the header has none and holds another usual separator."""
    if "," in header:
        return ","
    return next((d for d in DELIMITERS if d in header), ",")


def tidy_header(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop empty columns, strip names, reject inputs that are no table."""
    names = [c for c in df.columns if c not in keep]
    if not names:
        raise BadUpload("no columns")
    present = df.agg(F.count("*").alias("_rows"), *[F.count(V.present(df, c)).alias(c) for c in names]).first()
    if not present["_rows"]:
        raise BadUpload("no rows")
    kept = [c for c in names if present[c]]
    if not kept:
        raise BadUpload("only empty columns")
    if len(kept) == 1 and re.search(r"[;\t|,]", kept[0]):
        raise BadUpload("one column whose name holds a separator: wrong delimiter?")
    return df.select(*[col(c) for c in keep], *[col(c).alias(c.strip()) for c in kept])


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, dates: bool = True, schema=None, multiline: bool = True) -> DataFrame:
    """A delimited file or folder with a header; the separator is taken from the header unless given.

    Quoted line breaks are read as part of a value. That keeps a file in one task, so a huge single file without
    such breaks is better read with ``multiline=False``, which splits it.
    """
    if delimiter is None:
        first = spark.read.text(path).limit(1).collect()
        if not first:
            raise BadUpload("empty file")
        delimiter = sniff_delimiter(first[0][0])
    reader = spark.read.option("header", True).option("sep", delimiter).option("multiLine", multiline).option("escape", '"')
    reader = reader.option("ignoreLeadingWhiteSpace", False).option("preferDate", False)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    df = tidy_header(df)
    return coerce_dates(df) if dates else df


def read_tsv(spark: SparkSession, path: str, **more) -> DataFrame:
    return read_csv(spark, path, "\t", **more)


def read_xlsx(spark: SparkSession, path: str | None = None, content: str | None = None, sheet: str | None = None, dates: bool = True) -> DataFrame:
    """A workbook from a path or from base64 content: all its sheets, or the one named, a task per sheet.

    A workbook is an upload: its packed content travels to every task that reads one of its sheets.
    """
    from plumbline.sources.workbook import WorkbookSource

    if content is None:
        found = spark.read.format("binaryFile").load(path).select(F.base64("content")).collect()
        if len(found) != 1:
            raise BadUpload("one workbook at a time")
        content = found[0][0]
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook").option("content", content)
    df = tidy_header((reader.option("sheet", sheet) if sheet else reader).load())
    return coerce_dates(df) if dates else df


def from_table(spark: SparkSession, table: str, schema: str | None = None, rows: int | None = None,
               order_by: list[str] | None = None) -> DataFrame:
    """A catalog table by checked name: all of it, or its first ``rows`` rows."""
    for part in (table, *([schema] if schema else [])):
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_$]*", part):
            raise ValueError(f"bad identifier {part!r}")
    df = spark.table(f"`{schema}`.`{table}`" if schema else f"`{table}`")
    if rows is None:
        return df
    df = df.orderBy(*[col(c) for c in order_by]) if order_by else df
    return df.limit(rows)


def from_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, lower: int = 0, upper: int = 0,
              partitions: int = 8, **options) -> DataFrame:
    """A database table, read in parallel ranges when a numeric column is named."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", lower)
        reader = reader.option("upperBound", upper).option("numPartitions", partitions)
    return reader.load()
