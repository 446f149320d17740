"""Running checked SQL over frames or tables."""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions import tables, values as V
from plumbline.plans import guard
from plumbline.plans.apart import apart

DATASET_ROWS, TABLE_ROWS, TIMEOUT_SECONDS = 1000, 500, 30


class Refused(ValueError):
    """The text did not pass the checks."""


@dataclass
class Result:
    """Rows of a bounded result, or the reason why there are none."""

    columns: list[str]
    rows: list[dict]
    truncated: bool = False
    seconds: float = 0.0
    error: str | None = None
    error_code: str | None = None

    @property
    def row_count(self) -> int:
        return len(self.rows)


def statement(spark: SparkSession, sql: str, views: dict[str, DataFrame], args: dict | None = None,
              policy: guard.Policy | None = None, dataset: bool = False) -> DataFrame:
    """The frame of a checked statement over named frames; nothing runs yet."""
    problem = guard.check_dataset_sql(sql) if dataset else guard.check_read_only(sql)
    text = sql.strip().rstrip(";")
    problem = problem or guard.check_scope(spark, text, set(views))
    problem = problem or (guard.check_policy(spark, text, policy) if policy else None)
    if problem:
        raise Refused(problem)
    if guard.references(spark, text).functions & {*tables.TABLE_FUNCTIONS, *tables.STATE_FUNCTIONS}:
        tables.register(spark)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return apart(spark.sql(text, args=args) if args else spark.sql(text))


def capped(df: DataFrame, rows: int) -> DataFrame:
    """The first ``rows`` rows, with ``truncated``: whether the result goes on. Lazy; whether it does is a subquery that stops at one row."""
    return df.limit(rows).withColumn("truncated", df.offset(rows).limit(1).agg(F.count("*") > 0).scalar())


def fetch(df: DataFrame, rows: int, timeout: float = TIMEOUT_SECONDS) -> Result:
    """At most ``rows`` rows; one more is read to know whether the result goes on."""
    context, tag = df.sparkSession.sparkContext, f"q{uuid.uuid4().hex}"
    started = time.time()
    context.addJobTag(tag)
    timer = threading.Timer(timeout, context.cancelJobsWithTag, [tag])
    timer.start()
    try:
        found = V.json_safe(df).limit(rows + 1).collect()
    except (PySparkException, Py4JJavaError) as exc:
        return Result(df.columns, [], False, time.time() - started, *friendly(exc))
    finally:
        timer.cancel()
        context.removeJobTag(tag)
    listed = [r.asDict(recursive=True) for r in found[:rows]]
    return Result(df.columns, listed, len(found) > rows, time.time() - started)


def friendly(exc: Exception) -> tuple[str, str]:
    """A short message and a stable code."""
    code = getattr(exc, "getCondition", lambda: None)() or type(exc).__name__
    if isinstance(exc, ParseException):
        return "the SQL could not be parsed", "syntax_error"
    if "TABLE_OR_VIEW_NOT_FOUND" in code:
        return "a table does not exist", "unknown_table"
    if "UNRESOLVED_COLUMN" in code:
        return "a column does not exist", "unknown_column"
    if "cancel" in str(exc).lower():
        return "the query took too long", "timeout"
    if isinstance(exc, AnalysisException):
        return "the query does not fit the tables", "invalid_query"
    return "the query failed", "execution_error"


def run_on_dataset(df: DataFrame, sql: str, rows: int = DATASET_ROWS, name: str = "data") -> Result:
    """SQL over one frame, named ``data``; broken SQL gives an error result."""
    return _run(df.sparkSession, sql, {name: df}, rows, dataset=True)


def run_on_tables(spark: SparkSession, sql: str, tables: dict[str, DataFrame], rows: int = TABLE_ROWS,
                  policy: guard.Policy | None = None, args: dict | None = None, timeout: float = TIMEOUT_SECONDS) -> Result:
    return _run(spark, sql, tables, rows, policy=policy, args=args, timeout=timeout)


def _run(spark, sql, views, rows, timeout: float = TIMEOUT_SECONDS, **checks) -> Result:
    try:
        return fetch(statement(spark, sql, views, **checks), rows, timeout)
    except Refused as refused:
        return Result([], [], error=str(refused), error_code="refused")
    except PySparkException as exc:
        message, code = friendly(exc)
        return Result([], [], error=message, error_code=code)


def explain(df: DataFrame, lines: int = 20) -> list[str]:
    """The first lines of the formatted plan."""
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    return text.splitlines()[:lines]
