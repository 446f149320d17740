"""Table functions and mergeable states for checked SQL.

``register`` makes them known to a session; statements call them like built-in ones:
``SELECT * FROM sessions(TABLE(SELECT user_id, ts FROM events), 21600)``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import IntegerType, LongType, StructType, TimestampNTZType, TimestampType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

_TIMES, _WHOLE = (TimestampType, TimestampNTZType), (IntegerType, LongType)


class Sessions:
    """``sessions(TABLE(key columns ..., time column), gap seconds)``: one row per stretch of a key's rows in which no two neighbours
    are ``gap`` or more apart: the key, ``first_seen``, ``last_seen`` and ``events``.

    The last column is the time, those before it the key; Spark deals rows by key and sorts them by time. A key's rows pass one
    by one, so memory is one session. Rows without a time are left out; a table without rows gives none.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) < 2:
            raise ValueError("sessions needs a table of key columns and a time column")
        *keys, time = rows.dataType.fields
        if not isinstance(time.dataType, _TIMES):
            raise ValueError(f"the last column, {time.name}, must be a time")
        if not isinstance(gap.dataType, _WHOLE) or not gap.isConstantExpression or gap.value is None or gap.value <= 0:
            raise ValueError("the gap must be a positive whole number of seconds")
        schema = StructType()
        for key in keys:
            schema = schema.add(key)
        schema = schema.add("first_seen", time.dataType).add("last_seen", time.dataType).add("events", LongType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(f"`{k.name}`") for k in keys], orderBy=[OrderingColumn(f"`{time.name}`")])

    def __init__(self):
        self.key, self.first, self.last, self.events = None, None, None, 0

    def eval(self, rows: Row, gap: int) -> Iterator[tuple]:
        *key, at = rows
        if at is None:
            return
        if self.events and (at - self.last).total_seconds() >= gap:
            yield self._row()
            self.events = 0
        if not self.events:
            self.key, self.first = key, at
        self.last, self.events = at, self.events + 1

    def terminate(self) -> Iterator[tuple]:
        if self.events:
            yield self._row()

    def _row(self) -> tuple:
        return (*self.key, self.first, self.last, self.events)


# Scalar SQL over arrays of states, so that partial aggregates can be kept as rows and merged by any later statement.
STATE = "STRUCT<n: BIGINT, mean: DOUBLE, m2: DOUBLE>"
STATE_FUNCTIONS = {
    "moments_of": ("n BIGINT, mean DOUBLE, variance DOUBLE", STATE,
                   "named_struct('n', n, 'mean', coalesce(mean, 0D), 'm2', coalesce(variance, 0D) * n)"),
    "merge_moments": (f"states ARRAY<{STATE}>", STATE,
                      "aggregate(states, named_struct('n', 0L, 'mean', 0D, 'm2', 0D), (a, b) -> CASE WHEN b IS NULL OR b.n = 0 THEN a ELSE named_struct('n', a.n + b.n, "
                      "'mean', a.mean + (b.mean - a.mean) * b.n / (a.n + b.n), 'm2', a.m2 + b.m2 + (b.mean - a.mean) * (b.mean - a.mean) * a.n * b.n / (a.n + b.n)) END)"),
    "moments_std": (f"state {STATE}", "DOUBLE", "CASE WHEN state.n > 1 THEN sqrt(state.m2 / (state.n - 1)) END"),
}
TABLE_FUNCTIONS = {"sessions": Sessions}


def register(spark: SparkSession) -> None:
    """Make the table functions and the state functions known to a session."""
    from pyspark.sql.functions import udtf

    for name, made in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(made))
    for name, (params, returns, body) in STATE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
