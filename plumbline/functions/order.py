"""Row numbers over a whole table without sending it to one task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from plumbline.session import checkpoint_dir, cut_lineage


def number_rows(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Add a zero-based row number in the given order.

    Rows are range-partitioned and written once, so each row's partition is
    fixed; every partition is numbered on its own and shifted by the sizes of
    the partitions before it (one number per partition).
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = cut_lineage(ranged)
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    shifts, seen = [], 0
    for part in sorted(sizes):
        shifts.append((part, seen))
        seen += sizes[part]
    offsets = df.sparkSession.createDataFrame(shifts, "_part int, _shift long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = ranged.withColumn("_inside", inside).join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_shift") + F.col("_inside") - 1).drop("_part", "_inside", "_shift")


class Pages:
    """A table written once in ranges of its order, so that any page is read from the one or two ranges it lies in.

    The sizes of the ranges (one number per partition) say where a page begins; the last page costs what the first one costs.
    ``order`` should be total; rows that are equal in it may change places between pages otherwise.
    """

    def __init__(self, df: DataFrame, order: list[Column], path: str | None = None):
        self.spark, self.order = df.sparkSession, order
        self.path = path or f"{checkpoint_dir(self.spark)}/pages/{uuid.uuid4().hex}"
        ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
        ranged.sortWithinPartitions("_part", *order).write.mode("overwrite").partitionBy("_part").parquet(self.path)
        self.schema = StructType([*df.schema.fields, StructField("_part", IntegerType())])
        counts = self._read().groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()
        self.sizes = sorted((r["_part"], r["n"]) for r in counts)
        self.total = sum(n for _, n in self.sizes)

    def _read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def rows(self, offset: int, count: int) -> DataFrame:
        """Rows ``[offset, offset + count)`` in order."""
        parts, begin, seen = [], 0, 0
        for part, n in self.sizes:
            if seen + n > offset and seen < offset + count:
                begin = begin if parts else seen
                parts.append(part)
            seen += n
        return self._read().where(F.col("_part").isin(parts)).drop("_part").orderBy(*self.order).offset(max(0, offset - begin)).limit(count)

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number``, from 1."""
        return self.rows((number - 1) * size, size)
