"""Incremental refresh: partial aggregates per day and source file, merged without reading a file twice.

A rollup is a folder with two tables. ``parts`` holds, for every version, the partial aggregates of the files that were read in
it: one row per file, day and key. ``manifest`` holds, for every version, the files seen so far with their size, time
and the version whose parts are theirs. A refresh lists the files, reads the new and the changed ones only, writes their
parts and then a manifest; a file that changed or went away thereby loses its old parts. The manifest is what makes a
version count: a refresh that dies before has changed nothing, and one that is run again begins from the last manifest.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.session import col

_MANIFEST = "file string, size long, changed timestamp, version int"
# Partial aggregates of a measure ``m``, and how they are merged: counts and sums add up, bounds stay bounds.
_PARTIAL = {
    "count": lambda c: {"n": F.count(c)},
    "sum": lambda c: {"s": F.sum(c)},
    "min": lambda c: {"low": F.min(c)},
    "max": lambda c: {"high": F.max(c)},
    "avg": lambda c: {"n": F.count(c), "s": F.sum(c)},
    "stddev": lambda c: {"n": F.count(c), "s": F.sum(c), "q": F.sum(c.cast("double") * c.cast("double"))},
}
_MERGE = {"n": F.sum, "s": F.sum, "q": F.sum, "low": F.min, "high": F.max}


def _final(kind: str, name: str):
    p = lambda part: F.col(f"{name}__{part}")
    if kind == "avg":
        return p("s") / p("n")
    if kind == "stddev":
        n, s = p("n"), p("s").cast("double")
        return F.when(n > 1, F.sqrt(F.greatest((p("q") - s * s / n) / (n - 1), F.lit(0.0))))
    return p({"count": "n", "sum": "s", "min": "low", "max": "high"}[kind])


@dataclass
class Rollup:
    """``measures`` maps a result column to ``(kind, column)``; ``day`` is the time column whose date is the first key.

    ``prepare`` turns the rows of the files into the rows that are counted (filters, joins to small tables).
    """

    path: str
    day: str
    keys: list[str]
    measures: dict[str, tuple[str, str]]
    prepare: Callable[[DataFrame], DataFrame] = field(default=lambda df: df)

    def version(self, spark: SparkSession) -> int:
        """Number of the last manifest that was written to its end; 0 if there is none."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not store.exists(folder):
            return 0
        names = [s.getPath() for s in store.listStatus(folder)]
        done = [p.getName() for p in names if store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max((int(n.removeprefix("v=")) for n in done), default=0)

    def manifest(self, spark: SparkSession) -> DataFrame:
        now = self.version(spark)
        return spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v={now}") if now else spark.createDataFrame([], _MANIFEST)

    def refresh(self, spark: SparkSession, source: str) -> dict[str, int]:
        """Bring the rollup up to the files that ``source`` holds now; returns how many were read, kept and dropped."""
        now, seen = self.version(spark), self.manifest(spark)
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(source).select(
            F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))
        same = seen.join(listed, ["file", "size", "changed"], "left_semi")
        fresh = [r.file for r in listed.join(seen, ["file", "size", "changed"], "left_anti").select("file").collect()]
        kept, before = same.count(), seen.count()
        if not fresh and kept == before:
            return {"read": 0, "kept": kept, "dropped": 0}
        if fresh:
            # the names of the files to read are the driver's business in any scan; they are listed in their escaped form
            rows = spark.read.parquet(*map(unquote, fresh)).withColumn("_file", F.col("_metadata.file_path"))
            partial = self.prepare(rows).groupBy("_file", F.to_date(col(self.day)).alias("day"), *[col(k) for k in self.keys])
            aggregates = [made.alias(f"{m}__{p}") for m, (kind, c) in self.measures.items() for p, made in _PARTIAL[kind](col(c)).items()]
            partial.agg(*aggregates).write.mode("overwrite").parquet(f"{self.path}/parts/v={now + 1}")
        told = listed.join(seen.select("file", "size", "changed", "version"), ["file", "size", "changed"], "left")
        told = told.select("file", "size", "changed", F.coalesce("version", F.lit(now + 1)).alias("version"))
        told.write.mode("overwrite").parquet(f"{self.path}/manifest/v={now + 1}")
        return {"read": len(fresh), "kept": kept, "dropped": before - kept}

    def result(self, spark: SparkSession) -> DataFrame:
        """``day``, keys and measures over all files of the last manifest, from the parts alone."""
        told = self.manifest(spark)
        versions = [r.version for r in told.select("version").distinct().collect()]
        if not versions:
            raise ValueError("nothing was refreshed yet")
        # A version may have read files without rows only; its folder then has no part to read.
        parts = spark.read.option("basePath", f"{self.path}/parts").parquet(*[f"{self.path}/parts/v={v}" for v in versions])
        owned = parts.join(told.select(F.col("file").alias("_file"), F.col("version").alias("v")), ["_file", "v"], "left_semi")
        names = dict.fromkeys(f"{m}__{p}" for m, (kind, c) in self.measures.items() for p in _PARTIAL[kind](F.lit(0)))
        merged = owned.groupBy("day", *[col(k) for k in self.keys]).agg(*[_MERGE[n.rsplit("__", 1)[1]](n).alias(n) for n in names])
        return merged.select("day", *[col(k) for k in self.keys], *[_final(kind, m).alias(m) for m, (kind, _) in self.measures.items()])

    def compact(self, spark: SparkSession) -> None:
        """Rewrite the parts that still count as one version, so that later merges read one folder."""
        now, told = self.version(spark), self.manifest(spark)
        versions = [r.version for r in told.select("version").distinct().collect()]
        if len(versions) < 2:
            return
        parts = spark.read.option("basePath", f"{self.path}/parts").parquet(*[f"{self.path}/parts/v={v}" for v in versions])
        owned = parts.join(told.select(F.col("file").alias("_file"), F.col("version").alias("v")), ["_file", "v"], "left_semi").drop("v")
        owned.write.mode("overwrite").parquet(f"{self.path}/parts/v={now + 1}")
        told.withColumn("version", F.lit(now + 1)).write.mode("overwrite").parquet(f"{self.path}/manifest/v={now + 1}")
