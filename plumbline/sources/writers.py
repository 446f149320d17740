"""Writing results, pinned tables and fitted models."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.functions import values as V
from plumbline.session import col


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV parts with a header; quotes are doubled, missing cells are empty."""
    V.json_safe(df).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option(
        "nullValue", ""
    ).option("emptyValue", "").csv(path)


def csv_lines(df: DataFrame) -> DataFrame:
    """The same text as rows of one column, for embedding in other outputs."""
    safe = V.json_safe(df)

    def cell(name):
        text = col(name).cast("string")
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.when(text.rlike('[,"\n]'), quoted).otherwise(text), F.lit(""))

    return safe.select(F.concat_ws(",", *[cell(c) for c in safe.columns]).alias("line"))


def pin_table(df: DataFrame, name: str, kind: str = "table", mode: str = "overwrite", partition_by: list[str] | None = None) -> DataFrame:
    """Store a computed result as a table with its chart kind, and read it back."""
    writer = df.withColumn("_chart", F.lit(kind)).write.mode(mode).format("parquet")
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, mode: str = "overwrite") -> DataFrame:
    """Store a table bucketed and sorted by its join keys, so later joins on them need no shuffle."""
    df.write.mode(mode).format("parquet").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def export_model(trained, path: str) -> None:
    """The fitted pipeline and its description side by side."""
    trained.model.write().overwrite().save(f"{path}/pipeline")
    about = {
        "task": trained.task, "target": trained.target, "primary_metric": trained.primary_metric, "best_model": trained.best_model,
        "numeric": trained.features.numeric, "categorical": trained.features.categorical, "classes": trained.classes,
        "comparison": [{k: (float(v) if hasattr(v, "item") else v) for k, v in r.items()} for r in trained.comparison], "warnings": trained.warnings,
    }
    spark = trained.train.sparkSession
    spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    return PipelineModel.load(f"{path}/pipeline"), about
