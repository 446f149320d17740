"""A training corpus from ``documents``: each stage applies one operator to all that the stage before kept.

``run`` returns the pieces of the packed documents. Stages one to four return the columns of ``documents``; where line
dedup rewrites a text, ``n_chars`` follows it. Rows with a null id pass the stages like other rows; near-duplicate
removal keeps one row per group, the smallest id first, a null id only where the group has no other. An empty table
gives empty stages. Further columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import common, decontaminate, lines, packing, quality, simhash


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return docs.where(quality.scored(docs, model) >= 0.5)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that an earlier document holds."""
    done = lines.dedupe(lines.build(docs), docs, inserted=True).select(docs.columns)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))
    return done


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", classify),
    ("line dedup", drop_lines),
    ("near duplicates", drop_near_copies),
    ("decontamination", decontaminated),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = common.stored(docs)
    return docs
