"""Session set-up and the two places where a job touches more than one plan:
cutting lineage, and deciding whether a frame is small enough to broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A lookup side is broadcast only when it is known to hold at most this many rows, and this many bytes as text.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def build_session(app_name: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the executors this package where it is not installed on them: zipped, through ``addPyFile``."""
    import pathlib
    import shutil

    home = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="plumbline-package-")  # read by the driver only, which serves the file
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/plumbline", "zip", home.parent, home.name))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. A temporary one is made only in local mode, where driver and
    executors are one process; on a cluster an unset folder is an error, as no local folder is seen by all."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return current
    if not configured and not context.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = configured or tempfile.mkdtemp(prefix="plumbline-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and go on from the written copy."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_written(df: DataFrame) -> bool:
    """True for a frame that is a checkpoint, or a projection of one."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.getClass().getSimpleName() == "Project":
        plan = plan.child()
    return plan.getClass().getSimpleName() == "LogicalRDD"


def lookup_join(df: DataFrame, lookup: DataFrame, on, how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a lookup frame, broadcasting it only after its size was checked.

    The lookup is computed once and written; its row count then decides. A larger
    one goes through an ordinary shuffle join, where adaptive execution splits
    hot keys of the left side.
    """
    if not is_written(lookup):
        lookup = cut_lineage(lookup)
    size = F.sum(F.octet_length(F.to_json(F.struct("*")))) if lookup.columns else F.lit(0)
    count, width = lookup.agg(F.count(F.lit(1)), size).first()
    if count <= rows and (width or 0) <= BROADCAST_BYTES:
        lookup = F.broadcast(lookup)
    return df.join(lookup, on, how)


def col(name: str) -> Column:
    """Column reference that is safe for names with dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")

