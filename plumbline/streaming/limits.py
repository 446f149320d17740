"""Rate limits for streams in which one user may hold a large part of all events.

A window opens at a user's first hit and the next one at the first hit after its
end, so windows form a chain. A user with many hits is cut into blocks of time:
every block states, for each hit at which a chain may enter it, where the chain
leaves it; the chain then hops over these short lists, one lookup a block, and the
blocks find their windows side by side. Hits are numbered by counts per slice of a window.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.session import checkpoint_dir, lookup_join
from plumbline.streaming.live import HITS, LATE, ROCKS

# A user with more distinct times in a micro-batch than this is cut into blocks.
GROUP_ROWS = 100_000
# Slices of a window in which hits are numbered apart.
SLICES = 64
_OPEN = "user_id long, opened long, n long"


def released(events: DataFrame, late: str = LATE) -> DataFrame:
    """Each hit, with its number of copies, once the watermark has passed its time: no earlier hit can still arrive.

    State is spread over the hits themselves, not over users. Hits without a user or a time are left out.
    """
    hits = events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    return hits.groupBy("user_id", "event_id", "ts").agg(F.count("*").alias("copies"))


def _exits(span: int):
    """Per block of sorted distinct times: hits at which a chain may enter, and the end of its last window in the block.

    A chain enters at most one window after the block's first moment, or at the first hit after that. Neighbouring
    entries with the same end are stated once, by the latest of them.
    """
    def step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(rows["at"].to_numpy(np.int64))
        here, following = np.arange(len(at)), np.searchsorted(at, at + span, "left")
        last = np.where(following < len(at), following, here)
        while not np.array_equal(further := last[last], last):
            last = further
        entries = min(len(at), int(np.searchsorted(at, int(rows["since"].iloc[0]) + span, "left")) + 1)
        ends = at[last[:entries]] + span
        kept = np.append(ends[1:] != ends[:-1], True)
        return pd.DataFrame({"user_id": [key[0]], "block": [key[1]], "entry": [at[:entries][kept].tolist()], "end": [ends[kept].tolist()]})

    return step


def _chain(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The earliest time at which a window may open, per block that the chain enters."""
    rows = rows.sort_values("block")
    least, found = int(rows["least"].iloc[0]), []
    for block, entry, end in zip(rows["block"], rows["entry"], rows["end"]):
        at = int(np.searchsorted(entry, least, "left"))
        if at < len(entry):
            found.append((key[0], block, least))
            least = int(end[at])
    return pd.DataFrame(found, columns=["user_id", "block", "least"])


def _starts(span: int):
    def step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at, least = np.sort(rows["at"].to_numpy(np.int64)), int(rows["least"].iloc[0])
        starts = []
        while (n := int(np.searchsorted(at, least, "left"))) < len(at):
            starts.append(int(at[n]))
            least = starts[-1] + span
        return pd.DataFrame({"user_id": key[0], "start": np.array(starts, np.int64)})

    return step


def blocks(hits: DataFrame, span: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Distinct times ``user_id, at`` with their block and the moment it begins; users above ``group_rows`` get as many blocks as
    a block has windows, so that neither blocks nor the lists between them grow with the whole user."""
    times = hits.select("user_id", "at").distinct()
    sizes = times.groupBy("user_id").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high")).where(F.col("n") > group_rows)
    windows = F.floor((F.col("high") - F.col("low")) / span) + 1
    hot = sizes.select("user_id", "low", (F.ceil(F.sqrt(windows)) * span).cast("long").alias("length"))
    number = F.expr("(at - low) div length")
    return lookup_join(times, hot, "user_id").select(
        "user_id", "at", F.coalesce(number, F.lit(-1)).alias("block"), (F.col("low") + number * F.col("length")).alias("since"))


def window_starts(hits: DataFrame, opened: DataFrame, span: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``user_id, start`` of every window that the hits ``user_id, at`` open after the windows ``user_id, opened`` still open."""
    times = blocks(hits, span, group_rows)
    free = opened.select("user_id", (F.col("opened") + span).alias("least"))
    never = F.lit(-(2**62))
    lists = times.where("block >= 0").groupBy("user_id", "block").applyInPandas(
        _exits(span), "user_id long, block long, entry array<long>, end array<long>")
    hot = lists.join(free, "user_id", "left").withColumn("least", F.coalesce("least", never)).groupBy("user_id").applyInPandas(
        _chain, "user_id long, block long, least long")
    small = times.where("block < 0").select("user_id", "block").distinct().join(free, "user_id", "left").withColumn("least", F.coalesce("least", never))
    entered = times.join(hot.unionByName(small), ["user_id", "block"])
    return entered.groupBy("user_id", "block").applyInPandas(_starts(span), "user_id long, start long")


def numbered(hits: DataFrame, starts: DataFrame, opened: DataFrame, span: int) -> DataFrame:
    """Hits ``event_id, user_id, at, copies`` with their window and their number in it, by time and id."""
    every = starts.unionByName(opened.select("user_id", F.col("opened").alias("start")))
    slot = F.floor(F.col("start") / span)
    near = every.select("user_id", "start", F.explode(F.array(slot, slot + 1)).alias("slot")).groupBy("user_id", "slot").agg(F.collect_list("start").alias("starts"))
    placed = hits.withColumn("slot", F.floor(F.col("at") / span)).join(near, ["user_id", "slot"]).withColumn(
        "start", F.expr("array_max(filter(starts, x -> x <= at))"))
    placed = placed.withColumn("slice", F.floor((F.col("at") - F.col("start")) * SLICES / span)).drop("slot", "starts")
    keys = ["user_id", "start", "slice"]
    earlier = Window.partitionBy("user_id", "start").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(keys).agg(F.sum("copies").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    known = opened.select("user_id", F.col("opened").alias("start"), F.col("n").alias("known"))
    sums = sums.join(known, ["user_id", "start"], "left").select(*keys, (F.col("before") + F.coalesce("known", F.lit(0))).alias("before"))
    within = F.sum("copies").over(Window.partitionBy(keys).orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    counted = placed.withColumn("within", within).join(sums, keys)
    last = F.col("before") + F.col("within")
    return counted.withColumn("hit", F.explode(F.sequence(last - F.col("copies") + 1, last)))


def run_rate_limit(events: DataFrame, limit: int = 5, seconds: int = 21_600, late: str = LATE, group_rows: int = GROUP_ROWS,
                   path: str | None = None) -> DataFrame:
    """``live.rate_limit`` run to completion, for users of any size; the same rows.

    A micro-batch writes the hits it released, the windows they open, the answers and the windows still open, each to
    a folder of its number, so a batch that is run again replaces its own results and reads those of the batch before. What
    cannot be split is one window length of one user's distinct times.
    """
    spark, span = events.sparkSession, seconds * 1_000_000
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    base = path or f"{checkpoint_dir(spark)}/streams/limits-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str, number: int) -> DataFrame:
        folder, schema = f"{base}/{name}/batch={number}", df.schema
        df.write.mode("overwrite").parquet(folder)
        return spark.read.schema(schema).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        # A stream's own session runs without adaptive execution; what is written is read by the caller's.
        opened = spark.read.schema(_OPEN).parquet(f"{base}/open/batch={number - 1}") if number else spark.createDataFrame([], _OPEN)
        hits = stored(batch.select("event_id", "user_id", F.unix_micros("ts").alias("at"), "copies"), "hits", number)
        if hits.isEmpty():
            stored(opened, "open", number)
            return
        starts = stored(window_starts(
            hits.join(opened, "user_id", "left").where(F.col("opened").isNull() | (F.col("at") >= F.col("opened") + span)).select("user_id", "at"),
            opened, span, group_rows), "starts", number)
        answers = stored(numbered(hits, starts, opened, span).select(
            "event_id", "user_id", F.timestamp_micros("at").alias("ts"), F.timestamp_micros("start").alias("window_start"),
            "hit", (F.col("hit") <= limit).alias("allowed")), "answers", number)
        mine = answers.groupBy("user_id").agg(F.max(F.struct(F.unix_micros("window_start").alias("opened"), F.col("hit").alias("n"))).alias("w"))
        kept = mine.select("user_id", "w").unionByName(opened.select("user_id", F.struct("opened", "n").alias("w")))
        passed = hits.agg(F.max("at")).scalar()  # later batches release later hits only
        still = kept.groupBy("user_id").agg(F.max("w").alias("w")).select("user_id", "w.opened", "w.n")
        stored(still.where(F.col("opened") + span > passed), "open", number)

    spark.createDataFrame([], HITS).write.mode("ignore").parquet(f"{base}/answers/batch=-1")
    query = released(events, late).writeStream.foreachBatch(write).outputMode("append").option(
        "checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(HITS).parquet(f"{base}/answers").select("event_id", "user_id", "ts", "window_start", "hit", "allowed")
