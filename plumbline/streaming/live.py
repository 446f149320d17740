"""Streaming forms of usage, health and quality checks over an event stream.

Every operator takes a streaming (or batch) frame ``event_id, ts, user_id,
event_type, value`` and returns a frame; ``run`` drives one to completion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators import profile as P, quality as Q
from plumbline.session import checkpoint_dir

LATE = "1 hour"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Files of one micro-batch, so that a long history is not read as one batch.
FILES_PER_BATCH = 64


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_batch: int | None = FILES_PER_BATCH) -> DataFrame:
    """Event files as a stream; the schema is taken from the files present."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def success_rate(events: DataFrame, length: str = "24 hours", step: str = "1 hour", late: str = LATE) -> DataFrame:
    """Success share per sliding window."""
    ok = (F.col("event_type") != "error").cast("int")
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w")).agg(
        F.count("*").alias("events"), F.round(100.0 * F.avg(ok), 2).alias("success_pct")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "success_pct")


def live_counts(events: DataFrame, length: str = "1 hour", late: str = LATE) -> DataFrame:
    """Events and mean value per type and tumbling window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(
        F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("mean_value")
    ).select(F.col("w.start").alias("start"), "event_type", "events", "mean_value")


def deduplicate(events: DataFrame, key: str = "event_id", late: str = LATE) -> DataFrame:
    """Each event once, with state kept only as long as a repeat may arrive."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def quiet_sessions(events: DataFrame, gap: str = "6 hours", late: str = LATE) -> DataFrame:
    """Activity sessions per user that ended: nothing was heard for the whole gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(
        F.count("*").alias("events"), F.max("ts").alias("last_seen")
    ).select("user_id", F.col("w.start").alias("start"), "last_seen", "events")


ALERTS = "user_id long, last_seen timestamp, silent_for int, events long"


class _Silence(StatefulProcessor):
    """Per user the times that an alert may still hang on, with the level that each waits for, and one timer for the earliest of them."""

    def __init__(self, gap_ms: int, levels: tuple[int, ...]):
        self.gap, self.levels = gap_ms, np.array(sorted(levels), np.int64)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "us binary, n binary, level binary, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        us, n, level, timer = self._held()
        heard = [part["ts"].to_numpy("datetime64[us]").astype(np.int64) for part in rows]
        times, place = np.unique(np.concatenate([us, *heard]), return_inverse=True)
        counts, reached = np.zeros(len(times), np.int64), np.zeros(len(times), np.int64)
        np.add.at(counts, place, np.concatenate([n, np.ones(len(place) - len(us), np.int64)]))
        reached[place[: len(us)]] = level
        self._keep(times, counts, reached, timer)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        us, n, level, _ = self._held()
        passed, found = timerValues.getCurrentWatermarkInMs(), []
        # Nothing that the watermark has passed can change: whatever is due by now is settled at once, not timer by timer.
        for at in range(len(self.levels)):
            due = np.flatnonzero((level == at) & (self._due(us, at) <= passed))
            silent = due[self._silent(us, due, at)]
            found.append((us[silent], np.full(len(silent), self.levels[at]), n[silent]))
            level[due] = len(self.levels)
            level[silent] = at + 1
        rest = self._due(us, -1) > passed
        self._keep(us[rest], n[rest], level[rest], None)
        times, levels, events = (np.concatenate(x) for x in zip(*found))
        if len(times):
            order = np.lexsort((levels, times))
            yield pd.DataFrame({"user_id": np.full(len(times), key[0], np.int64), "last_seen": times[order].astype("datetime64[us]"),
                                "silent_for": levels[order].astype(np.int32), "events": events[order]})

    def _due(self, us: np.ndarray, level) -> np.ndarray:
        """The first millisecond at which the watermark has passed the level's gaps after ``us``."""
        return -(-us // 1000) + self.levels[level] * self.gap

    def _silent(self, us: np.ndarray, which, level) -> np.ndarray:
        """Whether nothing was heard for the level's gaps after the times ``which``; ``us`` is ascending."""
        following = np.append(us[1:], np.iinfo(np.int64).max)[which]
        return following > us[which] + self.levels[level] * self.gap * 1000

    def _held(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, int | None]:
        if not self.times.exists():
            return *(np.empty(0, np.int64) for _ in range(3)), None
        *held, timer = self.times.get()
        return *(np.frombuffer(bytes(x), np.int64).copy() for x in held), None if timer < 0 else timer

    def _keep(self, us: np.ndarray, n: np.ndarray, level: np.ndarray, timer: int | None) -> None:
        """State, and the user's timer at the earliest time at which an alert may be due; without either if nothing is left."""
        open_ = np.flatnonzero(level < len(self.levels))
        open_ = open_[self._silent(us, open_, level[open_])]
        first = int(self._due(us[open_], level[open_]).min()) if len(open_) else None
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if len(us) and first is not None:
            self.times.update((us.tobytes(), n.tobytes(), level.tobytes(), first))
        elif self.times.exists():
            self.times.clear()

    def close(self) -> None:
        pass


def silence_alerts(events: DataFrame, gap_seconds: int = 21_600, levels: tuple[int, ...] = (1, 2, 4), late: str = LATE) -> DataFrame:
    """An alert while a user is silent: one gap, two gaps, four gaps after the last event, as soon as the watermark passes that time.

    Unlike ``quiet_sessions`` nothing waits for a session to close, and a silence that goes on is reported again. State is
    the times whose last level is still to come; it is dropped when that has passed. ``events`` counts events at the
    very time ``last_seen``. Needs the RocksDB state store.
    """
    heard = events.withWatermark("ts", late).select("user_id", "ts")
    return heard.groupBy("user_id").transformWithStateInPandas(_Silence(gap_seconds * 1000, tuple(levels)), ALERTS, "Append", "EventTime")


HITS = "event_id long, user_id long, ts timestamp, window_start timestamp, hit long, allowed boolean"
_HELD = "held_ts array<long>, held_id array<long>, opened long, count long"


def _limiter(limit: int, seconds: int):
    span = seconds * 1_000_000

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held_ts, held_id, opened, count = state.get if state.exists else ([], [], None, 0)
        ts, ids = [np.array(held_ts, np.int64)], [np.array(held_id, np.int64)]
        if not state.hasTimedOut:
            for rows in batches:
                ts.append(rows["ts"].to_numpy("datetime64[us]").astype(np.int64))
                ids.append(rows["event_id"].to_numpy(np.int64))
        ts, ids = np.concatenate(ts), np.concatenate(ids)
        order = np.lexsort((ids, ts))
        ts, ids = ts[order], ids[order]
        # Only what the watermark has passed is final; later hits may still arrive between the others.
        passed = state.getCurrentWatermarkMs() * 1000
        done = int(np.searchsorted(ts, passed, side="right"))
        starts, hits, at = np.empty(done, np.int64), np.empty(done, np.int64), 0
        while at < done:  # one turn per window, not per hit
            if opened is None or ts[at] >= opened + span:
                opened, count = int(ts[at]), 0
            end = min(done, int(np.searchsorted(ts, opened + span, side="left")))
            starts[at:end], hits[at:end] = opened, count + 1 + np.arange(end - at)
            count, at = count + end - at, end
        if len(ts) > done:
            state.update((ts[done:].tolist(), ids[done:].tolist(), opened, count))
            state.setTimeoutTimestamp(max(int(ts[done] // 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif opened is not None and opened + span > passed:
            state.update(([], [], opened, count))
            state.setTimeoutTimestamp((opened + span) // 1000 + 1)
        elif state.exists:
            state.remove()
        if done:
            out = pd.DataFrame({"event_id": ids[:done], "user_id": key[0], "ts": ts[:done].astype("datetime64[us]"),
                                "window_start": starts.astype("datetime64[us]"), "hit": hits})
            yield out.assign(allowed=out["hit"] <= limit)

    return step


def rate_limit(events: DataFrame, limit: int = 5, seconds: int = 21_600, late: str = LATE) -> DataFrame:
    """Fixed windows per user that open at the first hit; hits beyond the limit are not allowed.

    Hits are held until the watermark has passed them and are then numbered in event-time order, so the answer does not
    depend on how the stream was cut into batches. The state of a user is the held hits and the open window; it is dropped
    when the watermark passes the end of the window. One user's rows of one batch meet in one task, so the
    batch size (``files_per_batch``) and the allowed lateness bound its memory.
    """
    hits = events.withWatermark("ts", late).select("event_id", "user_id", "ts")
    return hits.groupBy("user_id").applyInPandasWithState(
        _limiter(limit, seconds), HITS, _HELD, "append", GroupStateTimeout.EventTimeTimeout
    )


def approximate_rate_limit(events: DataFrame, limit: int = 5, length: str = "6 hours", late: str = LATE) -> DataFrame:
    """The same with windows on fixed clock times: counts combine before the shuffle."""
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", length).alias("w")).agg(F.count("*").alias("hits")).select(
        "user_id", F.col("w.start").alias("start"), "hits", F.greatest(F.col("hits") - limit, F.lit(0)).alias("rejected")
    )


def batch_issues(batch: DataFrame) -> DataFrame:
    """Missing cells, text types and label variants of one micro-batch."""
    facts = P.column_facts(batch)
    return Q.missing_issues(facts).unionByName(Q.type_issues(facts)).unionByName(Q.label_issues(batch, facts))


def watch_quality(events: DataFrame, path: str, checkpoint: str):
    """Start a query that appends the issues of every micro-batch to a table.

    Each batch writes its own folder, so a batch that is run again replaces its result.
    """
    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        found = batch_issues(kept).withColumn("rows", F.lit(kept.count()))
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")
        kept.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run(stream: DataFrame, name: str, mode: str = "append", run_id: str | None = None) -> DataFrame:
    """Process what is there, write it to a table in the shared folder and read it back."""
    import uuid

    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    base = f"{checkpoint_dir(spark)}/streams/{name}-{run_id or uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
