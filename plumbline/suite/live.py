"""Streams over the event table, run to completion.

Append mode emits a window once the watermark has passed it, so the SQL keeps
the windows that end before the last event minus the allowed lateness.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.operators import quality as Q
from plumbline.session import checkpoint_dir
from plumbline.streaming import limits, live, watch

_STAMP = "%Y-%m-%d %H:%M:%S"
CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def _time(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def t1(s, d):
    out = live.run(live.success_rate(live.read_events(s, d)), "success_rate")
    return out.select(_time("start"), "events", "success_pct")


T1 = f"""SELECT strftime(w, '{_STAMP}') AS start, count(*) AS events, round(100.0 * avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END), 2) AS success_pct
FROM (SELECT *, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS w FROM events) WHERE w + INTERVAL 24 HOUR <= {CLOSED} GROUP BY w"""


def t2(s, d):
    return live.run(live.live_counts(live.read_events(s, d)), "live_counts").select(_time("start"), "event_type", "events", "mean_value")


T2 = f"""SELECT strftime(date_trunc('hour', ts), '{_STAMP}') AS start, event_type, count(*) AS events, round(avg(value), 6) AS mean_value FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= {CLOSED} GROUP BY date_trunc('hour', ts), event_type"""


def t3(s, d):
    out = live.run(live.rate_limit(live.read_events(s, d)), "rate_limit")
    return out.select("event_id", "user_id", _time("window_start"), "hit", "allowed")


T3 = f"""
WITH RECURSIVE w AS (SELECT user_id, min(ts) AS start FROM events GROUP BY 1
 UNION ALL SELECT w.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = w.user_id AND e.ts >= w.start + INTERVAL 6 HOUR) FROM w
  WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = w.user_id AND e.ts >= w.start + INTERVAL 6 HOUR)),
 h AS (SELECT event_id, e.user_id, start, row_number() OVER (PARTITION BY e.user_id, start ORDER BY ts, event_id) AS hit FROM events e JOIN w
  ON w.user_id = e.user_id AND e.ts >= w.start AND e.ts < w.start + INTERVAL 6 HOUR)
SELECT event_id, user_id, strftime(start, '{_STAMP}') AS window_start, hit, hit <= 5 AS allowed FROM h JOIN events USING (event_id, user_id) WHERE ts <= {CLOSED}"""


# Every third event belongs to one user, whose time is cut into blocks.
HOT = "CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END"


def t3_hot(s, d):
    events = live.read_events(s, d).withColumn("user_id", F.expr(HOT))
    out = limits.run_rate_limit(events, group_rows=1000)
    return out.select("event_id", "user_id", _time("window_start"), "hit", "allowed")


T3_HOT = T3.replace("WITH RECURSIVE ", f"WITH RECURSIVE events AS (SELECT * REPLACE ({HOT} AS user_id) FROM main.events), ").replace(CLOSED, "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)")


def t3_tumbling(s, d):
    out = live.run(live.approximate_rate_limit(live.read_events(s, d), 2), "rate_limit_tumbling")
    return out.select("user_id", _time("start"), "hits", "rejected")


T3_TUMBLING = f"""SELECT user_id, strftime(w, '{_STAMP}') AS start, count(*) AS hits, greatest(count(*) - 2, 0) AS rejected
FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS w FROM events) WHERE w + INTERVAL 6 HOUR <= {CLOSED} GROUP BY user_id, w"""


def t4(s, d):
    events = live.read_events(s, d)
    repeated = events.withColumn("copy", F.explode(F.when(F.col("event_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("copy")
    return live.run(live.deduplicate(repeated), "deduplicate").select("event_id", "user_id", "event_type")


def t5(s, d):
    out = live.run(live.quiet_sessions(live.read_events(s, d)), "quiet_sessions")
    return out.select("user_id", _time("start"), _time("last_seen"), "events")


T5 = f"""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, strftime(min(ts), '{_STAMP}') AS start, strftime(max(ts), '{_STAMP}') AS last_seen, count(*) AS events FROM s GROUP BY user_id, n HAVING max(ts) + INTERVAL 6 HOUR <= {CLOSED}"""


def t5_alerts(s, d):
    out = live.run(live.silence_alerts(live.read_events(s, d)), "silence_alerts")
    return out.select("user_id", _time("last_seen"), "silent_for", "events")


T5_ALERTS = f"""
WITH e AS (SELECT user_id, ts, count(*) AS events FROM events GROUP BY user_id, ts),
 g AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS following FROM e)
SELECT user_id, strftime(ts, '{_STAMP}') AS last_seen, level AS silent_for, events FROM g, (VALUES (1), (2), (4)) AS v(level)
WHERE ts + level * INTERVAL 6 HOUR <= {CLOSED} AND (following IS NULL OR following > ts + level * INTERVAL 6 HOUR)"""


def t6(s, d):
    events = live.read_events(s, d).select(
        "event_id", "ts", F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 4 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("event_type"),
    )
    base = f"{checkpoint_dir(s)}/streams/quality-{uuid.uuid4().hex}"
    live.watch_quality(events, f"{base}/issues", f"{base}/state").awaitTermination()
    return s.read.parquet(f"{base}/issues").select("code", "severity", "rows")


T6 = """SELECT * FROM (SELECT 'missing::value' AS code, 'medium' AS severity, count(*) AS rows FROM events UNION ALL SELECT 'category::inconsistent::event_type', 'medium', count(*) FROM events)"""

# Events with planted defects, the same for both engines.
_DEFECTS = {
    "value": "CASE WHEN event_id % 6 <> 0 THEN value END", "event_type": "CASE WHEN event_id % 4 = 0 THEN upper(event_type) ELSE event_type END",
    "amount": "CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(event_id % 1000 AS VARCHAR(9)) END", "day": "CAST(CAST(ts AS DATE) AS VARCHAR(10))",
    "padded": "CASE WHEN event_id % 4 = 0 THEN concat(event_type, '  ') ELSE concat(event_type, '_') END",
}


def t6_running(s, d):
    """The events arrive in five files, one a batch; the issues after the last one are those of the whole table."""
    base = f"{checkpoint_dir(s)}/streams/profile-{uuid.uuid4().hex}"
    events = s.read.parquet(f"{d}/events.parquet").selectExpr("user_id % 5 AS file", *[f"CAST({e} AS STRING) AS {n}" if n in ("amount", "day") else f"{e} AS {n}" for n, e in _DEFECTS.items()])
    events.repartition("file").write.partitionBy("file").parquet(f"{base}/in")
    stream = s.readStream.schema(events.drop("file").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
    watch.watch(stream, f"{base}/out", f"{base}/state").awaitTermination()
    found = watch.latest(s, f"{base}/out", "issues", Q.ISSUE_SCHEMA)
    evidence = [F.col("evidence")[k] for k in ("missing", "numeric_like_pct", "date_like_pct", "raw_level_count")]
    return found.select("code", "severity", F.round(F.coalesce(*evidence, F.lit("0")).cast("double"), 2).alias("figure"))


_PLANTED = "(SELECT " + ", ".join(f"{e} AS {n}" for n, e in _DEFECTS.items()) + " FROM events)"
T6_RUNNING = f"""SELECT 'missing::value' AS code, CASE WHEN 100.0 * count_if(value IS NULL) / count(*) >= 40 THEN 'high' ELSE 'medium' END AS severity, count_if(value IS NULL)::DOUBLE AS figure FROM {_PLANTED}
UNION ALL SELECT 'dtype::numeric_string::amount', 'medium', round(100.0 * count_if(amount <> 'n/a') / count(*), 2) FROM {_PLANTED} HAVING avg((amount <> 'n/a')::INT) >= 0.9
UNION ALL SELECT 'dtype::date_string::day', 'low', 100.0 FROM {_PLANTED} WHERE regexp_full_match(day, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') HAVING count(*) > 0
UNION ALL SELECT 'category::inconsistent::event_type', 'medium', count(DISTINCT event_type)::DOUBLE FROM {_PLANTED} HAVING count(DISTINCT event_type) > count(DISTINCT lower(event_type))
UNION ALL SELECT 'category::whitespace::padded', 'low', 0.0 FROM {_PLANTED} WHERE padded <> trim(padded) HAVING count(*) > 0"""

QUERIES = {
    "T1_success_rate": (t1, T1), "T2_live_counts": (t2, T2), "T3_rate_limit": (t3, T3), "T3_rate_limit_hot_user": (t3_hot, T3_HOT),
    "T3_rate_limit_tumbling": (t3_tumbling, T3_TUMBLING),
    "T4_deduplicate": (t4, "SELECT event_id, user_id, event_type FROM events"), "T5_quiet_sessions": (t5, T5), "T5_silence_alerts": (t5_alerts, T5_ALERTS), "T6_watch_quality": (t6, T6),
    "T6_running_quality": (t6_running, T6_RUNNING),
}
