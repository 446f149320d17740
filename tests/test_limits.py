import datetime as dt

import numpy as np
import pytest

from plumbline.streaming import limits

EPOCH = dt.datetime(2024, 1, 1)
SPAN = 1800


def by_hand(hits, limit, end):
    """Windows hit by hit, in order of time and id; only hits up to ``end`` are answered."""
    found, opened = [], {}
    for t, e, u in sorted(hits):
        start, n = opened.get(u, (None, 0))
        if start is None or t >= start + SPAN:
            start, n = t, 0
        opened[u] = (start, n + 1)
        if t <= end:
            found.append((e, u, t, start, n + 1, n + 1 <= limit))
    return sorted(found)


@pytest.mark.parametrize("group_rows", [0, 40])
def test_hot_users_in_blocks_give_the_same_windows(spark, tmp_path, group_rows):
    rng = np.random.default_rng(11)
    times = np.sort(np.concatenate([rng.choice(60_000, 300), rng.integers(9_000, 11_000, 60), np.arange(0, 60_000, SPAN)[:20]]))
    # One user with most hits, ties in time, hits exactly one window apart, and a user that is heard once.
    hits = [(int(t), n, 7 if n % 3 else int(rng.integers(0, 4))) for n, t in enumerate(times)] + [(5, 9_999, 99)]
    hits += [hits[10]] * 2  # repeated rows count each
    hits = sorted(hits)
    for n in range(3):
        part = hits[n * len(hits) // 3 : (n + 1) * len(hits) // 3]
        rows = [(e, EPOCH + dt.timedelta(seconds=t), u) for t, e, u in part]
        if n == 1:
            rows += [(1, None, 7), (2, EPOCH, None)]
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = limits.run_rate_limit(stream, 3, SPAN, "1 hour", group_rows)
    seconds = lambda x: int((x - EPOCH).total_seconds())
    got = sorted((r.event_id, r.user_id, seconds(r.ts), seconds(r.window_start), r.hit, r.allowed) for r in out.collect())
    assert got == by_hand(hits, 3, hits[-1][0] - 3600)


def test_blocks_split_the_hot_user_only(spark):
    hits = spark.range(4000).selectExpr("CASE WHEN id % 4 = 0 THEN id ELSE -1L END AS user_id", "id * 1000 AS at")
    sizes = {(r.user_id, r.block): r.n for r in limits.blocks(hits, 10_000, 100).groupBy("user_id", "block").count().withColumnRenamed("count", "n").collect()}
    hot = [n for (u, _), n in sizes.items() if u == -1]
    assert len(hot) >= 19 and max(hot) <= 3000 // 15 and all(b == -1 for u, b in sizes if u != -1)
    lists = limits.blocks(hits, 10_000, 100).where("block >= 0").groupBy("user_id", "block").applyInPandas(
        limits._exits(10_000), "user_id long, block long, entry array<long>, end array<long>").collect()
    assert max(len(r.entry) for r in lists) <= 12


def test_a_stream_without_final_hits_gives_no_rows(spark, tmp_path):
    spark.createDataFrame([(1, EPOCH, 1)], "event_id long, ts timestamp, user_id long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long").parquet(f"{tmp_path}/in")
    assert limits.run_rate_limit(stream, 3, SPAN).collect() == []
