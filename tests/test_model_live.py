import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import model as M
from plumbline.sources import writers
from plumbline.streaming import live


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(0)
    x1, x2 = rng.normal(size=300), rng.normal(size=300)
    return spark.createDataFrame(pd.DataFrame({"k": range(300), "x1": x1, "x2": x2, "cat": rng.choice(["a", "b", "c"], 300), "target": (x1 + 0.5 * x2 > 0).astype(int)}))


def test_classification_end_to_end(spark, classes, tmp_path):
    out = M.train_and_compare(classes, "target", "k", models=["Logistic Regression", "Decision Tree"], cross_validation=False)
    best = max(r["accuracy"] for r in out.comparison)
    assert out.task == "classification" and best > 0.8 and out.train.count() + out.test.count() == 300
    assert out.importance.orderBy(F.desc("importance")).first()["feature"] == "x1"
    scored = M.predict(out, classes.drop("cat"))
    rows = scored.limit(20).collect()
    assert all(abs(sum(r["probabilities"].values()) - 1) < 1e-3 and r["prediction"] in ("0", "1") for r in rows)
    writers.export_model(out, str(tmp_path / "model"))
    model, about = writers.load_model(spark, str(tmp_path / "model"))
    assert about["target"] == "target" and model.transform(M.prepare(classes, "target", "k")[0]).count() == 300


def test_regression_beats_the_mean(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": range(300), "x1": rng.normal(size=300), "x2": rng.normal(size=300)})
    pdf["target"] = 3 * pdf.x1 - 2 * pdf.x2 + rng.normal(scale=0.3, size=300)
    out = M.train_and_compare(spark.createDataFrame(pdf), "target", "k", models=["Linear Regression", "Ridge", "Lasso"], cross_validation=False)
    scores = {r["model"]: r["r2"] for r in out.comparison}
    assert scores["Linear Regression"] > 0.9 and out.best_model in ("Linear Regression", "Ridge")


def test_knn_votes_equal_brute_force(spark, classes):
    out = M.train_and_compare(classes, "target", "k", models=["K-Nearest Neighbors"], drop=["cat"], cross_validation=False, permutations=1)
    weights = {r["feature"]: r["importance"] for r in out.importance.collect()}
    assert weights["x1"] > weights["x2"]
    scored = M.predict(out, out.test.drop("_label", "_index")).collect()
    assert len(scored) == out.test.count() and all(abs(sum(r["probabilities"].values()) - 1) < 1e-6 for r in scored)
    train, test = out.train.toPandas(), out.test.toPandas()
    mean, std = train[["x1", "x2"]].mean(), train[["x1", "x2"]].std(ddof=0)
    a, b = ((t[["x1", "x2"]] - mean) / std for t in (train, test))
    hits = 0
    for i in range(len(test)):
        near = np.argsort(((a.to_numpy() - b.to_numpy()[i]) ** 2).sum(axis=1))[:5]
        hits += str(int(train["_label"].iloc[near].astype(int).mean() > 0.5)) == test["_label"].iloc[i]
    assert np.isclose(out.comparison[0]["accuracy"], hits / len(test))


def test_few_rows_are_refused(spark):
    with pytest.raises(ValueError):
        M.train_and_compare(spark.range(10).selectExpr("id AS k", "id * 1.0 AS x", "id % 2 AS target"), "target", "k")


def _write_events(spark, folder, hits):
    base = dt.datetime(2024, 1, 1)
    for i, part in enumerate(hits):
        rows = [(e, base + dt.timedelta(seconds=t), u, "click", 1.0) for e, t, u in part]
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{folder}/{i}")


def test_rate_limit_keeps_state_across_batches(spark, tmp_path):
    rng = np.random.default_rng(4)
    times = np.sort(rng.choice(20_000, 240, replace=False))
    hits = [(i, int(t), int(rng.integers(0, 3))) for i, t in enumerate(times)]
    _write_events(spark, tmp_path, [hits[:80], hits[80:160], hits[160:]])
    schema = spark.read.parquet(str(tmp_path / "0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/*")
    got = {r["event_id"]: (r["hit"], r["allowed"]) for r in live.run(live.rate_limit(stream, 4, 1800, "2 hours"), "limit-test").collect()}
    want, opened = {}, {}
    for e, t, u in hits:
        start, n = opened.get(u, (None, 0))
        if start is None or t >= start + 1800:
            start, n = t, 0
        opened[u] = (start, n + 1)
        if t <= hits[-1][1] - 7200:  # later hits wait for the watermark
            want[e] = (n + 1, n + 1 <= 4)
    assert got == want


def test_duplicates_across_batches_are_dropped(spark, tmp_path):
    _write_events(spark, tmp_path, [[(1, 0, 1), (2, 10, 1)], [(2, 10, 1), (3, 20, 1)]])
    schema = spark.read.parquet(str(tmp_path / "0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*")
    assert sorted(r["event_id"] for r in live.run(live.deduplicate(stream), "dedup-test").collect()) == [1, 2, 3]


def test_rate_limit_does_not_depend_on_batches(spark, tmp_path):
    import random

    r = random.Random(8)
    rows = sorted((r.randrange(200_000) + r.random(), i, r.randrange(3)) for i in range(600))
    base = "timestamp'2024-01-01 00:00:00'"
    frame = lambda part: spark.createDataFrame(part, "s double, event_id long, user_id long").selectExpr(
        "event_id", f"{base} + make_interval(0,0,0,0,0,0,s) AS ts", "user_id", "'click' AS event_type", "1.0D AS value")
    late = sorted(rows, key=lambda x: x[0] + r.random() * 3000)
    for n in range(10):
        (tmp_path / "many").mkdir(exist_ok=True)
        frame(late[60 * n : 60 * n + 60]).coalesce(1).write.parquet(str(tmp_path / f"part{n}"))
        part = next((tmp_path / f"part{n}").glob("*.parquet"))
        target = tmp_path / "many" / f"{n:02d}-events.parquet"
        target.write_bytes(part.read_bytes())
        import os
        os.utime(target, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = live.read_events(spark, str(tmp_path / "many"), "*events.parquet", files_per_batch=1)
    got = {x.event_id: (x.window_start.timestamp(), x.hit, x.allowed) for x in live.run(live.rate_limit(stream), "limit").collect()}
    end, want, opened = rows[-1][0] - 3600, {}, {}
    for s, i, user in rows:
        start, n = opened.get(user, (None, 0))
        if start is None or s >= start + 21_600:
            start, n = s, 0
        opened[user] = (start, n + 1)
        if s <= end:
            want[i] = (n + 1, n + 1 <= 5)
    assert {i: v[1:] for i, v in got.items()} == want


def test_votes_do_not_depend_on_repeated_keys(spark):
    from pyspark.ml.feature import VectorAssembler

    make = VectorAssembler(inputCols=["x"], outputCol="features").transform
    train = make(spark.createDataFrame([(i, float(i), float(i % 2)) for i in range(20)], "_key long, x double, _index double"))
    once = make(spark.createDataFrame([(7, 3.2)], "_key long, x double"))
    twice = make(spark.createDataFrame([(7, 3.2), (7, 3.2), (7, 11.0)], "_key long, x double"))
    alone = M.knn_predict(train, once, classes=2).first()
    rows = M.knn_predict(train, twice, classes=2).collect()
    assert len(rows) == 3 and [r["scores"] for r in rows if r["x"] == 3.2] == [alone["scores"]] * 2


def test_folds_learn_their_own_preprocessing_and_score_the_metric(spark, classes):
    out = M.train_and_compare(classes, "target", "k", models=["Logistic Regression", "K-Nearest Neighbors"], primary_metric="roc_auc", permutations=0)
    rows = {r["model"]: r for r in out.comparison}
    assert all(0.5 < r["cv_mean"] <= 1 for r in rows.values())
    assert abs(rows["Logistic Regression"]["cv_mean"] - rows["Logistic Regression"]["roc_auc"]) < 0.2


def test_silence_alerts_do_not_depend_on_batches(spark, tmp_path):
    """Shuffled within the allowed lateness, one file a trigger: same alerts as from the whole table."""
    rng = np.random.default_rng(3)
    seconds = np.sort(rng.integers(0, 6 * 86_400, 120))
    pdf = pd.DataFrame({"event_id": range(120), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(seconds, unit="s"), "user_id": rng.integers(0, 6, 120),
                        "event_type": "x", "value": 1.0})
    pdf.loc[len(pdf)] = [999, pd.Timestamp("2024-01-09"), 99, "x", 1.0]
    closed, gap = pdf.ts.max() - pd.Timedelta(hours=1), pd.Timedelta(hours=6)
    wanted = []
    for user, times in pdf.groupby("user_id").ts:
        times = sorted(times)
        for t, following in zip(times, [*times[1:], pd.Timestamp("2100-01-01")]):
            wanted += [(user, t, level) for level in (1, 2, 4) if t + level * gap <= closed and following > t + level * gap]
    part = ((seconds.tolist() + [8 * 86_400]) + rng.uniform(0, 3000, 121)) // 86_400
    for n in sorted(set(part)):
        spark.createDataFrame(pdf[part == n]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{int(n):02d}.parquet"))
    schema = spark.read.parquet(str(tmp_path / "in" / "*")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = live.run(live.silence_alerts(stream), "alerts")
    assert sorted((r.user_id, pd.Timestamp(r.last_seen), r.silent_for) for r in out.collect()) == sorted(wanted)


def test_permuted_deals_every_column_anew_in_one_shuffle(spark):
    df = spark.range(101).selectExpr("id AS _key", "CAST(id AS STRING) AS a", "IF(id % 5 = 0, NULL, id * 1.5) AS b", "id AS y")
    out = M.permuted(df, ["a", "b"], 3).collect()
    rows = df.collect()
    groups = {}
    for r in out:
        groups.setdefault((r._feature, r._repeat), []).append((r._key, r.a, r.b, r.y))
    assert len(groups) == 7 and sorted(groups[None, 0]) == sorted(tuple(r) for r in rows)
    for (feature, repeat), got in groups.items():
        assert sorted((r[0], r[3]) for r in got) == [(r._key, r.y) for r in rows]
        assert sorted((r[1] for r in got)) == sorted(r.a for r in rows) and sorted((r[2] for r in got), key=str) == sorted((r.b for r in rows), key=str)
        if feature:
            a, b = M.steps(101, "ab".index(feature), repeat)
            held = {r[0]: r for r in got}
            other, own = (2, 1) if feature == "a" else (1, 2)
            assert all(held[(a * i + b) % 101][own] == rows[i][own] and held[i][other] == rows[i][other] for i in range(101))
    plan = M.permuted(df, ["a", "b"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # numbering, then the one that deals
    for n in (1, 2, 1_000_003, 999):
        a, b = M.steps(n, 3, 1)
        assert len({(a * i + b) % n for i in range(min(n, 5000))}) == min(n, 5000)
    assert M.permuted(df.limit(0), ["a"], 2).count() == 0


def test_a_user_is_woken_once_a_batch_however_many_silences_are_due():
    """One timer per user: 2,000 silences of one user were as many timers, each of which read and wrote all of its state."""
    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

    class Handle:
        timers = set()

        def getValueState(self, *_):  # noqa: N802
            return Value()

        def registerTimer(self, at):  # noqa: N802
            self.timers.add(at)

        def deleteTimer(self, at):  # noqa: N802
            self.timers.remove(at)

    class Clock:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

    one, handle, hour = live._Silence(3_600_000, (1, 2)), Handle(), 3600
    one.init(handle)
    times = pd.to_datetime(np.arange(2000) * 3 * hour + 1, unit="s")
    list(one.handleInputRows((7,), iter([pd.DataFrame({"ts": times})]), Clock(0)))
    assert handle.timers == {3_601_000}
    woken, rows = 0, 0
    now = Clock(2000 * 3 * hour * 1000)
    while handle.timers and min(handle.timers) <= now.ms:
        at = handle.timers.pop()
        rows += sum(len(x) for x in one.handleExpiredTimer((7,), now, None))
        woken += 1
    assert woken == 1 and rows == 4000 and not handle.timers and not one.times.exists()


def test_candidates_share_their_preprocessing_and_parts_of_bounded_size(spark, monkeypatch):
    """Each candidate learnt medians and scales of the same rows again, and a persisted part was as large as its file."""
    df = spark.range(4000).selectExpr("id AS key", "CAST(id % 97 AS DOUBLE) AS a", "CAST(id % 13 AS DOUBLE) AS b", "3 * (id % 97) + id % 13 + id % 7 / 10.0D AS y").coalesce(1)
    calls, real = [], M.preprocessing
    monkeypatch.setattr(M, "preprocessing", lambda *a: calls.append(1) or real(*a))
    wanted = M.train_and_compare(df, "y", "key", models=["Linear Regression", "Ridge"], cross_validation=False)
    assert len(calls) == 1 and wanted.train.rdd.getNumPartitions() == 1
    monkeypatch.setattr(M, "PART_ROWS", 200)
    found = M.train_and_compare(df, "y", "key", models=["Linear Regression", "Ridge"], cross_validation=False)
    sizes = found.train.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.max() <= 200 and sizes.sum() == wanted.train.count()
    for a, b in zip(wanted.comparison, found.comparison):
        assert a["model"] == b["model"] and a["r2"] == pytest.approx(b["r2"]) and a["rmse"] == pytest.approx(b["rmse"])


def test_training_on_a_number_counts_only_what_is_asked(spark, monkeypatch):
    """The key was profiled like a feature, and a number's values were all counted as text for a share that only classes have."""
    df = spark.range(400).selectExpr("id AS key", "CAST(id % 97 AS DOUBLE) AS a", "id AS unread", "3 * (id % 97) + id % 7 / 10.0D AS y")
    seen, real = [], M.P.column_facts
    monkeypatch.setattr(M.P, "column_facts", lambda df: seen.append(df.columns) or real(df))
    out = M.train_and_compare(df, "y", "key", models=["Linear Regression"], cross_validation=False, drop=["unread"])
    assert seen == [["a", "y"]] and out.task == "regression" and out.features.names == ["a"]
    assert not out.train.storageLevel.useDisk and out.test.storageLevel.useDisk and out.train.count() + out.test.count() == 400
    plan = M.detect_task(df, "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "range" not in plan.lower()
    row = M.detect_task(df.selectExpr("key % 10 = 0 AS y"), "y").first()
    assert row["task"] == "classification" and row["is_imbalanced"] and row["primary_metric"] == "f1"
