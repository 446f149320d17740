import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import neighbours as N
from plumbline.suite.tables import dirty_customer


def brute(queries, donors, k):
    """All pairs, with the distance over shared coordinates."""
    found = {}
    for key, row in queries:
        near = []
        for donor, other in donors:
            shared = [(a - b) ** 2 for a, b in zip(row, other) if not (np.isnan(a) or np.isnan(b))]
            if shared:
                near.append((np.sqrt(sum(shared) * len(row) / len(shared)), donor))
        found[key] = sorted(near)[:k]
    return found


def points(seed, n, width, missing, levels=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * np.array([1, 5, 20, 3][:width])
    if levels:
        x = np.round(x / levels) * levels
    x[rng.random(x.shape) < missing] = np.nan
    return [(i, x[i]) for i in range(n)]


@pytest.mark.parametrize("missing, levels, width", [(0.0, None, 3), (0.3, None, 4), (0.2, 4, 2), (0.95, 2, 3)])
def test_equals_brute_force(spark, monkeypatch, missing, levels, width):
    monkeypatch.setattr(N, "CELL_ROWS", 12)
    monkeypatch.setattr(N, "DONOR_BLOCK", 9)
    monkeypatch.setattr(N, "QUERY_BLOCK", 7)
    names = [f"f{j}" for j in range(width)]
    queries, donors = points(1, 60, width, missing, levels), points(2, 300, width, missing, levels)
    frame = lambda rows, key: spark.createDataFrame(pd.DataFrame([[i, *x] for i, x in rows], columns=[key, *names]))
    counted = {}
    out = N.nearest(frame(queries, "query_key"), frame(donors, "donor_key").withColumn("payload", F.col("donor_key") * 1.0), names, 4, counted=counted)
    got = {}
    for r in out.orderBy("query_key", "rank").collect():
        got.setdefault(r.query_key, []).append((r.distance, r.donor_key))
        assert r.payload == r.donor_key
    for key, near in brute(queries, donors, 4).items():
        held = got.get(key, [])
        assert [d for _, d in held] == [d for _, d in near] and np.allclose([x for x, _ in held], [x for x, _ in near])
    if missing == 0:
        assert counted["pairs"] < 0.5 * len(queries) * len(donors)


def test_bounds_hold_for_every_donor():
    rng = np.random.default_rng(5)
    for _ in range(200):
        rows, donors = rng.normal(size=(5, 3)), rng.normal(size=(6, 3)) * 2
        rows[rng.random(rows.shape) < 0.3] = np.nan
        donors[rng.random(donors.shape) < 0.4] = np.nan
        known = ~np.isnan(donors)
        low, high = (np.nan_to_num(f(np.where(known, donors, fill), axis=0), posinf=0, neginf=0) for f, fill in ((np.min, np.inf), (np.max, -np.inf)))
        bounds = N.lower_bounds(rows, low[None], high[None], known.all(axis=0)[None], known.any(axis=0)[None])[:, 0]
        real = N._distances(rows, donors)
        real[np.isnan(real)] = np.inf
        assert (bounds * (1 - 1e-9) <= real.min(axis=1)).all()


def test_equal_points_and_empty_sides(spark):
    rows = spark.range(500).selectExpr("id AS donor_key", "1.0D AS f0", "CAST(NULL AS DOUBLE) AS f1", "CAST(id AS DOUBLE) AS payload")
    asked = spark.createDataFrame([(7, 1.0, 2.0), (8, None, 3.0)], "query_key long, f0 double, f1 double")
    got = N.nearest(asked, rows, ["f0", "f1"], 3).orderBy("rank").collect()
    assert [(r.query_key, r.donor_key, r.distance) for r in got] == [(7, 0, 0.0), (7, 1, 0.0), (7, 2, 0.0)]
    assert N.nearest(asked, rows.limit(0), ["f0", "f1"], 3).count() == 0
    assert N.nearest(asked.limit(0), rows, ["f0", "f1"], 3).count() == 0


def test_few_pairs_are_compared(spark):
    df = dirty_customer(spark, "/root/testdata/sf0.1", "balance", "few_gaps", "churn_score", key=True)
    gap = F.col("balance").isNull()
    names, counted = ["balance", "few_gaps", "churn_score"], {}
    queries = df.where(gap).select(F.col("c_custkey").alias("query_key"), *names)
    donors = df.where(~gap).select(F.col("c_custkey").alias("donor_key"), *names, F.col("balance").alias("payload"))
    assert N.nearest(queries, donors, names, 5, counted=counted).count() == 5 * queries.count()
    assert counted["pairs"] < 0.1 * queries.count() * donors.count()
