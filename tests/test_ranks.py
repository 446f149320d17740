import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import ranks
from plumbline.functions.ranks import grouped_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def _frame(spark):
    rng = np.random.default_rng(3)
    wide = pd.DataFrame({"g": "wide", "x": rng.lognormal(0, 4, 6000)})
    hot = pd.DataFrame({"g": "hot", "x": np.r_[np.full(3000, 7.5), rng.integers(0, 40, 4000)].astype(float)})
    tiny = pd.DataFrame({"g": "tiny", "x": [3.0, 1.0]})
    one = pd.DataFrame({"g": "one", "x": [5.0] * 2000})
    pdf = pd.concat([wide, hot, tiny, one])
    return pdf, spark.createDataFrame(pdf)


def test_linear_quantiles_equal_pandas_on_both_paths(spark):
    pdf, df = _frame(spark)
    want = pdf.groupby("g")["x"].quantile(PROBS)
    for bound in (1_000_000, 50):
        rows = grouped_quantiles(df, ["g"], F.col("x"), PROBS, group_rows=bound).collect()
        assert len(rows) == 4 * len(PROBS)
        for r in rows:
            assert np.isclose(r["value"], want[(r["g"], r["p"])], rtol=1e-12), (bound, r)


def test_nearest_rank_equals_sorted_list(spark):
    pdf, df = _frame(spark)
    for bound in (1_000_000, 50):
        rows = grouped_quantiles(df, ["g"], F.col("x"), [0.5, 0.95], nearest=True, group_rows=bound).collect()
        for r in rows:
            values = sorted(pdf[pdf.g == r["g"]]["x"])
            assert r["value"] == values[round((len(values) - 1) * r["p"])], (bound, r)


def test_a_round_counts_without_sorting_its_rows(spark, monkeypatch):
    """The counting pass sorted every row with a copy of all cut points: 1.2 GB in one task over nine million rows."""
    plans = []
    real = ranks.cut_lineage
    monkeypatch.setattr(ranks, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    df = spark.range(20_000).selectExpr("id % 3 AS key", "CAST(id * 7919 % 20011 AS DOUBLE) AS v")
    got = ranks.grouped_quantiles(df, ["key"], F.col("v"), [0.25, 0.5, 0.9], group_rows=500)
    counting = [p for p in plans if "tally" in p]
    assert counting and not any("SortAggregate" in p for p in counting)
    want = df.groupBy("key").agg(*[F.percentile("v", p).alias(str(p)) for p in (0.25, 0.5, 0.9)]).collect()
    assert {(r.key, p): r[str(p)] for r in want for p in (0.25, 0.5, 0.9)} == pytest.approx({(r.key, r.p): r.value for r in got.collect()})


def test_large_groups_are_counted_in_cells_not_sketched(spark, monkeypatch):
    """One task merged the sketches of all partitions of a group: 14.7 s of 104.7 s over 12 million rows, and growing with them."""
    plans = []
    real = ranks.cut_lineage
    monkeypatch.setattr(ranks, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    df = spark.range(30_000).selectExpr("id % 2 AS key", "CAST(id * 7919 % 30011 AS DOUBLE) AS v", "CAST(id % 7 AS DOUBLE) AS few")
    got = {(r.key, r.p): r.value for r in ranks.grouped_quantiles(df, ["key"], F.col("v"), [0.2, 0.5], group_rows=500).collect()}
    want = df.groupBy("key").agg(*[F.percentile("v", p).alias(str(p)) for p in (0.2, 0.5)]).collect()
    assert got == pytest.approx({(r.key, p): r[str(p)] for r in want for p in (0.2, 0.5)})
    assert plans and not any("percentile_approx" in p for p in plans)
    # A column of few values is settled by its cells: its rows are never gathered, however many they are.
    plans.clear()
    found = ranks.grouped_quantiles(df, ["key"], F.col("few"), [0.5], group_rows=500)
    assert {r.value for r in found.collect()} == {3.0} and "collect_list(v" not in found._jdf.queryExecution().executedPlan().toString()


def test_ranks_are_exact_where_cells_part_nothing(spark):
    """Infinities, values that lie close together beside ones far off, and more rounds than one group had names for."""
    rng = np.random.default_rng(5)
    far = np.r_[rng.random(3000) * 1e-9, rng.lognormal(0, 60, 3000), [1e300, -1e300, 1.7e308, -1.7e308]]
    ends = np.r_[np.full(900, np.inf), np.full(900, -np.inf), rng.random(1000)]
    pdf = pd.concat([pd.DataFrame({"g": "far", "x": far}), pd.DataFrame({"g": "ends", "x": ends}), pd.DataFrame({"g": "all", "x": [np.inf] * 100})])
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    for bound in (2, 40):
        rows = grouped_quantiles(spark.createDataFrame(pdf), ["g"], F.col("x"), probabilities, nearest=True, group_rows=bound).collect()
        assert len(rows) == 3 * len(probabilities)
        for r in rows:
            values = sorted(pdf[pdf.g == r["g"]]["x"])
            assert r["value"] == values[round((len(values) - 1) * r["p"])], (bound, r)
