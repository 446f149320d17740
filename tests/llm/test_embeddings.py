import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import common, embeddings

SF = "/root/testdata/sf0.01"


def brute(rows, cosine=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out, n = {i: [0, i] for i, _ in rows}, len(good)
    near = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            x, y = good[a][1], good[b][1]
            near[a, b] = len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine - 1e-12
    label = [i for i, _ in good]
    for _ in range(n):
        label = [min(label[b] for b in range(n) if near[a, b]) for a in range(n)]
    for a, (i, _) in enumerate(good):
        out[i] = [int(near[a].sum()) - 1, label[a]]
    return {i: (*v, v[1] == i) for i, v in out.items()}


def cloud(n=150, width=16):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, width))
    rows = []
    for i in range(n):
        v = centres[i % 12] + 0.15 * r.normal(size=width) if i % 3 else r.normal(size=width)
        rows.append((n - i, [float(x) for x in v.astype(np.float32)]))
    rows += [(500 + i, rows[4][1]) for i in range(30)]
    return rows + [(900, None), (901, []), (902, [0.0] * width), (903, [1.0, None] + [0.0] * (width - 2)), (904, [float("nan")] * width),
                   (905, [float("inf")] + [0.0] * (width - 1)), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e30 * x for x in rows[4][1]])]


@pytest.mark.parametrize("block", [2048, 20])
def test_small_table_matches_all_pairs(spark, block):
    rows = cloud()
    table = spark.createDataFrame([(i, v, 1, "p") for i, v in rows], "vec_id long, embedding array<double>, id int, pivots string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(table, block=block).collect()}
    assert got == brute(rows)


def test_recall_on_the_given_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = table.collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(table).collect()}
    have = np.array([got[r.vec_id] for r in rows])
    assert (have <= want).all() and have.sum() >= 0.95 * want.sum()


def test_null_ids_and_empty_table(spark):
    table = spark.createDataFrame([(None, [1.0, 0.0]), (7, [1.0, 0.1]), (7, [1.0, 0.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(str(tuple(r)) for r in embeddings.near_duplicates(table).collect())
    assert got == ["(7, 2, 7, True)", "(7, 2, 7, True)", "(None, 0, None, False)", "(None, 2, 7, False)"]
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_recall_inside_a_large_group_of_near_copies(spark):
    r = np.random.default_rng(9)
    centre = r.normal(size=64)
    x = np.concatenate([r.normal(size=(1500, 64)), centre + 0.2 * r.normal(size=(700, 64))])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    got = {row.vec_id: row.n_links for row in embeddings.near_duplicates(table).collect()}
    have = np.array([got[i] for i in range(len(x))])
    assert want.sum() > 50_000 and (have <= want).all() and have.sum() >= 0.97 * want.sum()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_blocks_of_more_than_2048_parts(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        dealt = common.in_blocks(spark.range(2100).select(F.lit(1).alias("key"), "id"), "key", "id", 1)
        low, high = F.shiftright(F.col("part").cast("long"), 31), F.col("part").cast("long").bitwiseAND((1 << 31) - 1)
        dealt = dealt.select("id", "own", low.alias("low"), high.alias("high"))
        wrong = "low < 0 OR low > high OR high >= 2100 OR own NOT IN (low, high)"
        got = dealt.agg(F.count(F.lit(1)), F.count_if(F.expr(wrong)), F.countDistinct(F.when(F.col("low") >= 2048, F.struct("low", "high")))).first()
        assert got[0] == 2100 * 2100 and got[1] == 0 and got[2] > 0
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
