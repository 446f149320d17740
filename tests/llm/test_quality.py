import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import quality

SF = "/root/testdata/sf0.01"


def test_trees_match_a_plain_walk():
    r = np.random.default_rng(0)
    x = r.normal(size=(600, quality.N_FEATURES))
    y = ((x[:, 3] > 0.2) ^ (x[:, 5] > 0)).astype(float)
    model = quality.fit(x, y, trees=40)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95

    def walk(row):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        return total

    assert np.allclose([walk(row) for row in x[:50]], model.raw(x[:50]))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rated = quality.classify(docs, labels)
    assert rated.count() == docs.count()
    held = rated.where("held_out").join(labels, "doc_id").select(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert held[1] > 50 and held[0] > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, "fine text here. " * 40, "q"), (2, "!!!! $$$", "q"), (3, None, None), (None, "", ""), (5, "word " * 30_000, "q"), (5, "again", "q")],
        "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 0), (9, 1, 0), (None, 1, 0)], "doc_id long, quality int, held_out int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert len({quality.features(b"").tobytes()}) == 1
