import random

import numpy as np
import tokenizers

import corpus_pipeline
from plumbline.llm import packing, quality
from tests.llm.test_decontaminate import brute as contained
from tests.llm.test_lines import brute as line_brute
from tests.llm.test_packing import check


def make(spark, folder):
    r = random.Random(9)
    vocab = ["the", "of", "and", "house", "river", "été", "grün", "walks", "Slowly,", "night."] + [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(160):
        if i % 4 == 3:
            text = " ".join(r.choice(vocab).upper() + "!!$$" for _ in range(r.randrange(20, 80)))
        else:
            text = "\n".join(" ".join(r.choices(vocab, k=12)) + "." for _ in range(r.randrange(1, 12))) + "\nread more about it here\n"
        rows.append([i, text, "en", "s", len(text)])
        labels.append((i, int(i % 4 != 3), 0))
    items = [(i, " ".join(r.choices(vocab, k=25))) for i in range(4)]
    for i in range(8, 160, 16):
        rows[i][1] = rows[i - 8][1]
    for i in range(6, 160, 20):
        rows[i][1] += items[i % 4][1]
    rows += [[200, None, None, None, None], [201, "", "en", "s", 0], [202, "x " * 20_000, "en", "s", 40_000]]
    spark.createDataFrame([tuple(x) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items


def test_stages_match_brute_force(spark, tmp_path):
    rows, items = make(spark, str(tmp_path))
    model = quality.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    docs = [(i, t) for i, t, *_ in rows if model.score(quality.features((t or "").encode())[None])[0] >= 0.5]
    assert {i for i, _ in docs} >= {i for i in range(160) if i % 4 != 3} and not any(i % 4 == 3 for i, _ in docs if i < 160)
    docs = [(i, t) for i, _, _, t in line_brute(docs)]
    docs = _near(docs)
    bad = {d for d, *_ in contained(docs, items)}
    docs = [(i, t) for i, t in docs if str(i) not in bad]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check(got, tokenizers.Tokenizer.from_file(packing.default_tokenizer()), docs)
    assert bad


def _near(docs):
    from tests.llm.test_simhash import plain_fingerprint

    fps = np.array([plain_fingerprint(t) for _, t in docs], np.uint64)
    label = np.arange(len(docs))
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    for _ in docs:
        label = np.where(close, label[None, :], len(docs)).min(axis=1)
    return [d for n, d in enumerate(docs) if label[n] == n]


def test_stages_keep_the_columns_and_empty_tables(spark, tmp_path):
    make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    odd = docs.selectExpr("*", "1 AS fp", "2 AS nth", "'x' AS owner", "3 AS row", "4 AS n_lines").limit(20)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, str(tmp_path)).columns == odd.columns, name
        stage(spark, odd, str(tmp_path)).count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
