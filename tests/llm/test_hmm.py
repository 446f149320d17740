import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from plumbline.llm import common, hmm

WS = " \t\n\x0b\x0c\r"


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for c in WS:
        t = t.replace(c, " ")
    return [x for x in t.split(" ") if x] + ["\n"]


def brute(rows):
    held = {n: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for n, (i, _) in enumerate(rows)}
    c = Counter(w for n, (_, t) in enumerate(rows) if not held[n] for w in words(t))
    total, kinds = sum(c.values()), len(c)
    out = []
    for n, (i, t) in enumerate(rows):
        w = words(t)
        out.append((i, held[n], len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w)))
    return out


def sample(n=150):
    r = random.Random(6)
    kinds = [[f"{a}{b}{e}" for a in "bdkt" for b in "aeiou" for e in ends] for ends in (("tion", "ment"), ("keit", "ung"), ("ción", "dad"))]
    rows = [(i, " ".join(r.choices(kinds[i % 3], k=r.randrange(1, 120)))) for i in range(n)]
    return rows + [(900, None), (901, ""), (902, "Unseen WORD 1 2 3"), (None, "x y"), (903, "ba " * 8000), (3, rows[3][1])]


def test_counts_and_base_match_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, chunk int, held string").repartition(4)
    got = [tuple(r) for r in hmm.score(docs, frequent=20).collect()]
    key = lambda r: (str(r[0]), r[2], r[5])
    want = sorted(brute(rows), key=key)
    assert [r[:5] for r in sorted(got, key=key)] == [w[:5] for w in want]
    assert np.allclose([r[5] for r in sorted(got, key=key)], [w[5] for w in want], rtol=1e-12)
    held = [r for r in got if r[1]]
    assert held and all(math.isfinite(r[6]) for r in got)
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_forward_is_the_sum_over_all_paths():
    r = np.random.default_rng(3)
    k, s = 3, 4
    model = hmm.Model(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.dirichlet(np.ones(s), k).T)
    seqs = [r.integers(0, s, n) for n in (1, 4, 2, 5, 4)]
    sizes = np.array([len(x) for x in seqs])

    def paths(x):
        for p in itertools.product(range(k), repeat=len(x)):
            v = model.start[p[0]] * model.emit[x[0], p[0]]
            for t in range(1, len(x)):
                v *= model.move[p[t - 1], p[t]] * model.emit[x[t], p[t]]
            yield p, v

    want = [math.log(sum(v for _, v in paths(x))) for x in seqs]
    assert np.allclose(model.forward(np.concatenate(seqs), sizes), want)
    starts, moves, emits, like = model.expected(np.concatenate(seqs), sizes)
    a, b, c = np.zeros(k), np.zeros((k, k)), np.zeros((s, k))
    for x in seqs:
        total = sum(v for _, v in paths(x))
        for p, v in paths(x):
            a[p[0]] += v / total
            for t, j in enumerate(p):
                c[x[t], j] += v / total
                if t:
                    b[p[t - 1], j] += v / total
    assert np.allclose(starts, a) and np.allclose(moves, b) and np.allclose(emits, c) and np.isclose(like, sum(want))


def test_training_raises_the_likelihood():
    r = np.random.default_rng(5)
    seqs = [r.integers(0, 5, 40) + 5 * (n % 2) for n in range(30)]
    sizes, flat = np.full(30, 40), np.concatenate(seqs)
    prior = np.full(10, 0.1)
    model, likes = hmm.first_model(prior, 2), []
    for _ in range(8):
        starts, moves, emits, like = model.expected(flat, sizes)
        likes.append(like)
        model = hmm.next_model(starts, moves, emits, prior)
    assert all(b > a - 1 for a, b in zip(likes, likes[1:])) and likes[-1] > likes[0] + 100


def test_no_training_document_and_empty_table(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs = spark.createDataFrame([(held, "a b")], "doc_id long, text string")
    (row,) = hmm.score(docs).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and abs(row.score) < 1e-9
    assert hmm.score(docs.limit(0)).count() == 0


@pytest.mark.parametrize("frequent", [20, 2000])
def test_an_unseen_word_never_outscores_one_seen_once(spark, frequent):
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 7 == 2]
    once = [w + e for w in ("mar", "pol", "sund") for e in ("tion", "keit", "dad")]
    rows = [(i, t) for i, t in sample() if i is not None and i < 900]
    train = next(i for i in range(900, 2000) if i not in held)
    rows.append((train, " ".join(once)))
    ids = [i for i in held if i >= 900]
    pairs = [(w, "qx" + w[-4:]) for w in once]
    tests = [f"ba {w}" for pair in pairs for w in pair] + [" ".join(once), " ".join("qx" + w for w in once)]
    docs = spark.createDataFrame(rows + list(zip(ids, tests)), "doc_id long, text string")
    got = {r.doc_id: r for r in hmm.score(docs, frequent=frequent).collect()}
    score = [got[i].score for i in ids[: len(tests)]]
    assert all(got[i].held_out for i in ids[: len(tests)])
    assert all(a > b for a, b in zip(score[::2], score[1::2]))


def test_probabilities_with_unseen_words_sum_to_one():
    size = hmm.BANDS * hmm.ENDINGS
    plain = np.zeros(size)
    plain[hmm.ENDINGS : hmm.ENDINGS + 3] = 5, 1, 9
    alphabet = hmm.Alphabet(np.array([7], np.uint64), np.array([30]), 2 * plain, plain, 16)
    emit = np.random.default_rng(4).dirichlet(np.ones(alphabet.size), 2).T
    model = hmm.with_unseen(hmm.Model(np.ones(2) / 2, np.ones((2, 2)) / 2, emit), alphabet)
    assert np.allclose(model.emit.sum(axis=0), 1)
    ends = np.array([0, 1, 2, 3], np.uint8)
    symbol, share = alphabet.look_up(np.arange(100, 104, dtype=np.uint64), ends, np.zeros(4, np.int64))
    unseen = model.emit[symbol] * 10 ** share[:, None]
    symbol, share = alphabet.look_up(np.arange(100, 103, dtype=np.uint64), ends[:3], np.ones(3, np.int64))
    once = model.emit[symbol] * 10 ** share[:, None]
    assert (unseen[:3] < once).all() and (unseen > 0).all() and (unseen[3] <= once.min(axis=0)).all()


def test_a_task_with_many_chunks_writes_and_reads_back_few_at_a_time(spark):
    def big(batches):
        for batch in batches:
            for n in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([np.random.default_rng(n).bytes(2 << 20)])], names=["id", "body"])

    kept = common.stored(spark.range(0, 40, 1, 1).mapInArrow(big, "id long, body binary"))
    (path,) = kept.inputFiles()
    meta = pq.ParquetFile(path.removeprefix("file://")).metadata
    assert meta.num_rows == 40
    assert max(meta.row_group(g).total_byte_size for g in range(meta.num_row_groups)) <= 24 << 20
    assert kept.selectExpr("sum(id)", "sum(length(body))").first() == (780, 40 * (2 << 20))


def test_shards_follow_the_words_not_only_the_shuffle_partitions(spark, monkeypatch):
    rows = [r for r in sample() if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    asked, dealt = hmm._asked, []

    def noted(state, shards):
        dealt.append([r[0] for r in asked(state, shards).selectExpr("shard", "length(words) div 8 n").groupBy("shard").sum("n").select("sum(n)").collect()])
        return asked(state, shards)

    monkeypatch.setattr(hmm, "_asked", noted)
    want = sorted(map(tuple, hmm.score(docs, frequent=20).collect()), key=str)
    monkeypatch.setattr(common, "SHARD_KEYS", 5)
    got = sorted(map(tuple, hmm.score(docs, frequent=20).collect()), key=str)
    assert sum(dealt[0]) == sum(dealt[1]) and max(dealt[1]) < max(dealt[0]) / 2
    assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
