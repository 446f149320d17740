import hashlib
import random

import pytest

from plumbline.llm import suffixes


def brute(rows, length=50):
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w not in first or order(i) < first[w]:
                first[w] = order(i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < order(i):
                gone[s : s + length] = [True] * length
        spans = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def sample(seed=1):
    r = random.Random(seed)
    parts = ["".join(r.choices("abcdé ", k=r.randrange(40, 140))) for _ in range(8)]
    rows = []
    for i in range(70):
        body = ""
        for _ in range(r.randrange(1, 6)):
            part = r.choice(parts)
            if r.random() < 0.5:
                cut = r.randrange(len(part))
                part = part[:cut] + r.choice(["X", "", "YZ"]) + part[cut + 1 :]
            body += "".join(r.choices("abcdef", k=r.randrange(0, 60))) + part
        rows.append((r.randrange(1000), body))
    rows += [(2000, "a" * 49), (2001, "a" * 50), (2002, "a" * 200), (2003, "ab" * 90), (2004, "ab" * 30 + "c" + "ab" * 40), (2005, None), (2006, "")]
    rows += [(None, rows[3][1]), (None, "q" * 70), (None, "q" * 70), (rows[5][0], rows[5][1] + rows[6][1]), (3000, "z" * 120), (2999, "z" * 60)]
    return rows


@pytest.mark.parametrize("chunk_bytes", [6_000_000, 2000])
def test_matches_brute_force(spark, chunk_bytes):
    rows = sample()
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, chunk int, body string").repartition(3)
    got = suffixes.dedupe(docs, chunk_bytes=chunk_bytes, texts=True).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    assert suffixes.dedupe(docs.limit(0)).count() == 0


def test_another_length(spark):
    rows = sample(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.dedupe(docs, length=31, chunk_bytes=5000).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, 31)
