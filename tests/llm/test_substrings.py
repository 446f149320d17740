import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import common, substrings

WS = " \t\n\x0b\x0c\r"


def words(t):
    for c in WS:
        t = (t or "").replace(c, " ")
    return [x for x in t.split(" ") if x]


def brute(rows, window=35):
    docs = [words(t) for _, t in rows]
    seen = Counter(tuple(d[i : i + window]) for d in docs for i in range(len(d) - window + 1))
    out = []
    for (i, _), d in zip(rows, docs):
        gone = set()
        for s in range(len(d) - window + 1):
            if seen[tuple(d[s : s + window])] > 1:
                gone.update(range(s, s + window))
        kept = " ".join(w for n, w in enumerate(d) if n not in gone)
        out.append((str(i), len(d), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def sample(seed=1):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(60)]
    parts = [r.choices(vocab, k=r.randrange(30, 70)) for _ in range(8)]
    rows = []
    for i in range(70):
        body = []
        for _ in range(r.randrange(1, 6)):
            body += r.choices(vocab, k=r.randrange(0, 40))
            part = list(r.choice(parts))
            if r.random() < 0.4:
                part[r.randrange(len(part))] = "edit"
            body += part
        rows.append((i, " \n".join(body)))
    rows += [(200, "a " * 34), (201, "a " * 50), (202, "b c " * 40), (203, None), (204, ""), (205, " \t"), (None, rows[0][1]), (0, rows[0][1])]
    rows += [(300, " ".join(f"u{i}" for i in range(500))), (301, " ".join(f"u{i}" for i in range(466, 700))), (302, " ".join(f"u{i}" for i in range(600, 634)))]
    return rows


@pytest.mark.parametrize("chunk_bytes", [6_000_000, 3000])
def test_matches_brute_force(spark, chunk_bytes):
    rows = sample()
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, chunk int, body string").repartition(3)
    got = substrings.dedupe(docs, chunk_bytes=chunk_bytes, texts=True).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute(rows)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert substrings.dedupe(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kinds", [2, 5, 400])
def test_equal_windows_have_equal_anchors(kinds):
    r = np.random.default_rng(kinds)
    names = r.integers(0, 1 << 62, kinds).astype(np.uint64)
    core = names[r.integers(0, kinds, 60)]
    texts = [np.concatenate([names[r.integers(0, kinds, r.integers(0, 30))], core, names[r.integers(0, kinds, r.integers(0, 30))]]) for _ in range(30)]
    found = {}
    for t in texts:
        level, number, levels = substrings.anchors(t)
        for i in range(len(level)):
            found.setdefault(t[i : i + 35].tobytes(), set()).add(int(levels[level[i]][number[i]]))
    assert all(len(v) == 1 for v in found.values())
    if kinds == 400:
        level, _, _ = substrings.anchors(np.concatenate(texts))
        assert level.mean() > 3
