import random

import pytest

from plumbline.llm import decontaminate

WS = " \t\n\x0b\x0c\r"


def shingles(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for c in WS:
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, items):
    out = []
    for d, t in docs:
        for i, u in items:
            a, b = shingles(t), shingles(u)
            if b and 5 * len(a & b) >= 4 * len(b):
                out.append((str(d), str(i), len(a & b), len(b)))
    return sorted(out)


def sample():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ß"]
    items = [(i, " ".join(r.choices(vocab, k=r.randrange(1, 60)))) for i in range(40)]
    items += [(100, None), (101, ""), (102, " "), (103, items[7][1].upper()), (None, items[8][1])]
    docs = []
    for d in range(60):
        body = r.choices(vocab, k=r.randrange(0, 500))
        for _ in range(r.randrange(3)):
            part = (items[r.randrange(40)][1]).split()
            if r.random() < 0.5 and part:
                part[r.randrange(len(part))] = "changed"
            at = r.randrange(len(body) + 1)
            body[at:at] = part
        docs.append((d, "\n".join(body)))
    return docs + [(70, None), (71, ""), (72, items[3][1]), (None, items[9][1]), (73, "w1 " * 40_000 + items[5][1]), (0, docs[0][1])], items


@pytest.mark.parametrize("block_bytes", [8_000_000, 1000])
def test_all_containments_are_found(spark, block_bytes):
    docs, items = sample()
    d = spark.createDataFrame([(a, b, 1, 2) for a, b in docs], "doc_id long, text string, item int, item_id int")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contained(d, i, block_bytes=block_bytes).collect()
    assert sorted((str(r.doc_id), str(r.item_id), r.n_shared, r.n_shingles) for r in got) == brute(docs, items)
    left = decontaminate.clean(d, i, block_bytes=block_bytes)
    assert left.columns == d.columns
    bad = {(x[0]) for x in brute(docs, items)}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(a) for a, _ in docs if str(a) not in bad)


def test_empty_tables(spark):
    docs, items = sample()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contained(d.limit(0), i).count() == 0
    none = decontaminate.contained(d, i.limit(0))
    assert none.count() == 0 and none.columns == decontaminate.contained(d, i).columns
    assert decontaminate.clean(d, i.limit(0)).count() == len(docs)
