import random

import numpy as np

from plumbline.llm import lines

WS = " \t\n\x0b\x0c\r"


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = low(line.strip(WS))
            if len(k) >= 10:
                holders.setdefault(k, set()).add(i)
    out = []
    for i, t in rows:
        body = (t or "").split("\n")
        kept = [x for x in body if not (len(h := holders.get(low(x.strip(WS)), ())) > 1 and min(h) != i)]
        out.append((i, len(body), len(body) - len(kept), "\n".join(kept)))
    return sorted(out)


def sample(n=80, first=0):
    r = random.Random(first + 1)
    pool = [f"Shared passage number {i} ÄÖ" for i in range(12)] + ["short", "", "  "]
    rows = []
    for i in range(n):
        body = [r.choice([p, " " + p.upper() + "\t"]) if r.random() < 0.5 else f"own line {first + i} {j}" for j, p in enumerate(r.choices(pool, k=r.randrange(1, 8)))]
        rows.append((first + i, "\n".join(body)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, k1 string, owner string")


def got(df):
    return sorted((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in df.collect())


def test_bulk_matches_brute_force(spark):
    rows = sample() + [(500, None), (501, ""), (502, "Shared passage number 1 ÄÖ\n" * 3000), (503, "a\n\n")]
    docs = frame(spark, rows)
    done = lines.dedupe(lines.build(docs), docs)
    assert done.columns == ["doc_id", "text", "k1", "owner", "n_lines", "n_dropped"]
    assert got(done) == brute(rows)


def test_insert_then_delete_is_reversible(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 40)
    one, two = sample(50), sample(40, 1000)
    index = lines.build(frame(spark, one))
    more = lines.insert(index, frame(spark, two))
    assert got(lines.dedupe(more, frame(spark, one + two))) == brute(one + two)
    back = lines.delete(more, spark.createDataFrame([(i,) for i, _ in two], "doc_id long"))
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, index.counts.collect()))
    assert got(lines.dedupe(back, frame(spark, one))) == brute(one)
    part = [r for r in one if r[0] % 3]
    gone = spark.createDataFrame([(i,) for i, _ in one if not i % 3], "doc_id long")
    assert got(lines.dedupe(lines.delete(index, gone), frame(spark, part))) == brute(part)


def test_null_ids_come_last_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a shared line\nx"), (4, "A SHARED LINE"), (None, "only nulls hold"), (None, "only nulls hold")], "doc_id long, text string")
    done = lines.dedupe(lines.build(docs), docs)
    assert sorted((str(r.doc_id), r.text) for r in done.collect()) == [("4", "A SHARED LINE"), ("None", "only nulls hold"), ("None", "only nulls hold"), ("None", "x")]
    none = docs.limit(0)
    assert lines.dedupe(lines.build(none), none).count() == 0


def test_cuckoo_filter_inserts_and_deletes():
    r = np.random.default_rng(1)
    keys = r.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    one = lines.Cuckoo(3000)
    one.insert(keys)
    one = lines.Cuckoo(blob=one.blob())
    assert one.holds(keys).all()
    other = r.integers(0, 1 << 63, 20000).astype(np.uint64)
    assert one.holds(other).mean() < 0.01
    one.remove(keys[:2000])
    assert one.holds(keys[2000:]).all() and one.holds(keys[:2000]).mean() < 0.01
    one.remove(keys[2000:])
    assert not one.cells.any() and not one.stash
