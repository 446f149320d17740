"""Runs a registered query and its SQL side by side, like the correctness gate."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v) if v != int(v) or abs(v) > 1e15 else repr(float(v))
    if hasattr(v, "item") and not isinstance(v, (list, dict)):
        return plain(v.item())
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        v = v.replace(tzinfo=None)
    return str(v)


def kind(v):
    return type(plain(v)).__name__ if v is None else type(v).__name__


def compare(spark, con, query, sql, folder):
    """Return ``None`` if equal, else a message."""
    df = query(spark, folder)
    got_names = sorted(df.columns)
    got = sorted(
        (tuple(plain(r[c]) for c in got_names) for r in df.collect()), key=lambda t: tuple("" if x is None else x for x in t)
    )
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    if sorted(names) != got_names:
        return f"columns {got_names} vs {sorted(names)}"
    want = sorted(
        (tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=lambda t: tuple("" if x is None else x for x in t)
    )
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}\n  got  {got[:3]}\n  want {want[:3]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ ({got_names})\n  got  {bad[0][0]}\n  want {bad[0][1]}"
    if not got:
        return "empty result"
    return None


def plan_warnings(df) -> list[str]:
    """Plan nodes that do not scale: cross products, and windows or sorts in one partition."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    found = [word for word in ("CartesianProduct", "BroadcastNestedLoopJoin") if word in plan]
    lines = plan.splitlines()
    for above, below in zip(lines, lines[1:]):
        if "SinglePartition" in below and ("Sort [" in above or "Window [" in above):
            found.append("one-partition " + above.strip(" :+-*()0123456789")[:60])
    return found
