"""Command-line form of the oracle check: ``python tests/check_queries.py [prefix ...]``."""

import os
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from plumbline.session import build_session  # noqa: E402

if __name__ == "__main__":
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(folder)
    sql = entry.oracle_sql()
    wanted = [a for a in sys.argv[1:] if not a.startswith("--")]
    fails = 0
    skipped = [a.removeprefix("--skip=") for a in sys.argv if a.startswith("--skip=")]
    for name, query in entry.queries().items():
        if any(name.startswith(k) for k in skipped):
            continue
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            if name in sql:
                message = oracle.compare(spark, con, query, sql[name], folder)
            else:
                n = query(spark, folder).count()
                message = None if n else "no rows"
        except Exception as exc:  # noqa: BLE001
            message = f"{type(exc).__name__}: {str(exc)[:700]}"
        if "--plans" in sys.argv and message is None:
            warned = oracle.plan_warnings(query(spark, folder))
            message = f"plan: {warned}" if warned else None
        fails += message is not None
        mark = "ok  " if message is None else "FAIL"
        print(f"{mark} {name:45s} {time.time() - t0:6.2f}s {'' if name in sql else '(rows only)'} {message or ''}", flush=True)
    print("failures:", fails)
