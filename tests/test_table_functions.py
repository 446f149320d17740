import datetime as dt

import pytest
from pyspark.errors import PySparkException

from plumbline.functions import tables
from plumbline.plans import guard, runner

NIGHT = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rows = [(u, v, NIGHT + dt.timedelta(seconds=t) if t is not None else None, float(t or 0)) for u, v, t in [
        (1, "a", 30), (1, "a", 0), (1, "a", 10), (1, "b", 5), (1, "a", 39), (None, "a", 3), (None, "a", 4), (2, "a", None), (1, "a", 10)]]
    return spark.createDataFrame(rows, "user_id long, kind string, ts timestamp, value double")


def test_sessions_split_at_gaps_per_key(spark, events):
    df = runner.statement(spark, "SELECT * FROM sessions(TABLE(SELECT user_id, kind, ts FROM events), 20)", {"events": events})
    assert df.columns == ["user_id", "kind", "first_seen", "last_seen", "events"]
    got = sorted(((r.user_id or 0, r.kind, (r.first_seen - NIGHT).seconds, (r.last_seen - NIGHT).seconds, r.events) for r in df.collect()))
    assert got == [(0, "a", 3, 4, 2), (1, "a", 0, 10, 3), (1, "a", 30, 39, 2), (1, "b", 5, 5, 1)]  # a gap of exactly 20 seconds splits
    assert runner.statement(spark, "SELECT * FROM sessions(TABLE(SELECT user_id, ts FROM events WHERE user_id > 9), 20)", {"events": events}).collect() == []


@pytest.mark.parametrize("call", ["TABLE(SELECT ts FROM events), 20", "TABLE(SELECT ts, user_id FROM events), 20", "TABLE(SELECT user_id, ts FROM events), 0"])
def test_wrong_arguments_are_refused_by_analysis(spark, events, call):
    with pytest.raises(PySparkException):
        runner.statement(spark, f"SELECT * FROM sessions({call})", {"events": events}).schema


def test_states_merge_to_the_figures_of_the_whole(spark, events):
    sql = """SELECT merge_moments(collect_list(state)) AS s FROM (SELECT moments_of(count(value), avg(value), var_pop(value)) AS state FROM events GROUP BY user_id, kind
             UNION ALL SELECT moments_of(0L, NULL, NULL) UNION ALL SELECT NULL)"""
    df = runner.statement(spark, f"SELECT s.n AS n, s.mean AS mean, moments_std(s) AS std FROM ({sql})", {"events": events})
    want = events.selectExpr("count(value) AS n", "avg(value) AS mean", "stddev_samp(value) AS std").first()
    got = df.first()
    assert got.n == want.n and abs(got.mean - want.mean) < 1e-9 and abs(got.std - want.std) < 1e-9
    empty = runner.statement(spark, "SELECT moments_std(merge_moments(array())) AS s", {}).first()
    assert empty.s is None


def test_the_guard_reads_table_arguments(spark):
    scope = lambda sql: guard.check_scope(spark, sql, {"events", "customer"}, {"events"})
    assert scope("SELECT * FROM sessions(TABLE(SELECT user_id, ts FROM events), 5)") is None
    assert scope("SELECT * FROM sessions(TABLE(SELECT c_name, c_at FROM customer), 5)") == "customer is outside the allowed scope"
    assert scope("SELECT * FROM sessions(TABLE(customer), 5)") == "customer is outside the allowed scope"
    assert scope("SELECT * FROM sessions(TABLE(SELECT user_id, ts FROM secrets), gap => 5)") == "secrets is unknown"
    for other in ("range(5)", "explode(array(1))", "read_files('/etc')"):
        assert "is not supported" in scope(f"SELECT * FROM {other}")
    assert scope("SELECT * FROM x.sessions(TABLE(events), 5)") == "the query could not be parsed"
    policy = guard.Policy({"supplier"}, {"customer.c_acctbal"}, {"customer.c_name"})
    check = lambda sql: guard.check_policy(spark, sql, policy)
    assert check("SELECT * FROM sessions(TABLE(SELECT c_nationkey, c_at FROM customer), 5)") is None
    assert "must be aggregated" in check("SELECT n FROM sessions(TABLE(SELECT c_name, c_at FROM customer), 5)")
    assert "is restricted" in check("SELECT 1 FROM sessions(TABLE(SELECT c_at FROM customer) PARTITION BY (c_acctbal), 5)")
    assert "would expose" in check("SELECT events FROM sessions(TABLE(customer), 5)")
    assert "is hidden" in check("SELECT * FROM sessions(TABLE(SELECT a, b FROM supplier), 5)")
    assert tables.TABLE_FUNCTIONS.keys() == {"sessions"}
