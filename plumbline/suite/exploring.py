"""Exploration over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import explore as E, profile as P
from plumbline.suite.profiling import _top_sql, histogram_sql, numeric_sql
from plumbline.suite.tables import GAPPY_SQL, dirty_customer, dirty_sql, gappy_lines, table, union_all

NUM = ["quantity", "price", "discount", "tax", "one"]


def numeric_summary(spark, d):
    return E.numeric_summary(table(spark, d, "orders"), ["o_totalprice", "o_custkey"])


def categorical_summary(spark, d):
    return E.categorical_summary(table(spark, d, "part"), ["p_brand", "p_type", "p_name"])


def _summary_sql(src, c, k=12):
    return (
        f"SELECT *, (SELECT count({c}) FROM ({src})) AS count, (SELECT count(DISTINCT {c}) FROM ({src})) AS \"unique\" "
        f"FROM ({_top_sql(src, c, k, c)})"
    )


def correlations(spark, d):
    return E.correlations(gappy_lines(spark, d), NUM)


def _pairs_sql(digits=4):
    return union_all(
        f"SELECT '{a}' AS a, '{b}' AS b, " + ("any_value(NULL::DOUBLE)" if "one" in (a, b) else f"round(corr({a}, {b}), {digits})") + f" AS corr FROM ({GAPPY_SQL})"
        for i, a in enumerate(NUM) for b in NUM[i + 1:]
    )


def top_pairs(spark, d):
    return E.top_pairs(E.correlations(gappy_lines(spark, d), NUM), 3).select("a", "b", "corr")


def heatmap(spark, d):
    return E.heatmap(E.correlations(gappy_lines(spark, d), NUM), NUM)


HEAT_SQL = f"""
WITH p AS ({_pairs_sql()})
SELECT a AS row, b AS "column", corr FROM p UNION ALL SELECT b, a, corr FROM p
UNION ALL {union_all(f"SELECT '{c}', '{c}', 1.0::DOUBLE" for c in NUM)}"""


def histogram_chart(spark, d):
    return E.histogram_chart(table(spark, d, "orders"), ["o_totalprice"]).drop("label")


def box_stats(spark, d):
    return E.box_stats(dirty_customer(spark, d, "spend", "balance", "few_gaps"), ["spend", "balance", "few_gaps"])


BOX_SQL = union_all(
    f"""SELECT '{c}' AS "column", round(min({c})::DOUBLE, 6) AS min, round(max({c})::DOUBLE, 6) AS max, round(any_value(a), 6) AS q1,
 round(any_value(m), 6) AS median, round(any_value(b), 6) AS q3, round((min({c}) FILTER ({c} >= a - 1.5 * (b - a)))::DOUBLE, 6) AS whisker_low,
 round((max({c}) FILTER ({c} <= b + 1.5 * (b - a)))::DOUBLE, 6) AS whisker_high,
 count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outlier_count
FROM ({dirty_sql(c)}), (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.5) AS m, quantile_cont({c}, 0.75) AS b FROM ({dirty_sql(c)}))"""
    for c in ("spend", "balance", "few_gaps")
)


def sample_outliers(spark, d):
    return E.sample_outliers(dirty_customer(spark, d, "spend", key=True), ["spend"], "c_custkey")


SAMPLE_SQL = f"""
WITH t AS ({dirty_sql('spend', key=True)}), q AS (SELECT quantile_cont(spend, 0.25) AS a, quantile_cont(spend, 0.75) AS b FROM t)
SELECT 'spend' AS "column", rank, round(spend, 6) AS value FROM (SELECT spend, row_number() OVER (ORDER BY c_custkey)::INTEGER AS rank
 FROM t, q WHERE spend < a - 1.5 * (b - a) OR spend > b + 1.5 * (b - a)) WHERE rank <= 20"""


def bar_chart(spark, d):
    return E.bar_chart(dirty_customer(spark, d, "segment", "vip", "plan"), ["segment", "vip", "plan"])


def _bar_sql(names, value):
    return union_all(f"SELECT \"column\", rank, value AS label, n AS {value} FROM ({_top_sql(dirty_sql(c), c, 12, c)})" for c in names)


def pie_chart(spark, d):
    return E.pie_chart(dirty_customer(spark, d, "segment", "vip", "plan"), ["segment", "vip", "plan"])


def scatter(spark, d):
    return E.scatter(gappy_lines(spark, d), "quantity", "price", ["l_orderkey", "l_linenumber", "quantity", "price"])


SCATTER_SQL = f"""SELECT round(quantity, 6) AS x, round(price, 6) AS y FROM ({GAPPY_SQL}) WHERE quantity IS NOT NULL AND price IS NOT NULL
ORDER BY l_orderkey, l_linenumber, quantity, price LIMIT 2000"""


def monthly_mean(spark, d):
    return E.monthly_mean(table(spark, d, "orders"), "o_orderdate", "o_totalprice")


MONTH_SQL = "SELECT strftime(o_orderdate, '%Y-%m') AS month, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1"


def _skewed(spark, d):
    return dirty_customer(spark, d, "spend", "balance", "churn_score", "channel", "vip", "flag")


def skew_findings(spark, d):
    out = E.skew_findings(E.numeric_summary(_skewed(spark, d), ["spend", "balance"]))
    return out.select("category", "subject", F.col("evidence")["skew"].cast("double").alias("skew"))


SKEW_SQL = union_all(
    f"SELECT 'statistical' AS category, '{c}' AS subject, round(skewness({c}), 6) AS skew FROM ({dirty_sql(c)}) HAVING abs(skewness({c})) >= 1 AND count({c}) > 10"
    for c in ("spend", "balance")
)


def dominance_findings(spark, d):
    out = E.dominance_findings(E.categorical_summary(_skewed(spark, d), ["channel", "vip"]))
    return out.select("category", "subject", F.col("evidence")["value"].alias("value"), F.col("evidence")["pct"].cast("double").alias("pct"))


DOMINANCE_SQL = union_all(
    f"SELECT 'data_quality' AS category, \"column\" AS subject, value, pct FROM ({_top_sql(dirty_sql(c), c, 1, c)}) WHERE pct >= 80"
    for c in ("channel", "vip")
)


def correlation_findings(spark, d):
    pairs = E.top_pairs(E.correlations(_skewed(spark, d), ["spend", "balance", "churn_score"]))
    return E.correlation_findings(pairs).select("category", "subject", F.col("evidence")["corr"].cast("double").alias("corr"))


_S = dirty_sql("spend", "balance", "churn_score")
CORR_SQL = "SELECT 'statistical' AS category, a || ',' || b AS subject, corr FROM (" + union_all(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS corr FROM ({_S})"
    for a, b in (("spend", "balance"), ("spend", "churn_score"), ("balance", "churn_score"))
) + ") WHERE abs(corr) >= 0.6 ORDER BY abs(corr) DESC, a, b LIMIT 3"


def imbalance_findings(spark, d):
    out = E.imbalance_findings(table(spark, d, "labels"), "toxic")
    return out.select("category", "subject", F.col("evidence")["minority_pct"].cast("double").alias("minority_pct"))


IMBALANCE_SQL = """SELECT 'ml' AS category, 'toxic' AS subject, round(p, 2) AS minority_pct
FROM (SELECT 100.0 * min(n) / sum(n) AS p FROM (SELECT count(*) AS n FROM labels GROUP BY toxic)) WHERE p < 20"""


def group_gaps(spark, d):
    df = dirty_customer(spark, d, "spend", "vip", "balance").withColumn(
        "weight", F.when(F.col("vip") == "Yes", F.col("spend") * 2).otherwise(F.col("spend"))
    )
    return E.group_gaps(df, "vip", ["spend", "weight", "balance"])


GAP_SQL = "SELECT * FROM (" + union_all(
    f"""SELECT '{c}' AS "column", arg_min(vip, m) AS low_class, round(min(m), 4) AS low_mean, arg_max(vip, m) AS high_class, round(max(m), 4) AS high_mean
FROM (SELECT vip, avg({c}) AS m FROM (SELECT *, CASE WHEN vip = 'Yes' THEN spend * 2 ELSE spend END AS weight FROM ({dirty_sql('spend', 'vip', 'balance')})) GROUP BY vip)
HAVING count(*) = 2 AND min(m) <> 0 AND abs(max(m) - min(m)) / (abs(min(m)) + 1e-9) > 0.25"""
    for c in ("spend", "weight", "balance")
) + ")"


def findings(spark, d):
    df = _skewed(spark, d)
    return E.findings(df, P.column_facts(df), "vip").select("category", "subject")


# The parts above over the columns of ``_skewed``, by subject only.
FINDINGS_SQL = f"""
SELECT category, subject FROM ({union_all(
    f"SELECT 'statistical' AS category, '{c}' AS subject FROM ({dirty_sql(c)}) HAVING abs(skewness({c})) >= 1" for c in ("spend", "balance", "churn_score"))})
UNION ALL SELECT category, subject FROM ({union_all(
    f"SELECT 'data_quality' AS category, '{c}' AS subject FROM ({_top_sql(dirty_sql(c), c, 1, c + '::VARCHAR')}) WHERE pct >= 80" for c in ("channel", "vip", "flag"))})
UNION ALL SELECT category, subject FROM ({CORR_SQL})
UNION ALL SELECT 'ml', 'vip' FROM (SELECT min(n) / sum(n) AS p FROM (SELECT count(*) AS n FROM ({dirty_sql('vip')}) GROUP BY vip)) WHERE p < 0.2
UNION ALL SELECT 'business', c FROM ({union_all(
    f"SELECT '{c}' AS c FROM (SELECT avg({c}) AS m FROM ({dirty_sql('vip', c)}) GROUP BY vip) HAVING min(m) <> 0 AND abs(max(m) - min(m)) / (abs(min(m)) + 1e-9) > 0.25"
    for c in ("spend", "balance", "churn_score"))})"""


def neutral_finding(spark, d):
    df = table(spark, d, "customer").select("c_acctbal", "c_mktsegment")
    return E.findings(df, P.column_facts(df)).select("category", "text")


QUERIES = {
    "E1_numeric_summary": (numeric_summary, numeric_sql("SELECT * FROM orders", ["o_totalprice", "o_custkey"])),
    "E2_categorical_summary": (categorical_summary, union_all(_summary_sql("SELECT * FROM part", c) for c in ("p_brand", "p_type", "p_name"))),
    "E3_correlations": (correlations, _pairs_sql()),
    "E4_top_pairs": (top_pairs, f"SELECT * FROM ({_pairs_sql()}) WHERE corr IS NOT NULL ORDER BY abs(corr) DESC, a, b LIMIT 3"),
    "E5_histogram_chart": (histogram_chart, histogram_sql("SELECT * FROM orders", ["o_totalprice"])),
    "E6_box_stats": (box_stats, BOX_SQL),
    "E6_sample_outliers": (sample_outliers, SAMPLE_SQL),
    "E7_bar_chart": (bar_chart, _bar_sql(["segment", "vip"], "count")),
    "E8_pie_chart": (pie_chart, _bar_sql(["vip"], "value")),
    "E9_scatter": (scatter, SCATTER_SQL),
    "E10_monthly_mean": (monthly_mean, MONTH_SQL),
    "E11_heatmap": (heatmap, HEAT_SQL),
    "E12_skew_findings": (skew_findings, SKEW_SQL),
    "E13_dominance_findings": (dominance_findings, DOMINANCE_SQL),
    "E14_correlation_findings": (correlation_findings, CORR_SQL),
    "E15_imbalance_findings": (imbalance_findings, IMBALANCE_SQL),
    "E16_group_gaps": (group_gaps, GAP_SQL),
    "E16_findings": (findings, FINDINGS_SQL),
    "E17_neutral_finding": (neutral_finding, "SELECT 'data_quality' AS category, 'no strong skew, imbalance or correlation stands out' AS text FROM (SELECT skewness(c_acctbal) AS s FROM customer) WHERE abs(s) < 1"),
}
