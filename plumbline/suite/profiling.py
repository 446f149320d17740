"""Kinds, profiles and quality over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import ranks as R, text as X, values as V
from plumbline.operators import advice, duplicates as D, kinds as K, profile as P, quality as Q
from plumbline.suite.tables import CUSTOMER, GAPPY_SQL, LINES, dirty_customer, dirty_sql, gappy_lines, table, union_all

LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_LABELS = ["l_returnflag", "l_linestatus"]
WORDS = ", ".join(f"'{w}'" for w in X.BOOLEAN_WORDS)
BLANKS = r"E' \t\n\r\f'"
DIRTY = dirty_sql()
TEXTS = ["segment", "padded", "amount", "joined", "vip", "channel", "plan"]
NUMBERS = ["cust_id", "balance", "spend", "sparse", "few_gaps", "flag", "nothing", "churn_score"]


# ---------------------------------------------------------------- kinds (A)
def _kind_sql(table_sql: str, name: str, ordinal: int, dtype: str) -> str:
    if dtype == "time":
        rule = "'datetime'"
    elif dtype == "number":
        rule = f"CASE WHEN bool_and({name} IN (0, 1)) THEN 'boolean' ELSE 'numeric' END"
    else:
        rule = (
            f"CASE WHEN bool_and(lower(trim({name}, {BLANKS})) IN ({WORDS})) THEN 'boolean' "
            f"WHEN count(DISTINCT {name}) > greatest(50, 0.6 * count({name})) AND avg(length({name})) > 40 THEN 'text' "
            f"ELSE 'categorical' END"
        )
    return (
        f"SELECT {ordinal} AS ordinal, '{name}' AS \"column\", count({name}) AS count, "
        f"count(*) - count({name}) AS missing, CASE WHEN count({name}) = 0 THEN 'empty' ELSE {rule} END AS kind "
        f"FROM ({table_sql})"
    )


KIND_TABLES = {
    "dirty": (DIRTY, {n: "text" if n in TEXTS else "number" for n in CUSTOMER}),
    "documents": ("SELECT * FROM documents", {"doc_id": "number", "text": "text", "lang": "text", "source": "text", "n_chars": "number"}),
    "events": ("SELECT * FROM events", {"event_id": "number", "ts": "time", "user_id": "number", "event_type": "text", "value": "number", "props": "text"}),
}


def column_kinds(spark, d):
    out = None
    for name in KIND_TABLES:
        df = dirty_customer(spark, d) if name == "dirty" else table(spark, d, name)
        part = K.column_kinds(df).select(F.lit(name).alias("source"), "ordinal", "column", "count", "missing", "kind")
        out = part if out is None else out.unionByName(part)
    return out


COLUMN_KINDS_SQL = union_all(
    f"SELECT '{name}' AS source, * FROM ({_kind_sql(sql, c, i, t)})"
    for name, (sql, columns) in KIND_TABLES.items()
    for i, (c, t) in enumerate(columns.items())
)


def coerce_dates(spark, d):
    df = K.coerce_dates(dirty_customer(spark, d, "joined", "segment", "amount", key=True))
    month = F.date_format(F.col("joined").cast("timestamp"), "yyyy-MM")
    return df.groupBy(month.alias("month")).agg(F.count("*").alias("n"), F.min("amount").alias("least"))


COERCE_SQL = f"""
SELECT strftime(coalesce(try_strptime(joined, '%Y-%m-%d'), try_strptime(joined, '%m/%d/%Y')), '%Y-%m') AS month,
       count(*) AS n, min(amount) AS least
FROM ({dirty_sql('joined', 'amount')}) GROUP BY 1"""


SAMPLES = (5_000, 99_999, 100_001, 10**9)


def sampled(spark, d):
    """The sampled keys, below and above what one task may sort, and beyond the table."""
    lines = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_key"))
    parts = [K.sample_rows(lines, n, "row_key").select(F.lit(n).cast("long").alias("asked"), "row_key") for n in SAMPLES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


SAMPLE_SQL = """
WITH k AS (SELECT l_orderkey * 10 + l_linenumber AS row_key FROM lineitem),
 o AS (SELECT row_key, row_number() OVER (ORDER BY substr(md5(row_key::VARCHAR || '|42'), 1, 13), row_key) AS place FROM k)
SELECT asked::BIGINT AS asked, row_key FROM o, (VALUES (5000), (99999), (100001), (1000000000)) v(asked) WHERE place <= asked"""


# ---------------------------------------------------------------- profiles (P)
def lines_facts(spark, d):
    return P.column_facts(table(spark, d, "lineitem"))


def column_profile(spark, d):
    return P.column_profile(lines_facts(spark, d)).drop("dtype")


def _column_sql(src: str, name: str, ordinal: int, kind: str) -> str:
    shown = {
        "numeric": "CASE WHEN v % 1 = 0 THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(CAST(v AS DOUBLE) AS VARCHAR) END",
        "datetime": "strftime(v, '%Y-%m-%d %H:%M:%S')",
    }.get(kind, "v")
    high = "false" if kind in ("numeric", "datetime") else "u > greatest(50, 0.5 * n)"
    return f"""SELECT {ordinal} AS ordinal, '{name}' AS "column", '{kind}' AS kind, n AS count, rows - n AS missing,
 round(100.0 * (rows - n) / rows, 2) AS missing_pct, u AS "unique", round(100.0 * u / n, 2) AS unique_pct,
 u <= 1 AS is_constant, u > 1 AND top >= 0.98 * n AS is_near_constant, {high} AS is_high_cardinality, mode
FROM (SELECT count({name}) AS n, count(*) AS rows, count(DISTINCT {name}) AS u FROM {src}),
 (SELECT c AS top, {shown} AS mode FROM (SELECT {name} AS v, count(*) AS c FROM {src} GROUP BY 1) ORDER BY c DESC, v LIMIT 1)"""


_LINE_KINDS = {**{c: "numeric" for c in LINE_NUMBERS}, **{c: "categorical" for c in LINE_LABELS}, "l_shipdate": "datetime"}
COLUMN_PROFILE_SQL = union_all(_column_sql("lineitem", c, i, k) for i, (c, k) in enumerate(_LINE_KINDS.items()))


def dataset_profile(spark, d):
    df = dirty_customer(spark, d)
    out = P.dataset_profile(df, P.column_facts(df), D.count_duplicates(df))
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select(
        "n_rows", "n_cols", "n_numeric", "n_categorical", "n_datetime", "n_boolean", "n_text", "n_empty",
        "missing_cells", "missing_pct", "duplicate_rows", "duplicate_pct",
        joined("constant_columns"), joined("near_constant_columns"), joined("high_cardinality_columns"),
    )


_KINDS_OF_DIRTY = union_all(_kind_sql(DIRTY, n, i, "text" if n in TEXTS else "number") for i, n in enumerate(CUSTOMER))
_SHAPE_OF_DIRTY = union_all(
    f"SELECT {i} AS ordinal, '{n}' AS name, count(DISTINCT {n}) AS u, count({n}) AS n, "
    f"(SELECT max(c) FROM (SELECT count({n}) AS c FROM ({DIRTY}) GROUP BY {n})) AS top FROM ({DIRTY})"
    for i, n in enumerate(CUSTOMER)
)
DATASET_SQL = f"""
WITH k AS ({_KINDS_OF_DIRTY}), s AS ({_SHAPE_OF_DIRTY}), j AS (SELECT * FROM k JOIN s USING (ordinal)),
 t AS (SELECT count(*) AS rows FROM customer),
 dup AS (SELECT coalesce(sum(c), 0) AS dup FROM (SELECT count(*) AS c FROM ({DIRTY}) GROUP BY {", ".join(CUSTOMER)} HAVING count(*) > 1))
SELECT any_value(rows) AS n_rows, count(*) AS n_cols,
 {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("numeric", "categorical", "datetime", "boolean", "text", "empty"))},
 sum(missing)::BIGINT AS missing_cells, round(100.0 * sum(missing) / (any_value(rows) * count(*)), 2) AS missing_pct,
 any_value(dup)::BIGINT AS duplicate_rows, round(100.0 * any_value(dup) / any_value(rows), 2) AS duplicate_pct,
 coalesce(string_agg(name, ',' ORDER BY ordinal) FILTER (u = 1), '') AS constant_columns,
 coalesce(string_agg(name, ',' ORDER BY ordinal) FILTER (u > 1 AND top >= 0.98 * n), '') AS near_constant_columns,
 coalesce(string_agg(name, ',' ORDER BY ordinal) FILTER (kind IN ('categorical', 'text') AND u > greatest(50, 0.5 * n)), '') AS high_cardinality_columns
FROM j, t, dup"""

TOP_COLUMNS = ["l_linenumber", "l_quantity", "l_suppkey", "l_returnflag", "l_linestatus"]


def top_values(spark, d):
    return P.top_values(table(spark, d, "lineitem"), TOP_COLUMNS)


def _top_sql(src: str, name: str, k: int, text: str | None = None) -> str:
    shown = text or f"CAST(CAST({name} AS BIGINT) AS VARCHAR)"
    return f"""SELECT '{name}' AS "column", rank, value, n, round(100.0 * n / total, 2) AS pct FROM (
 SELECT {shown} AS value, count(*) AS n, sum(count(*)) OVER () AS total,
  CAST(row_number() OVER (ORDER BY count(*) DESC, {name}) AS INTEGER) AS rank
 FROM ({src}) WHERE {name} IS NOT NULL GROUP BY {name}) WHERE rank <= {k}"""


TOP_SQL = union_all(_top_sql("SELECT * FROM lineitem", c, 10, c if c in LINE_LABELS else None) for c in TOP_COLUMNS)


def numeric_profile(spark, d):
    return P.numeric_profile(gappy_lines(spark, d), _NUM)


def numeric_sql(src: str, names) -> str:
    return union_all(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median,
 round(stddev_samp({c}), 6) AS std, round(min({c}) * 1.0::DOUBLE, 6) AS min, round(max({c}) * 1.0::DOUBLE, 6) AS max,
 round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, round(any_value(q3 - q1), 6) AS iqr,
 round(skewness({c}), 6) AS skew, round(kurtosis({c}), 6) AS kurtosis,
 count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count
FROM ({src}), (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM ({src}))"""
        for c in names
    )


def quantiles(spark, d):
    return P.quantile_profile(gappy_lines(spark, d), ["l_orderkey", "quantity", "price"])


QUANTILE_SQL = union_all(
    f"SELECT '{c}' AS \"column\", {p}::DOUBLE AS p, round(quantile_cont({c}, {p}) * 1.0::DOUBLE, 6) AS value FROM ({GAPPY_SQL})"
    for c in ("l_orderkey", "quantity", "price") for p in P.QUANTILES
)


def approximate_quantiles(spark, d):
    """Each sketched quantile with the row count and whether its rank lies within the promised error (one in ``R.ACCURACY``, and one row)."""
    lines = table(spark, d, "lineitem")
    found = P.quantile_profile(lines, ["l_extendedprice"], approximate=True).collect()
    ranks = lines.agg(F.count("*").alias("n"), *[
        F.struct(F.count_if(F.col("l_extendedprice") < r["value"]).alias("below"), F.count_if(F.col("l_extendedprice") <= r["value"]).alias("upto")).alias(f"r{i}")
        for i, r in enumerate(found)
    ])
    room = F.col("n") / R.ACCURACY + 1
    return ranks.select(F.inline(F.array(*[
        F.struct(F.lit(r["p"]).alias("p"), F.col("n"), ((F.col(f"r{i}.below") <= r["p"] * F.col("n") + room) & (F.col(f"r{i}.upto") >= r["p"] * F.col("n") - room)).alias("within"))
        for i, r in enumerate(found)
    ])))


def histogram(spark, d):
    return P.histogram(gappy_lines(spark, d), ["l_linenumber", "price", "discount", "one"])


def histogram_sql(src: str, columns, bins: int = 20) -> str:
    return union_all(
        f"""SELECT '{c}' AS "column", CAST(i AS INTEGER) AS bin, round(lo + (hi - lo) * (i - 1) / k, 6) AS low,
 round(CASE WHEN i = k THEN hi ELSE lo + (hi - lo) * i / k END, 6) AS high, count(x) AS count
FROM (SELECT unnest(range(1, k + 1)) AS i, lo, hi, k FROM (
   SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, least({bins}, greatest(count(DISTINCT {c}), 2)) AS k FROM ({src})) WHERE lo < hi)
LEFT JOIN (SELECT {c}::DOUBLE AS x FROM ({src}) WHERE {c} IS NOT NULL)
 ON least(CAST(floor((x - lo) * k / (hi - lo)) AS BIGINT) + 1, k) = i
GROUP BY i, k, lo, hi"""
        for c in columns
    )


def time_profile(spark, d):
    df = table(spark, d, "orders").select("o_orderdate", F.col("o_orderdate").cast("date").alias("day"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return P.time_profile(P.column_facts(df)).select("column", text("min"), text("max"), text("mode"))


TIME_SQL = union_all(
    f"""SELECT '{c}' AS "column", strftime(min(o_orderdate), '%Y-%m-%d') AS min, strftime(max(o_orderdate), '%Y-%m-%d') AS max,
 (SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders GROUP BY o_orderdate ORDER BY count(*) DESC, o_orderdate LIMIT 1) AS mode FROM orders"""
    for c in ("o_orderdate", "day")
)


def rounding(spark, d):
    df = table(spark, d, "customer").selectExpr(
        "c_custkey",
        "CASE WHEN c_custkey % 9 = 0 THEN double('NaN') WHEN c_custkey % 9 = 1 THEN double('Infinity') ELSE c_acctbal / 7 END AS x",
    )
    x = V.finite(F.col("x"), 4)
    return df.groupBy((F.col("c_custkey") % 9).alias("k")).agg(
        F.count(x).alias("finite"), F.round(F.max(x), 3).alias("most"),
        V.pct(F.count(x), F.count("*")).alias("pct"), V.pct(F.count("*"), F.lit(0)).alias("empty_pct"),
    )


ROUNDING_SQL = """
SELECT c_custkey % 9 AS k, count(*) FILTER (c_custkey % 9 > 1) AS finite,
 round(max(CASE WHEN c_custkey % 9 > 1 THEN round(c_acctbal / 7, 4) END), 3) AS most,
 CASE WHEN c_custkey % 9 > 1 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS pct, 0.0::DOUBLE AS empty_pct
FROM customer GROUP BY 1"""


# ---------------------------------------------------------------- quality (Q, D)
def _facts(spark, d, *names):
    return P.column_facts(dirty_customer(spark, d, *names))


def _issue_view(df, *evidence):
    return df.select(
        "code", "dimension", "severity", F.coalesce(F.get("columns", F.lit(0)), F.lit("")).alias("column"),
        F.coalesce("operation", F.lit("")).alias("operation"),
        *[F.col("evidence").getItem(e).cast("double").alias(e) for e in evidence],
    )


def missing_issues(spark, d):
    return _issue_view(Q.missing_issues(_facts(spark, d)), "missing", "missing_pct")


MISSING_SQL = "SELECT * FROM (" + union_all(
    f"""SELECT 'missing::{c}' AS code, 'missing_values' AS dimension,
 CASE WHEN s >= 40 THEN 'high' WHEN s >= 5 THEN 'medium' ELSE 'low' END AS severity, '{c}' AS "column",
 CASE WHEN s >= 40 THEN 'drop_column' ELSE 'impute_missing' END AS operation, m::DOUBLE AS missing, round(s, 2) AS missing_pct
FROM (SELECT count(*) - count({c}) AS m, 100.0 * (count(*) - count({c})) / count(*) AS s FROM ({dirty_sql(c)}))"""
    for c in CUSTOMER
) + ") WHERE missing > 0"


def duplicate_issue(spark, d):
    lines = table(spark, d, "lineitem").select(*LINES)
    return _issue_view(Q.duplicate_issues(D.duplicate_rows(lines), lines.count()), "duplicate_rows", "duplicate_pct")


DUPLICATE_SQL = f"""
SELECT 'duplicates::rows' AS code, 'duplicates' AS dimension,
 CASE WHEN p >= 5 THEN 'high' WHEN p >= 1 THEN 'medium' ELSE 'low' END AS severity, '' AS "column",
 'drop_duplicates' AS operation, n::DOUBLE AS duplicate_rows, round(p, 2) AS duplicate_pct
FROM (SELECT sum(c) AS n, 100.0 * sum(c) / (SELECT count(*) FROM lineitem) AS p
 FROM (SELECT count(*) AS c FROM lineitem GROUP BY {", ".join(LINES)} HAVING count(*) > 1))"""


def identifier_issues(spark, d):
    return _issue_view(Q.identifier_issues(_facts(spark, d, "cust_id", "balance", "segment")), "duplicate_values")


IDENTIFIER_SQL = f"""
SELECT 'duplicates::id::cust_id' AS code, 'duplicates' AS dimension, 'medium' AS severity, 'cust_id' AS "column",
 '' AS operation, sum(c)::DOUBLE AS duplicate_values
FROM (SELECT count(*) AS c FROM ({DIRTY}) GROUP BY cust_id HAVING count(*) > 1)"""


def type_issues(spark, d):
    df = dirty_customer(spark, d, "segment", "joined", "vip").select(
        "*", F.expr("'1,234'").alias("as_number")
    )
    return _issue_view(Q.type_issues(P.column_facts(df)), "numeric_like_pct", "date_like_pct")


TYPE_SQL = """
SELECT 'dtype::numeric_string::as_number' AS code, 'data_types' AS dimension, 'medium' AS severity, 'as_number' AS "column",
 'to_numeric' AS operation, 100.0::DOUBLE AS numeric_like_pct, NULL::DOUBLE AS date_like_pct
UNION ALL
SELECT 'dtype::date_string::joined', 'data_types', 'low', 'joined', 'to_datetime', NULL, p FROM (
 SELECT round(100 * avg(CASE WHEN regexp_matches(joined, '\\d{4}-\\d{2}-\\d{2}|\\d{1,2}/\\d{1,2}/\\d{2,4}') THEN 1 ELSE 0 END), 2) AS p
 FROM (""" + dirty_sql("joined") + """)) WHERE p >= 90"""


def label_issues(spark, d):
    df = dirty_customer(spark, d, "segment", "padded", "channel")
    return _issue_view(Q.label_issues(df, P.column_facts(df)), "raw_level_count", "canonical_level_count")


_CANON = "lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
LABEL_SQL = f"""
SELECT 'category::inconsistent::segment' AS code, 'categorical_consistency' AS dimension, 'medium' AS severity,
 'segment' AS "column", 'standardize_categories' AS operation, count(DISTINCT segment)::DOUBLE AS raw_level_count,
 count(DISTINCT {_CANON.format(c='segment')})::DOUBLE AS canonical_level_count FROM ({DIRTY})
UNION ALL
SELECT 'category::whitespace::padded', 'categorical_consistency', 'low', 'padded', 'trim_whitespace', NULL, NULL
WHERE (SELECT count(*) FROM ({DIRTY}) WHERE padded <> trim(padded)) > 0"""


def outlier_counts(spark, d):
    return Q.outlier_counts(dirty_customer(spark, d), ["balance", "spend", "churn_score", "few_gaps"])


def outlier_sql(src: str, columns) -> str:
    return union_all(
        f"""SELECT '{c}' AS "column", count({c}) AS count,
 count(*) FILTER ({c} < lo OR {c} > hi) AS iqr_outliers,
 count(*) FILTER (0.6745 * abs({c} - med) / mad > 3.5) AS modified_z_outliers,
 round(any_value(lo), 4) AS lower_fence, round(any_value(hi), 4) AS upper_fence
FROM ({src}), (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, med, mad FROM
 (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, median({c}) AS med, mad({c}) AS mad FROM ({src})))"""
        for c in columns
    )


def outlier_issues(spark, d):
    df = dirty_customer(spark, d, "spend", "balance", "flag")
    facts = P.column_facts(df)
    issues = Q.outlier_issues(Q.outlier_counts(df, Q.outlier_columns(facts)), facts)
    return _issue_view(issues, "iqr_outliers", "outlier_pct", "modified_zscore_outliers")


OUTLIER_ISSUE_SQL = f"""
SELECT 'outliers::' || "column" AS code, 'outliers' AS dimension,
 CASE WHEN 100.0 * iqr_outliers / count >= 5 THEN 'medium' ELSE 'low' END AS severity, "column", 'handle_outliers' AS operation,
 iqr_outliers::DOUBLE AS iqr_outliers, round(100.0 * iqr_outliers / count, 2) AS outlier_pct,
 modified_z_outliers::DOUBLE AS modified_zscore_outliers
FROM ({outlier_sql(DIRTY, ['spend', 'balance'])}) WHERE iqr_outliers > 0"""


def constant_issues(spark, d):
    return _issue_view(Q.constant_issues(_facts(spark, d)), "unique_values", "dominant_value_pct")


CONSTANT_SQL = f"""
SELECT CASE WHEN u <= 1 THEN 'constant::' ELSE 'near_constant::' END || name AS code, 'constant_columns' AS dimension,
 CASE WHEN u <= 1 THEN 'low' ELSE 'info' END AS severity, name AS "column", CASE WHEN u <= 1 THEN 'drop_column' ELSE '' END AS operation,
 CASE WHEN u <= 1 THEN u::DOUBLE END AS unique_values, CASE WHEN u > 1 THEN round(100.0 * top / n, 2) END AS dominant_value_pct
FROM ({_SHAPE_OF_DIRTY}) JOIN ({_KINDS_OF_DIRTY}) USING (ordinal)
WHERE n > 0 AND (u <= 1 OR (top >= 0.98 * n AND kind <> 'boolean'))"""


def leakage_issues(spark, d):
    return _issue_view(Q.leakage_issues(_facts(spark, d, "churn_score", "balance", "vip")))


LEAKAGE_SQL = """SELECT 'leakage::name::churn_score' AS code, 'potential_leakage' AS dimension, 'info' AS severity,
 'churn_score' AS "column", '' AS operation FROM (SELECT count(*) AS n FROM customer) WHERE n > 0"""

_SCORED = ["segment", "balance", "spend", "few_gaps", "channel", "plan", "churn_score"]


def _issues(spark, d):
    return Q.analyze_quality(dirty_customer(spark, d, *_SCORED))


def analyze_quality(spark, d):
    return _issues(spark, d).select(
        "code", "dimension", "severity", F.coalesce(F.get("columns", F.lit(0)), F.lit("")).alias("column")
    )


_S = dirty_sql(*_SCORED)
_SHAPE_SCORED = union_all(
    f"SELECT '{n}' AS name, count(DISTINCT {n}) AS u, count({n}) AS n, count(*) AS rows, "
    f"(SELECT max(c) FROM (SELECT count({n}) AS c FROM ({_S}) GROUP BY {n})) AS top FROM ({_S})" for n in _SCORED
)
ISSUES_SQL = f"""
SELECT 'missing::' || name AS code, 'missing_values' AS dimension, CASE WHEN 100.0 * (rows - n) / rows >= 40 THEN 'high'
 WHEN 100.0 * (rows - n) / rows >= 5 THEN 'medium' ELSE 'low' END AS severity, name AS "column" FROM ({_SHAPE_SCORED}) WHERE rows > n
UNION ALL SELECT 'duplicates::rows', 'duplicates', CASE WHEN p >= 5 THEN 'high' WHEN p >= 1 THEN 'medium' ELSE 'low' END, ''
 FROM (SELECT 100.0 * sum(c) / (SELECT count(*) FROM customer) AS p FROM (SELECT count(*) AS c FROM ({_S}) GROUP BY {", ".join(_SCORED)} HAVING count(*) > 1)) WHERE p > 0
UNION ALL SELECT 'category::inconsistent::segment', 'categorical_consistency', 'medium', 'segment'
 FROM (SELECT count(DISTINCT segment) AS r, count(DISTINCT {_CANON.format(c='segment')}) AS k FROM ({_S})) WHERE r > k
UNION ALL SELECT 'outliers::' || "column", 'outliers', CASE WHEN 100.0 * iqr_outliers / count >= 5 THEN 'medium' ELSE 'low' END, "column"
 FROM ({outlier_sql(_S, ['balance', 'spend', 'few_gaps', 'churn_score'])}) WHERE iqr_outliers > 0
UNION ALL SELECT CASE WHEN u <= 1 THEN 'constant::' ELSE 'near_constant::' END || name, 'constant_columns',
 CASE WHEN u <= 1 THEN 'low' ELSE 'info' END, name FROM ({_SHAPE_SCORED}) WHERE u <= 1 OR top >= 0.98 * n
UNION ALL SELECT 'leakage::name::churn_score', 'potential_leakage', 'info', 'churn_score'"""

_DIMS = ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(Q.DIMENSIONS.items()))
SCORE_SQL = f"""
SELECT dims.ordinal, dims.dimension, label, greatest(0.0::DOUBLE, 100.0::DOUBLE - coalesce(lost, 0)) AS score, coalesce(n, 0)::BIGINT AS issues
FROM (VALUES {_DIMS}) AS dims(ordinal, dimension, label)
LEFT JOIN (SELECT dimension, sum(CASE severity WHEN 'info' THEN 2 WHEN 'low' THEN 6 WHEN 'medium' THEN 16 ELSE 34 END) AS lost,
 count(*) AS n FROM ({ISSUES_SQL}) GROUP BY 1) AS lost USING (dimension)"""


def dimension_scores(spark, d):
    return Q.dimension_scores(_issues(spark, d))


def overall_score(spark, d):
    return Q.overall_score(_issues(spark, d))


OVERALL_SQL = f"""
SELECT overall, CASE WHEN overall >= 90 THEN 'excellent' WHEN overall >= 75 THEN 'good' WHEN overall >= 60 THEN 'fair'
 WHEN overall >= 40 THEN 'poor' ELSE 'critical' END AS grade, issues
FROM (SELECT round(avg(score), 1) AS overall, sum(issues)::BIGINT AS issues FROM ({SCORE_SQL}))"""


def recommendations(spark, d):
    df = dirty_customer(spark, d, *_SCORED)
    facts = P.column_facts(df)
    return advice.recommend(Q.analyze_quality(df, facts), facts).select("id", "operation", "risk")


ADVICE_SQL = f"""
SELECT code AS id, op AS operation, CASE WHEN op = 'impute_missing' AND severity NOT IN ('low', 'info') THEN 'medium'
 WHEN op = 'drop_column' THEN 'medium' ELSE 'low' END AS risk
FROM (SELECT code, severity, CASE WHEN code LIKE 'missing::%' AND severity = 'high' THEN 'drop_column'
 WHEN code LIKE 'missing::%' THEN 'impute_missing' WHEN code = 'duplicates::rows' THEN 'drop_duplicates'
 WHEN code LIKE 'category::inc%' THEN 'standardize_categories' WHEN code LIKE 'outliers::%' THEN 'handle_outliers'
 WHEN code LIKE 'constant::%' THEN 'drop_column' END AS op FROM ({ISSUES_SQL})) WHERE op IS NOT NULL"""


def safe_fixes(spark, d):
    df = dirty_customer(spark, d, *_SCORED)
    facts = P.column_facts(df)
    return advice.safe_fixes(advice.recommend(Q.analyze_quality(df, facts), facts)).select("id", "operation")


def duplicate_rows(spark, d):
    texts = D.duplicate_rows(table(spark, d, "documents").select("text")).select(F.lit("documents").alias("source"), "duplicate_rows")
    lines = D.duplicate_rows(table(spark, d, "lineitem").select(*LINES)).select(F.lit("lineitem").alias("source"), "duplicate_rows")
    return texts.unionByName(lines)


DUP_ROWS_SQL = f"""
SELECT 'documents' AS source, sum(c)::BIGINT AS duplicate_rows FROM (SELECT count(*) AS c FROM documents GROUP BY text HAVING count(*) > 1)
UNION ALL SELECT 'lineitem', sum(c)::BIGINT FROM (SELECT count(*) AS c FROM lineitem GROUP BY {", ".join(LINES)} HAVING count(*) > 1)"""

_NUM = ["l_linenumber", "quantity", "price"]
WIDE = {"line_id": "l_orderkey * 8 + l_linenumber + 1152921504606846976", "order_id": "l_orderkey + 1152921504606846976"}


def _wide(spark, d):
    """Keys and amounts whose differences a double cannot hold."""
    lines = table(spark, d, "lineitem").selectExpr(
        f"{WIDE['line_id']} AS line_id", f"{WIDE['order_id']} AS order_id",
        "CAST(CAST('10000000000000000000000000' AS DECIMAL(38,6)) + CAST(l_quantity AS DECIMAL(10,2)) AS DECIMAL(38,6)) AS amount")
    return P.column_facts(lines)


def wide_profile(spark, d):
    return P.column_profile(_wide(spark, d)).select("column", "kind", "count", "unique", "is_constant", "mode")


def wide_identifiers(spark, d):
    found = Q.identifier_issues(_wide(spark, d))
    return found.select("code", F.col("evidence")["duplicate_values"].cast("long").alias("duplicate_values"))


_WIDE_CELLS = """
cells AS (
  SELECT 'line_id' AS "column", l_orderkey * 8 + l_linenumber AS k, (l_orderkey * 8 + l_linenumber + 1152921504606846976)::VARCHAR AS shown FROM lineitem
  UNION ALL SELECT 'order_id', l_orderkey, (l_orderkey + 1152921504606846976)::VARCHAR FROM lineitem
  UNION ALL SELECT 'amount', l_quantity::BIGINT, '100000000000000000000000' || lpad(l_quantity::BIGINT::VARCHAR, 2, '0') FROM lineitem
), n AS (SELECT "column", k, shown, count(*) AS n FROM cells GROUP BY ALL)"""
WIDE_PROFILE_SQL = f"""
WITH {_WIDE_CELLS}
SELECT "column", 'numeric' AS kind, sum(n)::BIGINT AS count, count(*) AS "unique", false AS is_constant,
  first(shown ORDER BY n DESC, k) AS mode FROM n GROUP BY 1"""
WIDE_IDENTIFIER_SQL = f"""
WITH {_WIDE_CELLS}
SELECT 'duplicates::id::' || "column" AS code, sum(n) FILTER (n > 1)::BIGINT AS duplicate_values
FROM n WHERE "column" <> 'amount' GROUP BY "column" HAVING max(n) > 1"""

QUERIES = {
    "P2_wide_ids": (wide_profile, WIDE_PROFILE_SQL),
    "Q3_wide_ids": (wide_identifiers, WIDE_IDENTIFIER_SQL),
    "A1_column_kinds": (column_kinds, COLUMN_KINDS_SQL),
    "A2_coerce_dates": (coerce_dates, COERCE_SQL),
    "A3_sample_rows": (sampled, SAMPLE_SQL),
    "P1_dataset_profile": (dataset_profile, DATASET_SQL),
    "P2_column_profile": (column_profile, COLUMN_PROFILE_SQL),
    "P3_top_values": (top_values, TOP_SQL),
    "P7_numeric_profile": (numeric_profile, numeric_sql(GAPPY_SQL, _NUM)),
    "P8_quantiles": (quantiles, QUANTILE_SQL),
    "P8_quantiles_approximate": (approximate_quantiles, "SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]) AS p, count(*) AS n, true AS within FROM lineitem"),
    "P9_histogram": (histogram, histogram_sql(GAPPY_SQL, ["l_linenumber", "price", "discount", "one"])),
    "P10_time_profile": (time_profile, TIME_SQL),
    "P11_rounding": (rounding, ROUNDING_SQL),
    "Q1_missing_issues": (missing_issues, MISSING_SQL),
    "Q2_duplicate_issue": (duplicate_issue, DUPLICATE_SQL),
    "Q3_identifier_issues": (identifier_issues, IDENTIFIER_SQL),
    "Q4_Q5_type_issues": (type_issues, TYPE_SQL),
    "Q6_Q7_label_issues": (label_issues, LABEL_SQL),
    "Q8_outlier_issues": (outlier_issues, OUTLIER_ISSUE_SQL),
    "Q9_outlier_counts": (outlier_counts, outlier_sql(DIRTY, ["balance", "spend", "churn_score", "few_gaps"])),
    "Q10_Q11_constant_issues": (constant_issues, CONSTANT_SQL),
    "Q12_leakage_issues": (leakage_issues, LEAKAGE_SQL),
    "Q13_analyze_quality": (analyze_quality, ISSUES_SQL),
    "Q14_dimension_scores": (dimension_scores, SCORE_SQL),
    "Q15_overall_score": (overall_score, OVERALL_SQL),
    "C18_recommendations": (recommendations, ADVICE_SQL),
    "C19_safe_fixes": (safe_fixes, f"SELECT id, operation FROM ({ADVICE_SQL}) WHERE risk = 'low'"),
    "D1_duplicate_rows": (duplicate_rows, DUP_ROWS_SQL),
}
