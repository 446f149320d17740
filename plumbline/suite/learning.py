"""Training and scoring: documents with labels for classes, lines for numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import kinds as K, model as M, profile as P
from plumbline.suite.tables import table

DOCS = """SELECT d.doc_id, lang, source, n_chars, length(text) - length(replace(text, ' ', '')) AS words, length(text) - length(replace(text, '.', '')) AS stops,
 CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE n_chars % 97 END AS gappy, quality, toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id"""


def labelled(s, d):
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    return docs.selectExpr(
        "doc_id", "lang", "source", "n_chars", "length(text) - length(replace(text, ' ', '')) AS words",
        "length(text) - length(replace(text, '.', '')) AS stops", "CASE WHEN doc_id % 9 = 0 THEN NULL ELSE n_chars % 97 END AS gappy", "quality", "toxic",
    )


def lines(s, d):
    return table(s, d, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS line_id", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_shipdate", "l_extendedprice"
    )


def m1(s, d):
    docs, ls = labelled(s, d), lines(s, d)
    view = lambda df, t: M.detect_task(df, t).select("target", "task", "unique", "is_imbalanced", "primary_metric", F.round("target_mean", 4).alias("target_mean"))
    return view(docs, "toxic").unionByName(view(docs, "lang")).unionByName(view(ls, "l_extendedprice")).unionByName(view(ls.select("l_quantity"), "l_quantity"))


def _task_sql(src, t, number):
    few = f"count(DISTINCT {t}) <= 10 AND bool_and({t} % 1 = 0) AND count(DISTINCT {t}) / count({t}) < 0.05" if number else "true"
    mean = f"round(avg({t}), 4)" if number else "NULL::DOUBLE"
    return f"""SELECT '{t}' AS target, CASE WHEN c THEN 'classification' ELSE 'regression' END AS task, u AS "unique", CASE WHEN c THEN low < 0.2 END AS is_imbalanced,
 CASE WHEN NOT c THEN 'r2' WHEN low < 0.2 THEN 'f1' ELSE 'accuracy' END AS primary_metric, CASE WHEN NOT c THEN m END AS target_mean FROM
 (SELECT {few} AS c, count(DISTINCT {t}) AS u, {mean} AS m FROM ({src})), (SELECT min(n) / sum(n) AS low FROM (SELECT count(*) AS n FROM ({src}) GROUP BY {t}))"""


M1 = " UNION ALL ".join([_task_sql(DOCS, "toxic", True), _task_sql(DOCS, "lang", False), _task_sql("SELECT * FROM lineitem", "l_extendedprice", True), _task_sql("SELECT * FROM lineitem", "l_quantity", True)])


def m2(s, d):
    df = labelled(s, d).withColumn("paid", F.col("doc_id") + 1)
    facts = P.column_facts(df)
    _, features = M.prepare(df, "quality", "doc_id", facts=facts)
    return facts.where(F.col("column").isin(features.dropped)).select("column", "count", "unique")


def m3(s, d):
    rows, features = M.prepare(lines(s, d), "l_extendedprice", "line_id")
    return rows.agg(
        F.lit(",".join(features.numeric)).alias("numeric"), F.lit(",".join(features.categorical)).alias("categorical"),
        F.sum("l_shipdate__dow").cast("long").alias("dow"), F.sum("l_shipdate__month").cast("long").alias("month"), F.count("*").alias("rows"),
    )


M3 = """SELECT 'l_partkey,l_quantity,l_discount,l_tax,l_shipdate__year,l_shipdate__month,l_shipdate__dow' AS numeric, 'l_returnflag' AS categorical,
 sum(isodow(l_shipdate) - 1)::BIGINT AS dow, sum(month(l_shipdate))::BIGINT AS month, count(*) AS rows FROM lineitem"""


def m4(s, d):
    docs = table(s, d, "documents").withColumn("_label", F.when(F.col("doc_id") < 3, F.concat(F.lit("solo"), "doc_id")).otherwise(F.col("lang")))
    return M.drop_single_classes(docs).groupBy("_label").agg(F.count("*").alias("n"))


M4 = """SELECT * FROM (SELECT CASE WHEN doc_id < 3 THEN 'solo' || doc_id ELSE lang END AS _label, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1"""


def m5(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("_key"), F.col("o_orderpriority").alias("_label"))
    train, test = M.split(rows)
    size = lambda df, n: df.groupBy("_label").agg(F.count("*").alias(n))
    return size(train, "train").join(size(test, "test"), "_label").select("_label", "train", "test")


M5 = """SELECT o_orderpriority AS _label, count(*) - (round_even((count(*) - 1) * 0.2, 0)::BIGINT + 1) AS train, round_even((count(*) - 1) * 0.2, 0)::BIGINT + 1 AS test
FROM orders GROUP BY 1"""


def _prepared(s, d):
    rows, features = M.prepare(labelled(s, d), "quality", "doc_id", drop=["toxic"])
    return rows, features, M.preprocessing(rows, features).fit(rows).transform(rows)


def m6(s, d):
    _, _, ready = _prepared(s, d)
    return ready.select(F.col("_key").alias("doc_id"), F.round("gappy__z", 6).alias("gappy"), F.round("words__z", 6).alias("words"))


M6 = f"""WITH t AS ({DOCS}), f AS (SELECT *, coalesce(gappy, (SELECT median(gappy) FROM t)) AS g FROM t)
SELECT doc_id, round((g - (SELECT avg(g) FROM f)) / (SELECT stddev_pop(g) FROM f), 6) AS gappy, round((words - (SELECT avg(words) FROM f)) / (SELECT stddev_pop(words) FROM f), 6) AS words FROM f"""


def m7(s, d):
    _, _, ready = _prepared(s, d)
    return ready.groupBy("source__level").agg(F.count("*").alias("n"), F.count_distinct("source__index").alias("slots"))


M7 = f"""WITH t AS (SELECT source, count(*) AS n, sum(count(*)) OVER () AS total FROM ({DOCS}) GROUP BY 1)
SELECT CASE WHEN n >= 0.01 * total THEN source ELSE 'infrequent' END AS source__level, sum(n)::BIGINT AS n, 1::BIGINT AS slots FROM t GROUP BY 1"""


def _train_class(*models, **more):
    def run(s, d):
        out = M.train_and_compare(labelled(s, d), "quality", "doc_id", models=list(models), drop=["toxic"], **more)
        return out.comparison_frame().select("model", "is_best", "accuracy", "precision", "recall", "f1", "roc_auc", "cv_mean")
    return run


def _train_number(*models, **more):
    def run(s, d):
        out = M.train_and_compare(lines(s, d), "l_extendedprice", "line_id", models=list(models), **more)
        return out.comparison_frame().select("model", "is_best", "r2", "mae", "mse", "rmse", "cv_mean")
    return run


def m11(s, d):
    out = M.train_and_compare(labelled(s, d), "lang", "doc_id", models=["K-Nearest Neighbors"], drop=["source"], cross_validation=False, permutations=0)
    return out.comparison_frame().select("model", "accuracy", "f1", "roc_auc")


# A fixed rule as predictor makes the metrics comparable.
_RULE = "CASE WHEN (l_partkey + l_linenumber) % 4 = 0 THEN 'A' WHEN l_quantity > 30 THEN l_returnflag ELSE 'N' END"


def m14(s, d):
    rows = table(s, d, "lineitem").selectExpr("l_returnflag AS y", f"{_RULE} AS p")
    matrix = M.confusion(rows, "y", "p")
    r6 = lambda df, n: df.select(F.lit(n).alias("mode"), *[F.round(c, 8).alias(c) for c in ("accuracy", "precision", "recall", "f1")])
    return r6(M.classification_metrics(matrix), "macro").unionByName(r6(M.classification_metrics(matrix, "R"), "class R"))


M14 = f"""WITH t AS (SELECT l_returnflag AS y, {_RULE} AS p FROM lineitem), c AS (SELECT DISTINCT y AS k FROM t),
 m AS (SELECT k, coalesce(count(*) FILTER (y = k AND p = k) / nullif(count(*) FILTER (p = k), 0), 0) AS p, coalesce(count(*) FILTER (y = k AND p = k) / nullif(count(*) FILTER (y = k), 0), 0) AS r FROM t, c GROUP BY k),
 f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM m), a AS (SELECT avg(CASE WHEN y = p THEN 1 ELSE 0 END) AS acc FROM t)
SELECT 'macro' AS mode, round(any_value(acc), 8) AS accuracy, round(avg(p), 8) AS precision, round(avg(r), 8) AS recall, round(avg(f), 8) AS f1 FROM f, a
UNION ALL SELECT 'class R', round(acc, 8), round(p, 8), round(r, 8), round(f, 8) FROM f, a WHERE k = 'R'"""


def m14_confusion(s, d):
    return M.confusion(table(s, d, "lineitem").selectExpr("l_returnflag AS y", f"{_RULE} AS p"), "y", "p")


def m14_auc(s, d):
    rows = table(s, d, "orders").selectExpr("o_orderstatus = 'F' AS y", "CAST(o_orderkey * 37 % 101 AS DOUBLE) + CASE WHEN o_orderstatus = 'F' THEN 9 ELSE 0 END AS score")
    area = M.roc_auc(rows, F.col("y"), F.col("score"))
    return rows.agg(F.count("*").alias("rows"), F.round(F.lit(area), 8).alias("auc"))


M14_AUC = """WITH t AS (SELECT o_orderstatus = 'F' AS y, o_orderkey * 37 % 101 + CASE WHEN o_orderstatus = 'F' THEN 9 ELSE 0 END AS score FROM orders),
 r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM t)
SELECT count(*) AS rows, round((sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y)::DOUBLE * count(*) FILTER (NOT y)), 8) AS auc FROM r"""


def m15(s, d):
    rows = table(s, d, "lineitem").selectExpr("l_extendedprice AS y", "l_quantity * 1400 AS p")
    return M.regression_metrics(rows, "y", "p").select([F.round(c, 6).alias(c) for c in ("r2", "mae", "mse", "rmse")])


M15 = """WITH t AS (SELECT l_extendedprice AS y, l_extendedprice - l_quantity * 1400 AS e FROM lineitem)
SELECT round(1 - avg(e * e) / var_pop(y), 6) AS r2, round(avg(abs(e)), 6) AS mae, round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse FROM t"""


def m16(s, d):
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("_key"), F.col("o_orderstatus").alias("_label"))
    parts = M.assign_parts(rows, "_key", [0.2, 0.4, 0.6, 0.8], "_label")
    return parts.groupBy("_label", F.col("_part").alias("fold")).agg(F.count("*").alias("n"))


M16 = "SELECT _label, fold, n FROM (SELECT _label, unnest([0, 1, 2, 3, 4]) AS fold, unnest([a, b - a, c - b, d - c, total - d]) AS n FROM (SELECT o_orderstatus AS _label, count(*) AS total, " + ", ".join(
    f"round_even((count(*) - 1) * {p}, 0)::BIGINT + 1 AS {n}" for p, n in ((0.2, "a"), (0.4, "b"), (0.6, "c"), (0.8, "d"))
) + " FROM orders GROUP BY 1))"


def m18(s, d):
    out = M.train_and_compare(lines(s, d), "l_extendedprice", "line_id", models=["Linear Regression"], cross_validation=False)
    return out.importance


_ROWS = "o_orderkey AS _key, CAST(o_custkey AS DOUBLE) AS a, CAST(o_orderkey % 7 AS DOUBLE) AS b, CAST(o_custkey AS DOUBLE) * 3 + o_orderkey % 7 AS y"


def m18_permutation(s, d):
    """How much a fixed rule for ``y`` loses when one of its two inputs is dealt anew."""
    def r2(df, keys):
        gap = F.col("y") - (F.col("a") * 3 + F.col("b"))
        return df.groupBy(*keys).agg((1 - F.avg(gap * gap) / F.var_pop("y")).alias("score"))

    return M.permutation_importance(table(s, d, "orders").selectExpr(*_ROWS.split(", ")), ["a", "b"], r2, repeats=2)


def _dealt_sql(feature: int, name: str, repeat: int) -> str:
    first, second, shift = M.multipliers(feature, repeat)
    other = "b" if name == "a" else "a"
    return f"""SELECT '{name}' AS feature, avg((j.y - (3 * v.a + v.b)) ^ 2) / var_pop(j.y) AS loss
    FROM t s JOIN t j ON j.i = (s.i::HUGEINT * (CASE WHEN s.n % {first} <> 0 THEN {first} ELSE {second} END % s.n) + {shift} % s.n) % s.n,
    LATERAL (SELECT s.{name} AS {name}, j.{other} AS {other}) AS v"""


M18_PERMUTATION = f"""
WITH t AS (SELECT {_ROWS}, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
 l AS ({" UNION ALL ".join(_dealt_sql(j, c, r) for j, c in enumerate("ab") for r in range(2))}),
 m AS (SELECT feature, avg(loss) AS raw FROM l GROUP BY feature)
SELECT feature, round(raw, 6) AS raw, round(raw / sum(abs(raw)) OVER (), 4) AS importance, 'permutation' AS method FROM m"""


def m19(s, d):
    docs = labelled(s, d)
    _, features = M.prepare(docs, "quality", "doc_id", drop=["toxic"])
    return M.feature_schema(docs, features).select("feature", "type", "min", "max", "median", F.array_join("options", ",").alias("options"))


M19 = f"WITH t AS ({DOCS}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, 'number' AS type, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(median({c})::DOUBLE, 6) AS median, NULL AS options FROM t"
    for c in ("n_chars", "words", "stops", "gappy")
) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{c}', 'category', NULL, NULL, NULL, string_agg({c}, ',' ORDER BY n DESC, {c}) FROM (SELECT {c}, count(*) AS n FROM t GROUP BY 1)" for c in ("lang", "source")
)


def m20(s, d):
    docs = labelled(s, d).withColumn("gappy", F.col("gappy").cast("double"))
    return M.example_row(docs, ["doc_id", "lang", "gappy"], "doc_id")


M20 = f"""WITH t AS (SELECT doc_id, lang, gappy::DOUBLE AS gappy, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM ({DOCS}) WHERE gappy IS NOT NULL)
SELECT doc_id, lang, gappy FROM t WHERE i = (SELECT count(*) // 2 FROM t)"""


def m21(s, d):
    docs = labelled(s, d)
    out = M.train_and_compare(docs, "quality", "doc_id", models=["Logistic Regression"], drop=["toxic"], cross_validation=False)
    rows, _ = M.prepare(docs, "quality", "doc_id", drop=["toxic"])
    return M.predict(out, rows.drop("_label")).select("_key", "prediction", "confidence")


QUERIES = {
    "M1_detect_task": (m1, M1),
    "M2_identifiers": (m2, "SELECT 'paid' AS \"column\", count(doc_id + 1) AS count, count(DISTINCT doc_id + 1) AS \"unique\" FROM labels"),
    "M3_features": (m3, M3), "M4_class_guard": (m4, M4), "M5_split": (m5, M5), "M6_numeric_scaling": (m6, M6), "M7_label_levels": (m7, M7),
    "M8_M9_M16_M17_compare_classes": (_train_class("Logistic Regression", "Decision Tree"), None),
    "M10_random_forest": (_train_class("Random Forest", cross_validation=False), None),
    "M11_knn_classifier": (m11, None),
    "M12_gradient_boosting": (_train_class("Gradient Boosting", cross_validation=False), None),
    "M9_M13_M17_compare_numbers": (_train_number("Linear Regression", "Ridge", "Lasso", "Decision Tree", cross_validation=False), None),
    "M14_confusion": (m14_confusion, f"SELECT l_returnflag AS label, {_RULE} AS predicted, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "M14_class_metrics": (m14, M14), "M14_roc_auc": (m14_auc, M14_AUC), "M15_regression_metrics": (m15, M15), "M16_stratified_folds": (m16, M16),
    "M18_importance": (m18, None), "M18_permutation": (m18_permutation, M18_PERMUTATION), "M19_feature_schema": (m19, M19), "M20_example_row": (m20, M20), "M21_predict": (m21, None),
}
