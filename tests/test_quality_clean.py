import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import advice, clean, neighbours, profile as P, quality as Q
from plumbline.operators.workbench import Workbench
from plumbline.sources import readers, writers
from plumbline.sources.demo import demo_dataset


def codes(spark, pdf):
    df = pdf if not isinstance(pdf, pd.DataFrame) else spark.createDataFrame(pdf)
    return {r["code"]: r for r in Q.analyze_quality(df).collect()}


def test_missing_levels(spark):
    df = spark.createDataFrame([(None if i < 3 else float(i), None, i) for i in range(10)], "a double, z string, b int")
    found = codes(spark, df)
    assert found["missing::a"]["severity"] == "medium" and found["missing::a"]["operation"] == "impute_missing"
    assert found["missing::z"]["severity"] == "high" and found["missing::z"]["operation"] == "drop_column"


def test_text_numbers_labels_outliers_constant_leak(spark):
    n = 24
    found = codes(spark, pd.DataFrame({
        "amount": ["1,000", "2,500"] * (n // 2), "country": ["India", "india", "INDIA", "USA"] * (n // 4), "v": [*range(n - 1), 5000],
        "c": ["same"] * n, "churn_probability": np.linspace(0, 1, n),
    }))
    assert found["dtype::numeric_string::amount"]["operation"] == "to_numeric"
    assert found["category::inconsistent::country"]["severity"] == "medium"
    assert found["outliers::v"]["evidence"]["iqr_outliers"] == "1"
    assert found["constant::c"]["operation"] == "drop_column" and "leakage::name::churn_probability" in found


def test_score_is_bounded_and_prefers_clean_data(spark):
    tidy = spark.range(100).select(F.col("id").alias("a"), (F.col("id") * 7 % 31).alias("b"))
    untidy = tidy.withColumn("b", F.when(F.col("a") > 30, F.col("b"))).unionByName(tidy.limit(20))
    one, two = (Q.overall_score(Q.analyze_quality(d)).first()["overall"] for d in (tidy, untidy))
    assert 0 <= two < one <= 100
    assert Q.overall_score(Q.analyze_quality(tidy)).first()["overall"] == one


def test_recommendations_and_cleaning_raise_the_score(spark):
    bench = Workbench(demo_dataset(spark), "_row_id")
    plain = bench.original.drop("_row_id")
    facts = P.column_facts(plain)
    recs = advice.recommend(Q.analyze_quality(plain, facts), facts)
    safe = [o for o in advice.as_operations(advice.safe_fixes(recs))]
    assert {"to_numeric", "standardize_categories"} <= {o["op"] for o in safe}
    bench.apply(safe)
    assert dict(bench.current.dtypes)["MonthlySalary"] == "double"
    scores = {r["stage"]: r["overall"] for r in bench.score_change().collect()}
    assert scores["after"] > scores["before"]


def test_standardize_takes_the_most_frequent_spelling(spark):
    df = spark.createDataFrame([(i, g) for i, g in enumerate(["Male", "male ", "MALE", "Male", "Female", "female"])], "k int, g string")
    out, record = clean.standardize_categories(df, "g", "k")
    assert {r["g"] for r in out.collect()} == {"Male", "Female"} and record["cells_changed"] == 3


def test_to_numeric_counts_failures(spark):
    df = spark.createDataFrame([("1,000",), ("2,500",), ("bad",), ("4,000",), ("5d",), (None,)], "amount string")
    out, record = clean.to_numeric(df, "amount")
    assert [r[0] for r in out.collect()] == [1000.0, 2500.0, None, 4000.0, None, None] and record["failed_conversions"] == 2


@pytest.mark.parametrize("strategy,rows,columns", [("remove", 12, 1), ("cap", 13, 1), ("flag", 13, 2), ("keep", 13, 1)])
def test_outlier_strategies(spark, strategy, rows, columns):
    df = spark.createDataFrame([(v,) for v in [*range(1, 13), 9000]], "v int")
    out, record = clean.handle_outliers(df, "v", strategy)
    assert (out.count(), len(out.columns), record["outliers"]) == (rows, columns, 1)
    if strategy == "cap":
        assert out.agg(F.max("v")).first()[0] < 30


def test_unknown_operation_and_absent_column(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError):
        clean.apply_operations(df, [{"op": "explode_everything"}])
    _, records = clean.apply_operations(df, [{"op": "trim_whitespace", "params": {"column": "b"}}])
    assert records[0]["skipped"]


def test_preview_changes_nothing_and_undo_restores(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i)) for i in range(40)], "k int, x double")
    bench = Workbench(df, "k")
    step = [{"op": "impute_missing", "params": {"column": "x", "strategy": "mean"}}]
    seen = bench.preview(step)
    assert seen["after"].first()["missing_cells"] == 0 and bench.current is df
    bench.apply(step)
    assert bench.current.filter("x IS NULL").count() == 0
    assert bench.undo() and bench.current is df and not bench.undo()


def test_knn_equals_brute_force_over_many_blocks(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": range(300), "a": rng.normal(size=300), "b": rng.normal(size=300), "t": rng.normal(size=300)})
    pdf.loc[::7, "t"] = np.nan
    pdf.loc[::11, "a"] = np.nan
    neighbours.QUERY_BLOCK, neighbours.DONOR_BLOCK, kept = 10, 40, (neighbours.QUERY_BLOCK, neighbours.DONOR_BLOCK)
    try:
        out, k = neighbours.knn_impute(spark.createDataFrame(pdf), "t", "k")
        got = {r["k"]: r["t"] for r in out.collect()}
    finally:
        neighbours.QUERY_BLOCK, neighbours.DONOR_BLOCK = kept
    donors = pdf[pdf.t.notna()]
    for _, row in pdf[pdf.t.isna()].iterrows():
        shared = donors[["a", "b"]].notna().to_numpy() & row[["a", "b"]].notna().to_numpy(dtype=bool)
        gaps = np.nan_to_num(donors[["a", "b"]].to_numpy() - row[["a", "b"]].to_numpy(dtype=float)) * shared
        d = np.sqrt((gaps ** 2).sum(axis=1) * 3 / np.where(shared.sum(axis=1) == 0, np.nan, shared.sum(axis=1)))
        best = donors.assign(d=d).dropna(subset=["d"]).sort_values(["d", "k"]).head(k)
        assert np.isclose(got[row.k], best.t.mean())


def test_readers_and_writers(spark, tmp_path):
    for text, sep in (("name,age,city\nA,1,x\nB,,y\n", ","), ("a;b;c\n1;2;3\n", ";"), ("a\tb\n1\t2\n", "\t"), ("value\n1\n2\n", ",")):
        path = tmp_path / f"f{abs(hash(text))}.csv"
        path.write_text(text)
        assert readers.sniff_delimiter(text.splitlines()[0]) == sep
        assert readers.read_csv(spark, str(path)).columns == text.splitlines()[0].split(sep)
    for text in ("a|b|c\n1|2|3\n", "name,age\n"):
        path = tmp_path / f"bad{len(text)}.csv"
        path.write_text(text)
        with pytest.raises(readers.BadUpload):
            readers.read_csv(spark, str(path), ",")
    with pytest.raises(readers.BadUpload):
        readers.from_records(spark, [], [])
    with pytest.raises(ValueError):
        readers.from_table(spark, "t; DROP TABLE x")
    df = spark.createDataFrame([(1, 'say "hi", now', None), (2, "plain", 2.5)], "k int, t string, x double")
    writers.write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"), schema=df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_demo_dataset_holds_its_defects(spark):
    df = demo_dataset(spark)
    assert df.count() == 610 and df.drop("_row_id").distinct().count() == 600
    assert df.filter("Age IS NULL").count() > 10 and {r[0] for r in df.select("Attrition").distinct().collect()} == {"Yes", "No"}
    assert df.filter(F.col("MonthlySalary").contains(",")).count() > 500


def test_labels_of_many_levels_are_checked(spark):
    df = spark.range(3000).selectExpr("concat(CASE WHEN id % 2 = 0 THEN 'Level ' ELSE 'level ' END, cast(id % 300 DIV 2 AS STRING)) AS label")
    issues = Q.label_issues(df, P.column_facts(df)).collect()
    assert [(i["code"], i["evidence"]["raw_level_count"], i["evidence"]["canonical_level_count"]) for i in issues] == [
        ("category::inconsistent::label", "300", "150")]


def test_quoted_line_breaks_are_read_back(spark, tmp_path):
    from plumbline.sources import readers, writers

    df = spark.createDataFrame([(1, "two\nlines"), (2, "plain")], "a long, b string")
    writers.write_csv(df, str(tmp_path / "out"))
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "out")).collect())) == [(1, "two\nlines"), (2, "plain")]
