"""Small literal tables with results worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from prepwright.catalog import tables
from prepwright.functions import text as words
from prepwright.functions.numbers import parse_number, parse_timestamp
from prepwright.models import training
from prepwright.operators import casting, columns, dedupe, encode, features, impute, profile, quality, rules
from prepwright.plans import flows
from prepwright.sinks import writers
from prepwright.sources import readers


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def messages(df):
    return " ".join(r["message"] for r in df.collect()).lower()


def test_overview_shape(spark):
    df = spark.createDataFrame([(1,), (2,)], "a long")
    got = profile.overview(df).first()
    assert (got["n_rows"], got["n_cols"], got["missing_cells"]) == (2, 1, 0)
    assert [tuple(r) for r in profile.shape_and_types(df).collect()] == [("a", "numeric", 2, 1)]


def test_mean_fill_and_exact_dedupe(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "a double")
    assert rows(impute.impute(df, "mean")) == [(1.0,), (2.0,), (3.0,)]
    assert dedupe.drop_exact(spark.createDataFrame([(1,), (1,), (2,)], "a long")).count() == 2


def test_nan_and_null_are_both_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (4.0,)], "a double")
    assert profile.missing_summary(df).first()["missing_count"] == 2
    assert sorted(r[0] for r in impute.impute(df, "median").collect()) == [1.0, 2.5, 2.5, 4.0]
    assert columns.drop_missing(df).count() == 2


def test_all_missing_column_is_left_alone(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "a double, b string")
    for how in ("mean", "median", "mode"):
        assert rows(impute.impute(df, how)) == [(None, None), (None, None)]


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([("y",), ("x",), ("y",), ("x",), (None,)], "a string")
    assert [r[0] for r in impute.impute(df, "mode").collect()].count("x") == 3


def test_unknown_fill_method(spark):
    with pytest.raises(ValueError):
        impute.impute(spark.createDataFrame([(1,)], "a long"), "nearest")


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, b string")
    assert casting.fix_types(df).dtypes == df.dtypes
    got = quality.diagnose(df).first()
    assert (got["n_rows"], got["missing_ratio"], got["duplicate_ratio"]) == (0, 0.0, 0.0)
    assert quality.quality_score(df).first()["score"] == 100.0
    assert [r["code"] for r in rules.simple_insights(df).collect()] == ["empty"]
    assert profile.describe(df).first()["q50"] is None


def test_number_texts(spark):
    df = spark.createDataFrame([(t,) for t in ("1d", "0x10", "1,000", " 12 ", "1e3", "", "-.5")], "t string")
    got = [r[0] for r in df.select(parse_number(F.col("t"))).collect()]
    assert got == [None, None, None, 12.0, 1000.0, None, -0.5]


def test_date_texts(spark):
    df = spark.createDataFrame([(t,) for t in ("2024-02-03", "2024/02/03", "02/03/2024", "2024-02-30", "x")], "t string")
    got = [r[0] and r[0].strftime("%Y%m%d") for r in df.select(parse_timestamp(F.col("t"))).collect()]
    assert got == ["20240203", "20240203", "20240203", None, None]


def test_type_fix_counts_missing_against_the_column(spark):
    good = spark.createDataFrame([(str(i), str(i) if i else None) for i in range(10)], "a string, b string")
    assert dict(casting.fix_types(good).dtypes) == {"a": "double", "b": "double"}
    gappy = spark.createDataFrame([("1",)] * 8 + [(None,)] * 2, "a string")
    assert casting.fix_types(gappy).dtypes == [("a", "string")]


def test_conversion_targets(spark):
    df = spark.createDataFrame([("1",)], "a string")
    with pytest.raises(ValueError):
        casting.convert_column(df, "a", "complex")
    assert casting.convert_column(df, "zz", "complex") is df
    assert casting.convert_types(df, {"a": "complex"}).dtypes == df.dtypes


def test_standardized_text(spark):
    df = spark.createDataFrame([("  Ünï-Cödé! x_1 ",), (None,)], "t string")
    assert [r[0] for r in df.select(words.standardize(F.col("t"))).collect()] == ["ünïcödé x_1", None]


def test_html_scripts_are_removed(spark):
    html = "<html><script>var a='<b>';</script><style>p{}</style><p> A &amp;lt; B </p>\n\n<p>&quot;C&quot;</p></html>"
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(words.html_to_text(F.col("h"))).first()[0] == 'A &lt; B\n"C"'


def test_adjusted_skew_and_constant(spark):
    df = spark.createDataFrame([(float(v), 7.0) for v in (1, 2, 2, 5, 100)], "a double, b double")
    got = {r["column"]: r["skew"] for r in profile.skewness(df).collect()}
    assert math.isclose(got["a"], 2.2295231521, rel_tol=1e-9) and got["b"] == 0.0


def test_histogram_bins(spark):
    df = spark.createDataFrame([(float(v), 3.0) for v in (1, 2, 2, 5, 100)], "a double, b double")
    got = {(r["column"], r["bin"]): r["n"] for r in profile.histogram(df, 4).collect()}
    assert [got[("a", b)] for b in range(1, 5)] == [4, 0, 0, 1]
    assert sum(got[("b", b)] for b in range(1, 5)) == 5


def test_not_equal_keeps_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "t string")
    assert columns.filter_rows(df, "t", "!=", "a").count() == 2
    assert columns.filter_rows(df, "t", "contains", "^a").count() == 1
    with pytest.raises(ValueError):
        columns.filter_rows(df, "t", "~", "a")
    with pytest.raises(ValueError):
        columns.filter_rows(df, "zz", "==", "a")


def test_outlier_rows_of_a_constant(spark):
    df = spark.createDataFrame([(5.0,)] * 4, "a double")
    assert columns.zscore_outlier_rows(df, "a").count() == 0
    assert columns.iqr_outlier_rows(df, "a").count() == 0


def test_values_swap_in_one_pass(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "t string")
    assert rows(columns.map_values(df, {"t": {"a": "b", "b": "a"}})) == rows(
        spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "t string"))
    big = {f"k{i}": f"v{i}" for i in range(300)}
    many = spark.createDataFrame([(k,) for k in big] + [("other",)], "t string")
    assert {r[0] for r in columns.map_values(many, {"t": big}).collect()} == {*big.values(), "other"}


def test_correlation_with_gaps_and_constants(spark):
    data = [(1.0, 2.0, 5.0, None), (2.0, 4.0, 5.0, 1.0), (3.0, None, 5.0, 1.0), (4.0, 8.0, 5.0, 1.0)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in profile.correlations(df).collect()}
    assert math.isclose(got[("a", "b")], 1.0) and got[("a", "c")] is None and got[("c", "d")] is None


def test_regression_on_constant_x(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double")
    got = profile.regression(df, "x", "y").first()
    assert (got["slope"], got["intercept"], got["mse"]) == (0.0, 3.0, 1.0)


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 2, 9.0), ("a", 1, 5.0), ("b", 3, None)], "k string, o long, v double")
    assert rows(dedupe.keep_first(df, ["k"], ["o"])) == [("a", 1, 5.0), ("b", 3, None)]


def test_codes(spark):
    df = spark.createDataFrame([(1, "z"), (2, "a"), (3, "z"), (4, None)], "o long, t string")
    assert [r["t_code"] for r in encode.label_codes(df, "t", "o").orderBy("o").collect()] == [0, 1, 0, -1]
    assert [r["t_code"] for r in encode.sorted_codes(df, "t").orderBy("o").collect()] == [1, 0, 1, -1]


def test_one_hot_missing_is_false_everywhere(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "t string")
    out = encode.one_hot(df)
    assert out.columns == ["t_a", "t_b"] and (False, False) in rows(out)
    sparse = encode.one_hot(df, sparse=["t"])
    assert sorted(map(str, (r["t"].asDict() for r in sparse.collect()))) == [
        "{'size': 2, 'index': 0}", "{'size': 2, 'index': 1}", "{'size': 2, 'index': None}"]


def test_scaling_of_constants(spark):
    df = spark.createDataFrame([(0.1, 1.0), (0.1, 3.0), (None, None)], "a double, b double")
    assert rows(encode.standard_scale(df)) == rows(
        spark.createDataFrame([(0.0, -1.0), (0.0, 1.0), (None, None)], "a double, b double"))
    assert sorted(r["a"] for r in encode.minmax_scale(df).collect()) == [0.0, 0.0, 0.0]


def test_low_variance(spark):
    df = spark.createDataFrame([(0.1, 1.0, "x")] * 3 + [(0.1, 2.0, "y")], "a double, b double, t string")
    out, dropped = encode.drop_low_variance(df)
    assert out.columns == ["t", "b"] and dropped == ["a"]
    with pytest.raises(ValueError):
        encode.drop_low_variance(df.select("a"))


def test_logs_need_every_row_positive(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.0), (2.0, None, 1.0)], "a double, b double, c double")
    assert features.log_features(df).columns == ["a", "b", "c", "a_log"]


def test_group_mean_of_missing_key(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "k string, v double")
    assert rows(features.group_means(df)) == rows(spark.createDataFrame(
        [("a", 1.0, 2.0), ("a", 3.0, 2.0), (None, 5.0, None)], "k string, v double, m double"))


def test_quality_score_bounds(spark):
    df = spark.createDataFrame([(1, "A"), (2, "a"), (2, "A"), (100, "B")], "num long, cat string")
    got = quality.quality_score(df).first()
    assert 0 <= got["score"] <= 100 and got["inconsistent_categories"] == 20.0 and got["outliers"] == 25.0


def test_diagnosis_and_issues(spark):
    df = spark.createDataFrame([(1.0, 1, 0), (None, 2, 0), (3.0, 3, 1), (3.0, 3, 1)], "a double, b long, target long")
    parts = flows.diagnosis(df, "target")
    assert parts["diagnosis"].first()["n_rows"] == 4
    assert {"missing", "duplicate", "correlation"} <= {r["issue"] for r in parts["issues"].collect()}
    assert [r["step"] for r in rules.adaptive_steps(parts["issues"]).collect()][-2:] == ["encode", "scale"]


def test_complexity_formula(spark):
    row = spark.createDataFrame([(0.2, 20, 0.9, 0.3)],
                                "missing_ratio double, n_cols long, correlation_max double, target_balance double")
    assert tuple(quality.complexity(row).first()) == (6.65, "Medium Complexity")


def test_task_inference(spark):
    few = spark.createDataFrame([(v,) for v in (0, 1, 0, 1, 2, 1, 0)], "t long")
    many = spark.createDataFrame([(v,) for v in range(30)], "t long")
    assert quality.infer_task(few, "t") == "classification" and quality.infer_task(many, "t") == "regression"


def test_insights(spark):
    df = spark.createDataFrame([(1.0, 10, 10), (2.0, 20, 20), (None, 30, 30), (4.0, 40, 40), (None, 50, 50)],
                               "a double, b long, c long")
    said = messages(rules.data_insights(df))
    assert "missing values" in said and "highly correlated" in said
    five = spark.createDataFrame([tuple(k * i for k in range(1, 6)) for i in range(1, 6)],
                                 "a long, b long, c long, d long, e long")
    capped = rules.data_insights(five, max_pairs=2)
    assert "additional high-correlation pairs" in messages(capped)
    assert capped.where("code = 'correlated'").count() == 2


def test_preparation_hints(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, "z")], "a double, b string")
    assert "missing values" in messages(rules.suggest_preparation(df))
    with pytest.raises(ValueError):
        rules.suggest_preparation(df, "zz")


def test_model_selection(spark):
    df = spark.createDataFrame([(i, i, 2 - i % 2, int(i > 3)) for i in range(1, 9)], "id long, x1 long, x2 long, target long")
    scores, model, prepared = training.select_model(df, "target", "id", trees=3, depth=2, boosts=2)
    assert scores.count() == 3 and isinstance(scores.first()["model"], str)
    with pytest.raises(ValueError, match="At least 5 rows"):
        training.select_model(df.limit(4), "target", "id")


def test_csv_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text("i,f,b,d,t,g\n1,1.5,True,2024-01-01,x,1\n2,NA,False,2024-01-02,\"a,\"\"b\",\n")
    df = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "d": "string", "t": "string", "g": "double"}
    assert {r["t"] for r in df.collect()} == {"x", 'a,"b'}


def test_upload_checks(spark, tmp_path):
    for name in ("a.csv", "b.txt", "plain"):
        (tmp_path / name).write_text("x\n1\n")
    got = {r["path"].rsplit("/", 1)[1]: (r["is_valid"], r["reason"]) for r in
           readers.validate_files(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": (True, ""), "b.txt": (False, "extension"),
                   "plain": (False, "no_extension")}
    assert not readers.validate_files(spark, str(tmp_path / "a.csv"), max_mb=0).first()["is_valid"]


def test_push_batches_split_copies(spark):
    df = spark.createDataFrame([(1, None)] * 95, "a long, b string").repartition(3)
    out = writers.push_batches(df, 10).collect()
    assert max(r["n"] for r in out) <= 10 and sum(r["n"] for r in out) == 95
    assert json.loads(out[0]["payload"])["rows"][0] == {"a": 1, "b": None}


def test_fingerprint_ignores_layout(spark):
    df = spark.range(100).selectExpr("id", "id % 7 as v")
    a = readers.table_fingerprint(df).first()
    assert a == readers.table_fingerprint(df.repartition(5, "v")).first()
    assert a != readers.table_fingerprint(df.where("id > 0")).first()


def test_payloads_are_read_before_their_rows_part(spark, tmp_path):
    spark.createDataFrame([(i, i % 3, "O", i * 1.5, None, "1-URGENT") for i in range(1200)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
                          ).write.parquet(str(tmp_path / "orders.parquet"))
    out = tables.snk_push_batches(spark, str(tmp_path))
    assert out.count() == 1200 and out.where("not bounded").isEmpty()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan[:plan.index("Generate")]
