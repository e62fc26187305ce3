"""Cases that the given tables do not hold: large whole numbers, NaN beside NULL, free dates, references, low thresholds."""

import random
from datetime import datetime
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepwright.functions import indel, numbers, text
from prepwright.models import evaluate
from prepwright.operators import columns, dedupe, features, fuzzy, profile, quantiles

LARGE = 9007199254740993


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(
        [(LARGE, 1.0, Decimal("1.10"), "a"), (LARGE - 1, float("nan"), Decimal("2.20"), "b"), (None, None, None, None),
         (5, 7.0, Decimal("3.30"), "c")], "id bigint, x double, d decimal(10,2), s string")


@pytest.mark.parametrize("column,sign,value,kept", [
    ("id", "==", str(LARGE), "a"), ("id", "!=", str(LARGE), "bcN"), ("id", ">", "5.5", "ab"), ("id", "<=", "5.5", "c"),
    ("id", "<", "1e30", "abc"), ("id", ">", "1e30", ""), ("id", "==", "5.5", ""), ("id", "!=", "5.5", "abcN"), ("id", ">=", "5.0", "abc"),
    ("x", ">", "0", "ac"), ("x", ">=", "1", "ac"), ("x", "!=", "1", "bcN"), ("x", "<", "9", "ac"), ("x", "==", "nan", ""),
    ("d", "==", "2.2", "b"), ("d", ">", "1.1", "bc"), ("s", "!=", "a", "bcN"), ("s", "<", "b", "a")])
def test_filters(mixed, column, sign, value, kept):
    found = columns.filter_rows(mixed, column, sign, value).collect()
    assert "".join(sorted((r["s"] or "N" for r in found), key=str.swapcase)) == kept


def test_filter_errors(mixed):
    for column, sign, value in (("id", "==", "five"), ("id", "~", "5"), ("none", "==", "5")):
        with pytest.raises(ValueError):
            columns.filter_rows(mixed, column, sign, value)


def test_whole_number_filters_are_pushed_down(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    plan = columns.filter_rows(spark.read.parquet(path), "id", ">", "5")._jdf.queryExecution().toString()
    assert "GreaterThan(id,5)" in plan


def test_maps(mixed):
    def mapped(pairs, column):
        return {r["s"]: r[column] for r in columns.map_values(mixed, {column: pairs}).collect()}
    assert mapped({5: "five", LARGE: None, "5": "no"}, "id") == {"a": None, "b": str(LARGE - 1), None: None, "c": "five"}
    assert mapped({5: 6.5, 1: 2}, "id")["c"] == 6.5
    assert mapped({i: i + 1 for i in range(500)}, "id")["c"] == 6
    assert mapped({1: 9, 7.0: 3.5}, "x")["a"] == 9.0 and mapped({1: 9, 7.0: 3.5}, "x")["c"] == 3.5
    assert {r["s"] for r in columns.map_values(mixed, {"s": {"a": None, "c": "z"}}).collect()} == {None, "b", "z"}


def test_nan_is_missing(spark):
    assert dedupe.drop_exact(spark.createDataFrame([(1, float("nan")), (1, None)], "a int, x double")).count() == 1
    group = spark.createDataFrame([("k", 1.0), ("k", float("nan")), ("k", 3.0)], "k string, x double")
    assert {r["k_x_grpmean"] for r in features.group_means(group).collect()} == {2.0}
    assert [r["x_z"] for r in features.zscore_features(group).orderBy("x").collect()][1:] == pytest.approx([-0.7071, 0.7071], abs=1e-4)
    assert features.log_features(group).columns == ["k", "x"]


def test_whole_numbers_are_counted_exactly(spark):
    df = spark.createDataFrame([(LARGE,), (LARGE - 1,), (LARGE + 1,)], "id bigint")
    assert profile.distinct_counts(df).first()["n_distinct"] == 3 and profile.fit_modes(df, ["id"]) == {"id": LARGE - 1}
    assert profile.profile(df).first()["is_unique"]
    assert profile.duplicate_counts(spark.createDataFrame([(1, None), (None, 1), (1, None)], "a int, b int")).first()["duplicate_rows"] == 1


def test_dates(spark):
    wanted = {
        "2024-01-02T03:04:05Z": datetime(2024, 1, 2, 3, 4, 5), "2024-01-02 03:04:05.123": datetime(2024, 1, 2, 3, 4, 5, 123000),
        "1/5/2024": datetime(2024, 1, 5), "Jan 5, 2024": datetime(2024, 1, 5), "05-Jan-2024": datetime(2024, 1, 5),
        "20240105": datetime(2024, 1, 5), "2024-01-02 03:04": datetime(2024, 1, 2, 3, 4), "2024/1/2": datetime(2024, 1, 2),
        "Friday, 5 January 2024 10:11:12 +02:00": datetime(2024, 1, 5, 8, 11, 12), "2024-01-02T03:04:05+0530": datetime(2024, 1, 1, 21, 34, 5),
        "2024-02-30": None, "13/13/2024": None, "2024-01-02 25:00": None, "soon": None, "": None, "12": None}
    df = spark.createDataFrame([(k,) for k in wanted], "s string")
    assert {r["s"]: r["t"] for r in df.select("s", numbers.parse_timestamp(F.col("s")).alias("t")).collect()} == wanted


def test_character_references_and_lines(spark):
    df = spark.createDataFrame([("<p>caf&eacute; &#8217;x&#x2019; &euro;5</p>\x0bnext\x85line&nbsp;&amp;lt;",), (None,), ("plain",)], "h string")
    assert [r[0] for r in df.select(text.html_to_text(F.col("h"))).collect()] == ["café ’x’ €5\nnext\nline\xa0&lt;", None, "plain"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            up = row[j]
            row[j] = left + 1 if x == y else max(row[j], row[j - 1])
            left = up
    return row[-1]


def test_batched_similarity():
    rng = random.Random(1)
    a = ["".join(rng.choice("abcé漢😀 ") for _ in range(rng.choice([0, 1, 5, 30, 63, 64, 65, 128, 129, 300]))) for _ in range(250)]
    b = ["".join(c for c in x if rng.random() < 0.9) + rng.choice(["", "zz"]) for x in a]
    assert indel.lcs_lengths(a, b).tolist() == [lcs(x, y) for x, y in zip(a, b)]
    assert np.isnan(indel.similarities([None], ["a"])[0]) and indel.similarities([""], [""])[0] == 100.0


@pytest.mark.parametrize("threshold", [5, 40, 60, 66, 67, 80, 100])
def test_similar_pairs_are_complete_at_any_threshold(spark, threshold, monkeypatch):
    monkeypatch.setattr(fuzzy, "COMPARISONS_PER_TASK", 40)
    rng = random.Random(threshold)
    texts = sorted({"".join(rng.choice("abcde ") for _ in range(rng.randint(0, 9))) for _ in range(60)} | {"x" * 450, "x" * 440 + "y"})
    nodes = spark.createDataFrame([(i, "g", t) for i, t in enumerate(texts)], "node long, grp string, txt string")
    found = {(r["u"], r["v"]) for r in fuzzy.similar_pairs(nodes, threshold).collect()}
    assert found == {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts)
                     if i < j and 200 * lcs(x, y) >= threshold * (len(x) + len(y)) - 1e-9 and len(x) + len(y)}


def test_groups_are_sorted_whole_unless_large(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("hot" if i % 4 == 0 else f"g{i % 150}", rng.choice([rng.gauss(0, 1), float(rng.randint(0, 5))])) for i in range(2_000)]
    df = spark.createDataFrame(rows, "k string, v double")
    ps, met = [0.0, 0.25, 0.5, 0.9], []
    by_bins = quantiles._large_group_quantiles
    monkeypatch.setattr(quantiles, "WHOLE_GROUP", 100)
    monkeypatch.setattr(quantiles, "_large_group_quantiles", lambda rows, sizes, ps: met.extend(r["g"] for r in sizes.collect()) or by_bins(rows, sizes, ps))
    found = {r["k"]: r["q"] for r in quantiles.group_quantiles(df, "k", "v", ps).collect()}
    assert met == ["hot"] and len(found) == len({k for k, _ in rows})
    assert all(q == pytest.approx(np.quantile([v for k, v in rows if k == g], ps)) for g, q in found.items())


def test_quantiles_by_group(spark):
    rng = random.Random(1)
    rows = [(f"g{i % 300}" if i % 3 else "hot", rng.choice([rng.gauss(0, 1), float(rng.randint(0, 5)), 1e12 * rng.random()])) for i in range(6_000)]
    rows += [("none", None), ("one", 4.0)]
    found = {r["g"]: r["q"] for r in quantiles.group_quantiles(spark.createDataFrame(rows, "g string, y double"), "g", "y", [0.25, 0.5, 1.0]).collect()}
    groups = {g for g, y in rows if y is not None}
    assert set(found) == groups
    for g in groups:
        assert np.allclose(found[g], np.quantile([y for k, y in rows if k == g], [0.25, 0.5, 1.0]), rtol=1e-12)


def test_confusion_has_every_pair(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", None)], "x string, y string")
    found = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion(df, "x", "y").collect()}
    assert found == {(x, y): int((x, y) in {("a", "b"), ("a", "a")}) for x in "abc" for y in "abc"}


def test_pair_sums_with_gaps(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) + [0, 1e6, -3, 5]
    x[rng.random(x.shape) < 0.2] = np.nan
    df = spark.createDataFrame([tuple(float(v) for v in row) for row in x], "a double, b double, c double, d double").repartition(5)
    for r in profile.correlations(df).collect():
        i, j = "abcd".index(r["col_a"]), "abcd".index(r["col_b"])
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert r["corr"] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
