"""Distributed algorithms against brute force, with and without their large-data paths."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepwright.functions.indel import lcs_lengths, similarities
from prepwright.models import bayes, explain, training
from prepwright.operators import dedupe, fuzzy, quantiles, sampling


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def variants(seed, bases, copies, longest=25):
    """Texts in groups of near copies."""
    draw, out = random.Random(seed), {}
    for _ in range(bases):
        base = [draw.choice("abcdefgh ") for _ in range(draw.randint(1, longest))]
        for _ in range(copies):
            text = list(base)
            for _ in range(draw.randint(0, 3)):
                text.insert(draw.randrange(len(text) + 1), draw.choice("abcXYZ"))
            out["".join(text)] = None
    return list(out)


def similarity(a, b):
    return float(similarities([a], [b])[0])


def greedy(texts, threshold, strict):
    leaders, led = [], {}
    for i, t in enumerate(texts):
        scores = ((u, similarity(texts[u], t)) for u in leaders)
        led[i] = next((u for u, s in scores if (s > threshold if strict else s >= threshold)), i)
        if led[i] == i:
            leaders.append(i)
    return led


def nodes_of(spark, texts):
    return spark.createDataFrame([(i, "g", t) for i, t in enumerate(texts)], "node long, grp string, txt string")


def test_lcs_and_ratio():
    draw = random.Random(3)
    for _ in range(500):
        a, b = ("".join(draw.choice("abcd") for _ in range(draw.randint(0, 12))) for _ in "xy")
        assert lcs_lengths([a], [b])[0] == slow_lcs(a, b)
    assert similarity("fast nuces", "fast-nuces") == 90.0 and similarity("abcd", "bcda") == 75.0
    assert similarity("", "") == 100.0


@pytest.mark.parametrize("threshold", [30, 70, 85, 95])
def test_similar_pairs_lose_nothing(spark, threshold):
    texts = ["", *variants(threshold, 30, 4)]
    got = {(r["u"], r["v"]) for r in fuzzy.similar_pairs(nodes_of(spark, texts), threshold).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(texts)), 2)
                   if similarity(texts[i], texts[j]) >= threshold}


def test_similar_pairs_with_hot_pieces(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "COMPARISONS_PER_TASK", 500)
    texts = [f"Customer#{i:06d}" for i in range(0, 3000, 17)]
    got = {(r["u"], r["v"]) for r in fuzzy.similar_pairs(nodes_of(spark, texts), 90).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(texts)), 2)
                   if similarity(texts[i], texts[j]) >= 90}


def test_threshold_bounds(spark):
    for threshold in (0, 100.5):
        with pytest.raises(ValueError):
            fuzzy.similar_pairs(nodes_of(spark, ["a"]), threshold)


@pytest.mark.parametrize("first_prefix", [5000, 40])
@pytest.mark.parametrize("strict", [True, False])
def test_greedy_leaders_equal_the_sequential_scan(spark, first_prefix, strict):
    texts = variants(11, 25, 6)
    random.Random(5).shuffle(texts)
    led = fuzzy.greedy_leaders(nodes_of(spark, texts), 85, strict, first_prefix)
    assert {r["node"]: r["leader"] for r in led.collect()} == greedy(texts, 85, strict)


def test_greedy_chain(spark):
    # Each text resembles its neighbours only, so every other one is kept.
    texts = ["".join("b" if j < 2 * i else "a" for j in range(40)) for i in range(12)]
    led = {r["node"]: r["leader"] for r in fuzzy.greedy_leaders(nodes_of(spark, texts), 95).collect()}
    assert led == greedy(texts, 95, False)


def test_fuzzy_groups_and_corrections(spark):
    values = ["FAST NUCES", "Fast Nuces", " FAST-NUCES ", "OTHER", None, "  "]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v string")
    groups = fuzzy.fuzzy_groups(df, ["v"], 80, ["id"]).collect()
    assert [(r["original"], r["suggested"]) for r in groups] == [
        (["FAST NUCES", "FAST-NUCES", "Fast Nuces"], "FAST-NUCES")]
    fixed = fuzzy.apply_groups(df, "v", fuzzy.group_members(df, ["v"], 80, ["id"])).orderBy("id")
    assert [r["v"] for r in fixed.collect()] == ["FAST-NUCES"] * 3 + ["OTHER", None, "  "]


def test_normal_forms(spark):
    df = spark.createDataFrame([(0, "Fast Nuces"), (1, "FAST-NUCES"), (2, "fast_nuces")], "id long, v string")
    got = {r["original"]: r["canonical"] for r in fuzzy.normalize_map(df, "v", order_by=["id"]).collect()}
    assert got == {"Fast Nuces": "FAST NUCES", "FAST-NUCES": "FAST NUCES", "fast_nuces": "FAST NUCES"}


def test_fuzzy_rows_use_whole_long_texts(spark):
    draw = random.Random(2)
    long = "".join(draw.choice("abcdefghij ") for _ in range(3000))
    rows = [(0, long), (1, long[:-20] + "Z" * 20), (2, long[::-1]), (3, long + " tail")]
    df = spark.createDataFrame(rows, "id long, t string")
    assert sorted(r["id"] for r in fuzzy.drop_fuzzy_rows(df, ["id"], 95, ["t"]).collect()) == [0, 2]


@pytest.mark.parametrize("limit", [10**9, 500, 3])
def test_quantiles_are_exact(spark, limit):
    draw = random.Random(8)
    data = [(draw.lognormvariate(0, 3), float(draw.randint(0, 3)), None if draw.random() < .3 else -draw.random())
            for _ in range(4000)] + [(float("inf"), 1e300, -1e300)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99]
    got = quantiles.fit_quantiles(df, {c: (F.col(c), ps) for c in "abc"}, limit)
    for i, c in enumerate("abc"):
        want = np.quantile([r[i] for r in data if r[i] is not None], ps)
        assert np.allclose(got[c], want, rtol=1e-12), c


def test_quantiles_read_the_table_twice(spark, monkeypatch):
    draw = random.Random(3)
    data = [(float(draw.choice([1e300, 1e-300, -1e-300, 5.0])) * draw.choice([1, 1, draw.random()]), float(i % 2)) for i in range(60_000)]
    df = spark.createDataFrame(data, "a double, b double").repartition(6)
    reads = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: (reads.add(1), x)[1], "double").asNondeterministic()
    ps = [0.1, 0.25, 0.5, 0.75, 0.9]
    got = quantiles.fit_quantiles(df.select(seen("a").alias("a"), "b"), {c: (F.col(c), ps) for c in "ab"}, 40)
    assert reads.value == 2 * len(data)
    for i, c in enumerate("ab"):
        assert np.allclose(got[c], np.quantile([r[i] for r in data], ps), rtol=1e-12), c


@pytest.mark.parametrize("limit", [1_000, 3])
def test_quantiles_are_exact_if_brackets_miss(spark, monkeypatch, limit):
    df = spark.range(20_000).selectExpr("cast(pmod(id * 7919, 20011) as double) as a")
    monkeypatch.setattr(quantiles, "_apart", lambda spans: [(hi, hi) for _, hi in sorted(spans)])
    want = np.quantile([r["a"] for r in df.collect()], [0.3, 0.6])
    assert np.allclose(quantiles.fit_quantiles(df, {"a": (F.col("a"), [0.3, 0.6])}, limit)["a"], want, rtol=1e-12)


def test_sample_and_split_sizes(spark):
    df = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 11 as string)) as y")
    small = {r["id"] for r in sampling.sample(df, 700, "id").collect()}
    assert len(small) == 700 and small == {r["id"] for r in sampling.sample(df.repartition(7), 700, "id").collect()}
    assert sampling.sample(df, 9999, "id").count() == 5000 and sampling.sample(df, 0, "id").count() == 5000
    split = sampling.stratified_split(df, "y", "id")
    for r in split.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("k")).collect():
        assert r["k"] == math.ceil(round(0.2 * r["n"], 9))
    again = sampling.stratified_split(df.repartition(5, "y"), "y", "id")
    assert split.where("is_test").exceptAll(again.where("is_test")).isEmpty()


def test_hot_key_keep_first_combines_before_the_shuffle(spark):
    df = spark.range(20000).selectExpr("if(id % 3 = 0, 0, id) as k", "id", "id * 2 as v")
    out = dedupe.keep_first(df, ["k"], ["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan
    assert out.where("k = 0").first()["id"] == 0


def test_bayesian_ridge_matches_ridge_normal_equations(spark):
    df = spark.range(400).selectExpr("id as key", "rand(1) as a", "rand(2) as b").selectExpr(
        "key", "a", "b", "3 * a - 2 * b + 1 + 0.01 * randn(3) as y")
    prepared = training.prepare(df, "y", "key")
    model = bayes.BayesianRidge().fit(prepared.train)
    x = np.array([r[0].toArray() for r in prepared.train.select("features").collect()])
    y = np.array([r[0] for r in prepared.train.select("label").collect()])
    least, *_ = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)
    assert np.allclose(model.weights, least[:2], atol=1e-3) and abs(model.intercept - least[2]) < 1e-3
    assert 0.005 < 1 / math.sqrt(model.noise) < 0.02
    inside = bayes.prediction_interval(prepared.train, prepared.test).join(prepared.test, "key").selectExpr(
        "avg(cast(label between lower_95 and upper_95 as double))").first()[0]
    assert inside > 0.85


def test_shapley_values_add_up(spark):
    df = spark.range(200).selectExpr("id as key", "rand(1) as a", "rand(2) as b").selectExpr("key", "a", "b", "a * b as y")
    _, model, prepared = training.train_one(df, "y", "key", "Random Forest", trees=5, depth=4)
    rows = sampling.first_rows(prepared.test, 4, ["key"])
    total = explain.model_contributions(model, rows, prepared).groupBy("key").agg(
        (F.sum("contribution") + F.max("base_value")).alias("total"))
    for r in total.join(model.transform(rows), "key").collect():
        assert math.isclose(r["total"], r["prediction"], abs_tol=1e-9)


def test_linear_contributions_are_exact(spark):
    df = spark.createDataFrame([(1.0, 10.0), (3.0, 30.0)], "a double, b double")
    got = {r["feature"]: r["importance"] for r in explain.linear_importance(df, {"a": 2.0, "b": -1.0}).collect()}
    assert got == {"a": 2.0, "b": 10.0}
