import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from prepwright.models import explain, softmax, training, trees
from prepwright.operators import encode


def _table(spark, n=240, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.uniform(0, 10), rng.randint(0, 3), rng.choice(["x", "y", "z"])
        rows.append((i, a, b, c, a * (b + 1) + {"x": 0, "y": 5, "z": 9}[c] + rng.gauss(0, 0.1), "low" if a < 3 else "mid" if a + b < 8 else "high", int(a > b + 3)))
    return spark.createDataFrame(rows, "key long, a double, b int, c string, y double, three string, two int")


def _expected(tree, x):
    """Value of a tree for a row in which only ``known`` features count, weighted by shares, leaf by leaf."""
    def value(known):
        total = np.zeros(tree.value.shape[1])
        for leaf in range(len(tree.value)):
            factor = 1.0
            for place in range(tree.feature.shape[1]):
                f = tree.feature[leaf, place]
                if np.isinf(tree.low[leaf, place]) and np.isinf(tree.high[leaf, place]) and tree.share[leaf, place] == 1:
                    continue
                factor *= float(tree.low[leaf, place] < x[f] <= tree.high[leaf, place]) if f in known else tree.share[leaf, place]
            total = total + factor * tree.value[leaf]
        return total
    return value


def _brute(tree, x, n):
    value, out = _expected(tree, x), np.zeros((n, tree.value.shape[1]))
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for size in range(n):
            weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            for s in combinations(rest, size):
                out[i] += weight * (value({*s, i}) - value(set(s)))
    return out


@pytest.mark.parametrize("kind", ["forest", "boost", "classes", "binary", "margin"])
def test_tree_attributions_are_exact(spark, kind):
    df = _table(spark)
    target = {"forest": "y", "boost": "y", "classes": "three", "binary": "two", "margin": "two"}[kind]
    prepared = training.prepare(df.select("key", "a", "b", "c", target), target, "key")
    model = {"forest": RandomForestRegressor(numTrees=4, maxDepth=4, seed=1), "boost": GBTRegressor(maxIter=4, maxDepth=3, seed=1),
             "classes": RandomForestClassifier(numTrees=3, maxDepth=4, seed=1), "binary": RandomForestClassifier(numTrees=3, maxDepth=4, seed=1),
             "margin": GBTClassifier(maxIter=4, maxDepth=3, seed=1)}[kind].fit(prepared.train)
    rows = model.transform(prepared.test)
    made = explain.model_contributions(model, prepared.test, prepared)
    sums = made.groupBy("key", "class").agg((F.sum("contribution") + F.max("base_value")).alias("total"))
    output = {"forest": F.col("prediction"), "boost": F.col("prediction"), "margin": None}.get(kind, "p")
    if output is None:
        output = vector_to_array("rawPrediction")[1]
    elif isinstance(output, str):
        output = vector_to_array("probability")[F.col("class")]
    worst = sums.join(rows, "key").select(F.max(F.abs(F.col("total") - output)).alias("d"), F.count("*").alias("n")).first()
    assert worst["n"] == prepared.test.count() * trees.outputs(model) and worst["d"] < 1e-9

    forest = trees.forest_of(spark, model)
    x = np.array([r["x"] for r in prepared.test.select(vector_to_array("features").alias("x")).limit(5).collect()])[:, forest.used]
    for tree in forest.trees:
        assert np.allclose(trees.contributions(tree, x, len(forest.used)), [_brute(tree, row, len(forest.used)) for row in x], atol=1e-9)


@pytest.mark.parametrize("kind", ["forest", "classes", "softmax"])
def test_listed_outcomes_give_the_same_attributions(spark, kind, monkeypatch):
    target = "y" if kind == "forest" else "three"
    prepared = training.prepare(_table(spark).select("key", "a", "b", "c", target), target, "key")
    model = {"forest": RandomForestRegressor(numTrees=2, maxDepth=9, seed=1), "classes": RandomForestClassifier(numTrees=2, maxDepth=6, seed=1),
             "softmax": softmax.SoftmaxBoosting(3, rounds=2)}[kind].fit(prepared.train)
    forest = trees.forest_of(spark, model)
    x = np.array([r["x"] for r in prepared.test.select(vector_to_array("features").alias("x")).collect()])[:, forest.used]
    plain = [trees.contributions(tree, x, len(forest.used)) for tree in forest.trees]
    monkeypatch.setattr(trees, "LISTED_FROM", 1)
    for most in (11, 4):   # of 4, some leaves have more
        monkeypatch.setattr(trees, "DECISIONS", most)
        for tree, expected in zip(forest.trees, plain):
            assert np.allclose(trees.contributions(tree, x, len(forest.used)), expected, atol=1e-9)


def test_outcomes_are_listed_per_decision_not_per_row(monkeypatch):
    """Many rows of a deep tree cost a look-up per group of leaves, not a sum per leaf, place and point."""
    rng = np.random.default_rng(4)
    leaves = 64
    at = np.arange(leaves)[:, None] >> np.arange(6) & 1
    tree = trees.Tree(np.tile(np.arange(6), (leaves, 1)), np.where(at, 0.5, -np.inf), np.where(at, np.inf, 0.5), np.full((leaves, 6), 0.5), rng.normal(size=(leaves, 1)), {})
    x = rng.random((trees.LISTED_FROM, 6))
    expected = trees._summed(tree, x, 6)
    monkeypatch.setattr(trees, "_summed", lambda *a: pytest.fail("summed leaf by leaf"))
    assert np.allclose(trees.contributions(tree, x, 6), expected)


def test_training_rows_of_one_file_are_spread(spark, monkeypatch, tmp_path):
    _table(spark).coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).select("key", "a", "b", "y")
    before = training.prepare(df, "y", "key")
    monkeypatch.setattr(training, "ROWS_PER_FILE", 50)
    after = training.prepare(df, "y", "key")
    assert before.train.rdd.getNumPartitions() == 1 < after.train.rdd.getNumPartitions()
    for part in ("train", "test"):
        assert [sorted(getattr(p, part).collect()) for p in (before,)] == [sorted(getattr(p, part).collect()) for p in (after,)]


def test_listed_categories_are_followed(spark):
    tree = trees.Tree(np.zeros((2, 1), int), np.full((2, 1), -np.inf), np.full((2, 1), np.inf), np.array([[0.25], [0.75]]), np.array([[4.0], [0.0]]),
                      {(0, 0): np.array([True, False, True]), (1, 0): np.array([False, True, False])})
    assert trees.contributions(tree, np.array([[2.0], [1.0]]), 1)[:, 0, 0].tolist() == pytest.approx([3.0, -1.0])


def test_linear_attributions_add_up_and_agree_with_importance(spark):
    prepared = training.prepare(_table(spark).drop("y", "two"), "three", "key")
    _, fitted = training.train(prepared, ["Logistic Regression"])
    model = fitted["Logistic Regression"]
    made = explain.model_contributions(model, prepared.test, prepared).cache()
    sums = made.groupBy("key", "class").agg((F.sum("contribution") + F.max("base_value")).alias("total"))
    worst = sums.join(model.transform(prepared.test), "key").select(F.max(F.abs(F.col("total") - vector_to_array("rawPrediction")[F.col("class")]))).first()[0]
    assert worst < 1e-9
    mean = {r["feature"]: r["m"] for r in made.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("m")).collect()}
    found = {r["feature"]: r["importance"] for r in explain.model_importance(model, prepared).collect()}
    assert set(found) == {"a", "b", "c_x", "c_y", "c_z"} and all(found[f] == pytest.approx(m) for f, m in mean.items())


def test_softmax_boosting(spark):
    prepared = training.prepare(_table(spark).drop("y", "two"), "three", "key")
    model = softmax.SoftmaxBoosting(3, rounds=25, depth=2).fit(prepared.train)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:]))
    assert training._score(model.transform(prepared.train), "accuracy") > 0.9
    scored = model.transform(prepared.train).select("label", "probability").collect()
    # The loss that a round starts from is that of the rounds before it.
    more = softmax.SoftmaxBoosting(3, rounds=26, depth=2).fit(prepared.train)
    assert more.losses[25] == pytest.approx(-np.mean([math.log(r["probability"][int(r["label"])]) for r in scored]))
    made = explain.model_contributions(model, prepared.test, prepared)
    sums = made.groupBy("key", "class").agg((F.sum("contribution") + F.max("base_value")).alias("total"))
    margins = {(r["key"], r["class"]): r["total"] for r in sums.collect()}
    for r in model.transform(prepared.test).collect():
        p = softmax.softmax(np.array([[margins[r["key"], k] for k in range(3)]]))[0]
        assert np.allclose(p, r["probability"], atol=1e-9)


def test_first_round_is_the_tree_computed_by_hand(spark):
    rows = [(i, float(x), float(c)) for i, (x, c) in enumerate([(1, 0), (2, 0), (3, 1), (4, 1), (5, 2), (6, 2), (7, 2), (8, 2)])]
    df = spark.createDataFrame(rows, "key long, x double, label double")
    df = df.select("key", encode_vector("x").alias("features"), "label")
    model = softmax.SoftmaxBoosting(3, rounds=1, depth=1, step=1.0).fit(df)
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for k, tree in enumerate(model.rounds[0]):
        g = (y == k) - np.mean(y == k)
        best = max((g[x <= e].sum() ** 2 / (x <= e).sum() + g[x > e].sum() ** 2 / (x > e).sum(), -e) for e in x[:-1])
        edge = -best[1]
        assert model.edges[0, tree.cut[0]] == edge
        for at, part in ((1, x <= edge), (2, x > edge)):
            h = (np.abs(g[part]) * (1 - np.abs(g[part]))).sum()
            assert tree.value[at] == pytest.approx(2 / 3 * g[part].sum() / h) and tree.count[at] == part.sum()


def encode_vector(c):
    from pyspark.ml.functions import array_to_vector
    return array_to_vector(F.array(F.col(c)))


def test_vectors_equal_the_dense_form(spark):
    rows = [(1, 2.0, "b", "q"), (2, 0.0, None, "q"), (3, -1.0, "a", None), (4, 5.0, "é", "p"), (5, None, "b", "p")]
    df = spark.createDataFrame(rows, "id long, v double, t string, u string").na.fill(0.0, ["v"])
    out, names = encode.feature_vector(df, ["v"], ["t", "u"])
    listed = [r["feature"] for r in names.orderBy("place").collect()]
    assert listed == ["v", "t_a", "t_b", "t_é", "u_p", "u_q"]
    dense = {r["id"]: r for r in encode.one_hot(df).collect()}
    for r in out.collect():
        assert r["features"].toArray().tolist() == [float(dense[r["id"]][n]) for n in listed]


def test_wide_columns_stay_off_the_driver(spark, monkeypatch):
    df = spark.range(3000).select("id", F.concat(F.lit("name "), F.col("id")).alias("t"), (F.col("id") % 3).cast("string").alias("u"))
    out = encode.one_hot(df)
    assert out.columns == ["id", "t", "u_0", "u_1", "u_2"]
    assert out.select(F.countDistinct("t.index"), F.max("t.size")).first()[:] == (3000, 3000)
    monkeypatch.setattr(encode, "fit_levels", lambda *a: pytest.fail("levels were listed") if a[1] else {})
    encode.one_hot(df, ["t"]).count()


def test_training_with_very_many_levels(spark):
    df = spark.range(6000).select("id", F.concat(F.lit("name "), F.col("id")).alias("t"), (F.col("id") % 2000).cast("string").alias("u"),
                                  F.rand(5).alias("v")).withColumn("y", F.col("v") * 2 + (F.xxhash64("u") % 7))
    prepared = training.prepare(df, "y", "id")
    assert prepared.names.count() == 4800 + 1200 + 2000 + 1 or prepared.names.count() == 6000 + 2000 + 1
    assert prepared.tree_list == ["v", "t", "u"]
    scores, fitted = training.train(prepared, ["Linear Regression", "Random Forest"], trees=10, depth=5)
    assert scores.count() == 2
    got = prepared.train.select("key", vector_to_array("tree_features").alias("x")).collect()
    prior = prepared.train.agg(F.avg("label")).first()[0]
    # A name that no other row has tells nothing.
    assert all(r["x"][1] == pytest.approx(prior) for r in got)
    names = {r["feature"] for r in explain.model_importance(fitted["Random Forest"], prepared).collect()}
    assert names == {"v", "t", "u"}
    assert explain.model_importance(fitted["Linear Regression"], prepared).count() == prepared.names.count()


def test_label_means_come_from_other_rows(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("pqrs"), rng.choice(["a", "b", "c"]), i % 5 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "key long, w string, c string, is_test boolean").withColumn("label", (F.ascii("c") - 97).cast("double"))
    out, names = training._with_label_means(df, ["w"], 3)
    assert names == ["w=0", "w=1", "w=2"]
    fold = {r["key"]: r["f"] for r in df.select("key", F.pmod(F.xxhash64("key"), F.lit(training.FOLDS)).alias("f")).collect()}
    train = [(k, w, ord(c) - 97) for k, w, c, t in rows if not t]
    for r in out.collect():
        for k in range(3):
            prior = np.mean([c == k for _, _, c in train])
            others = [c == k for i, w, c in train if w == r["w"] and (r["is_test"] or fold[i] != fold[r["key"]])]
            assert r["_means"][k] == pytest.approx((sum(others) + prior) / (len(others) + 1))


def test_level_correlations(spark):
    rng = random.Random(2)
    rows = [(x := rng.choice(["A", "B"]), "a" if x == "A" else rng.choice(["b", "b", "c"]), rng.choice(["u", None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "p string, q string, r string")
    found = {(r["column_a"], r["level_a"], r["column_b"], r["level_b"]): r["corr"] for r in encode.level_correlations(df, ["p", "q", "r"], 0.5).collect()}
    cells = {(c, v): np.array([row[i] == v for row in rows], float) for i, c in enumerate("pqr") for v in {row[i] for row in rows} - {None}}
    expected = {(*a, *b): np.corrcoef(cells[a], cells[b])[0, 1] for a, b in combinations(sorted(cells), 2)}
    expected = {k: v for k, v in expected.items() if abs(v) >= 0.5}
    assert set(found) == set(expected) and all(found[k] == pytest.approx(v) for k, v in expected.items())
