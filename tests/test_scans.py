"""Scans compute no more than their results need."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from prepwright.models import softmax
from prepwright.operators import casting, fuzzy, profile


def test_many_measures_of_many_columns_take_several_passes(spark, monkeypatch):
    df = spark.range(10).selectExpr(*[f"id + {i} as c{i}" for i in range(20)])
    passes, union = [], profile._union
    monkeypatch.setattr(profile, "_union", lambda frames: passes.append(len(frames)) or union(frames))
    found = {r["column"]: r for r in profile.profile(df).collect()}
    assert max(passes) >= 20 * 14 / profile.MEASURES_PER_PASS
    assert [(found[f"c{i}"]["n"], found[f"c{i}"]["mean"]) for i in range(20)] == [(10, 4.5 + i) for i in range(20)]


def test_types_are_tried_on_texts_with_a_digit_only(spark, monkeypatch):
    df = spark.createDataFrame([("A", "1", "2024-01-02"), ("", " -2.5e3 ", "3 Mar 2024"), (None, ".5", None), ("nan", "7.", "20240105")],
                               "a string, n string, t string")
    tried, parse = [], casting.parse_timestamp
    monkeypatch.setattr(casting, "parse_timestamp", lambda c: tried.append(c) or parse(c))
    assert casting.fit_types(df, 0.75) == {"n": "numeric", "t": "datetime"}
    assert ["w0" in str(c) for c in tried] == [True, False, False]


def test_values_are_computed_once_to_be_numbered(spark):
    seen = spark.sparkContext.accumulator(0)

    def once(v):
        seen.add(1)
        return v
    values = spark.range(5).select(F.lit("g").alias("grp"), F.udf(once, "string")(F.col("id").cast("string")).alias("value"),
                                   F.col("id").cast("string").alias("txt"), (-F.col("id")).alias("first"))
    nodes = {r["value"]: r["node"] for r in fuzzy.number_nodes(values).collect()}
    assert nodes == {str(i): 4 - i for i in range(5)}
    assert seen.value == 5


def test_boosting_scans_equal_rows_once(spark):
    rows = [(float(i % 4), 1.0, float(i % 3)) for i in range(120)]
    df = spark.createDataFrame(rows, "a double, b double, label double").repartition(3)
    features = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    boosting = softmax.SoftmaxBoosting(3, rounds=2)
    edges = softmax.fit_edges(features, "features")
    start = np.log(np.full(3, 1 / 3))
    stored = boosting._stored(features.select(vector_to_array("features").alias("x"), "label"), edges, start).collect()
    assert len(stored) == 12 and all(r["n"] == 10 for r in stored)
    # Repeats of a row weigh as much as they are: a tree's counts are those of all rows.
    model = boosting.fit(features)
    assert all(t.count[0] == 120 for trees in model.rounds for t in trees)
    assert model.losses[0] == pytest.approx(np.log(3))


def test_few_rows_are_boosted_without_a_job_per_level(spark, monkeypatch):
    rng = random.Random(3)   # no splits of equal gain
    rows = [(float(rng.randrange(9)), rng.random(), float(rng.choice([0, 0, 0, 1, 1, 2]))) for _ in range(150)]
    df = spark.createDataFrame(rows, "a double, b double, label double").repartition(3)
    features = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    boosting = softmax.SoftmaxBoosting(3, rounds=12)
    spark.sparkContext.setJobGroup("boosted", "")
    model = boosting.fit(features)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 3 * 12
    # Trees are those of rows in several files, which take a job per level.
    monkeypatch.setattr(softmax, "ROWS_PER_FILE", 50)
    monkeypatch.setattr(softmax, "STORE_EVERY", 5)
    other = boosting.fit(features)
    assert model.losses == pytest.approx(other.losses)
    for mine, theirs in zip(model.rounds, other.rounds):
        for x, y in zip(mine, theirs):
            assert list(x.feature) == list(y.feature) and list(x.cut) == list(y.cut) and np.allclose(x.value, y.value)
