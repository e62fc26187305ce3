import numpy as np
import pytest
from pyspark.sql import functions as F

from prepwright.operators import profile


@pytest.mark.parametrize("block, pairs", [(128, 1 << 20), (4, 16), (5, 60)])
def test_pairs_in_blocks_agree_with_numpy(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(profile, "COLUMNS_PER_BLOCK", block)
    monkeypatch.setattr(profile, "PAIRS_PER_SCAN", pairs)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 13)) @ rng.normal(size=(13, 13)) + 1e6
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3], x[:100, 4], x[100:, 5] = 7.0, np.nan, np.nan
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in row] for row in x], ", ".join(f"c{i} double" for i in range(13))).repartition(5)
    found = {(r["col_a"], r["col_b"]): (r["corr"], r["ord"]) for r in profile.correlations(df).collect()}
    spread = {(r["col_a"], r["col_b"]): r["cov"] for r in profile.covariances(df).collect()}
    assert len(found) == 13 * 12 // 2 and len(spread) == 13 * 14 // 2
    assert [k for k, _ in sorted(found.items(), key=lambda kv: kv[1][1])] == [(f"c{i}", f"c{j}") for i in range(13) for j in range(i + 1, 13)]
    for i in range(13):
        for j in range(i, 13):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            if len(a) < 2:
                assert spread[f"c{i}", f"c{j}"] is None and found[f"c{i}", f"c{j}"][0] is None
                continue
            assert spread[f"c{i}", f"c{j}"] == pytest.approx(np.cov(a, b)[0, 1], abs=1e-6)
            if i < j:
                want = None if 3 in (i, j) else np.corrcoef(a, b)[0, 1]
                assert found[f"c{i}", f"c{j}"][0] == (want if want is None else pytest.approx(want, abs=1e-9))


def test_empty_tables_and_single_columns(spark):
    df = spark.createDataFrame([], "a double, b double, t string")
    assert [tuple(r) for r in profile.correlations(df).collect()] == [("a", "b", None, 1)]
    assert profile.covariances(df).count() == 3
    assert profile.correlations(df.select("a")).count() == 0 and profile.covariances(df.select("t")).count() == 0


def test_infinite_quartiles_have_no_outliers(spark):
    df = spark.createDataFrame([(float("inf"), 1.0)] * 8 + [(1.0, 2.0)], "a double, b double")
    found = {r["column"]: r["outliers"] for r in profile.outlier_counts(df).collect()}
    assert found["a"] == 0
    from prepwright.operators import quality
    assert quality.quality_score(df.withColumn("id", F.monotonically_increasing_id()), ["id"]).count() == 1
