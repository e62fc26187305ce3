"""Feature attributions, exact for linear models and for trees."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepwright import kinds
from prepwright.kinds import as_double, col
from prepwright.models import trees
from prepwright.session import is_broadcastable

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def linear_contributions(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Add ``{feature}_contribution`` = coefficient * (x - mean of x)."""
    kinds.require(df, *coefficients)
    means = df.agg(*[F.avg(as_double(c)).alias(f"m{i}") for i, c in enumerate(coefficients)]).first()
    return df.withColumns({f"{c}_contribution": F.lit(float(w)) * (as_double(c) - F.lit(means[i]))
                           for i, (c, w) in enumerate(coefficients.items())})


def linear_importance(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """(feature, importance): mean absolute contribution, largest first."""
    made = linear_contributions(df, coefficients)
    row = made.agg(*[F.avg(F.abs(col(f"{c}_contribution"))).alias(f"i{i}") for i, c in enumerate(coefficients)])
    return kinds.rows_of(row, [F.struct(F.lit(c).alias("feature"), F.col(f"i{i}").alias("importance"))
                               for i, c in enumerate(coefficients)]).orderBy(F.desc("importance"), "feature")


def model_contributions(model, rows: DataFrame, prepared) -> DataFrame:
    """(key, class, feature, contribution, base_value) of a trained model for every row of ``rows``, exactly.

    For a linear model a contribution is coefficient * (x - mean of x in training), in units of the prediction
    for a regression and of the margin for a classifier. For trees it is the Shapley value in units of the
    prediction, of a forest's probability, or of a boosted classifier's margin; what is left out of a row follows
    the training rows through each tree. There is a row per class, one if there are two. Contributions and base
    value of a row add up to its output; features without any part in a model have no row.
    """
    if trees.has_trees(model):
        found, names = trees.shapley_values(model, rows), prepared.tree_names()
    else:
        found, names = _linear_contributions(model, rows, prepared.train), prepared.names
    return found.join(F.broadcast(names) if is_broadcastable(names) else names, "place").select(
        "key", "class", "feature", "contribution", "base_value")


def _coefficients(model, train: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients (class, place), the means of training and the outputs at them, as large as the model itself."""
    matrix = model.coefficientMatrix.toArray() if hasattr(model, "coefficientMatrix") else model.coefficients.toArray()[None, :]
    starts = model.interceptVector.toArray() if hasattr(model, "interceptVector") else np.array([model.intercept])
    means = train.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    return matrix, means, starts + matrix @ means


def _linear_contributions(model, rows: DataFrame, train: DataFrame) -> DataFrame:
    """(key, class, place, contribution, base_value), a row for every feature with a coefficient."""
    matrix, means, base = _coefficients(model, train)
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((matrix, means, base))
    cells = rows.select("key", F.explode(F.array(*[F.lit(i) for i in range(len(matrix))])).alias("class"), vector_to_array("features").alias("x"))

    def run(batches):
        matrix, means, base = sent.value
        used = [np.flatnonzero(w) for w in matrix]
        for batch in batches:
            for i in range(batch.num_rows):
                k = batch.column("class")[i].as_py()
                at = used[k]
                x = batch.column("x")[i].values.to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(np.full(len(at), i))), pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)),
                     pa.array(matrix[k, at] * (x[at] - means[at])), pa.array(np.full(len(at), base[k]))],
                    names=["key", "class", "place", "contribution", "base_value"])
    kind = rows.schema["key"].dataType.simpleString()
    return cells.mapInArrow(run, f"key {kind}, class int, place int, contribution double, base_value double")


def _linear_importance(model, prepared) -> DataFrame:
    """(place, importance): mean absolute contribution over the test rows and the classes.

    Places behind the numbers hold zeros and ones, whose mean distance from a mean follows from their shares alone.
    """
    matrix, means, _ = _coefficients(model, prepared.train)
    spread = np.zeros(len(means))
    shares = prepared.test.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    spread[:] = shares * (1 - means) + (1 - shares) * means
    if prepared.n_numbers:
        numbers = VectorSlicer(inputCol="features", outputCol="_x", indices=list(range(prepared.n_numbers))).transform(prepared.test)
        row = numbers.select(vector_to_array("_x").alias("x")).agg(*[F.avg(F.abs(F.col("x")[i] - F.lit(float(means[i])))) for i in range(prepared.n_numbers)])
        spread[:prepared.n_numbers] = row.first()
    found = pd.DataFrame({"place": np.arange(len(means)), "importance": np.abs(matrix).mean(axis=0) * spread})
    return prepared.test.sparkSession.createDataFrame(found)


def model_importance(model, prepared) -> DataFrame:
    """(feature, importance): mean absolute contribution over all rows of the test part and all classes, largest first.

    Features without any part in the model have importance 0.
    """
    if trees.has_trees(model):
        names = prepared.tree_names()
        # Rows without a part in a class count there as well.
        cells = float(max(prepared.test.count() * trees.outputs(model), 1))
        found = trees.shapley_values(model, prepared.test).groupBy("place").agg((F.sum(F.abs("contribution")) / cells).alias("importance"))
    else:
        names, found = prepared.names, _linear_importance(model, prepared)
    return names.join(found, "place", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance")).orderBy(
        F.desc("importance"), "feature")


def top_importance(importance: DataFrame, k: int = 10) -> DataFrame:
    """The k most important features, least important first."""
    return importance.orderBy(F.desc("importance"), "feature").limit(k).orderBy("importance", F.desc("feature"))
