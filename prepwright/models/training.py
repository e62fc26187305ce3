"""Candidate models on Spark ML: preparation, training, comparison."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepwright import kinds
from prepwright.kinds import as_double, col
from prepwright.models import bayes, softmax
from prepwright.models.evaluate import accuracy, errors, r2
from prepwright.operators import encode
from prepwright.operators.profile import epoch_seconds
from prepwright.operators.quality import infer_task
from prepwright.operators.sampling import random_split, stratified_split
from prepwright.session import attach, cut_lineage

MIN_ROWS = 5
SCORE_SCHEMA = "model string, metric string, train_score double, test_score double"


# Parts of the training rows; a row's label mean of its text value comes from the other parts.
FOLDS = 5
# Rows of a stored file of training data; fewer bytes than a file of a large table has, and far more to compute.
ROWS_PER_FILE = 25_000


@dataclass
class Prepared:
    """Train and test rows: key, ``features``, ``label`` and, if a text column has very many values, ``tree_features``.

    ``names`` (place, feature) names the places of ``features``, the first ``n_numbers`` of which are numbers and the
    others ones of text values; ``labels`` (place, level) names the classes. Both are stored tables.
    """

    task: str
    n_classes: int
    train: DataFrame
    test: DataFrame
    names: DataFrame
    n_numbers: int
    labels: DataFrame | None
    tree_list: list[str] | None = None

    @property
    def tree_column(self) -> str:
        return "features" if self.tree_list is None else "tree_features"

    def tree_names(self) -> DataFrame:
        """(place, feature) of what trees are trained on."""
        if self.tree_list is None:
            return self.names
        return self.names.sparkSession.createDataFrame(list(enumerate(self.tree_list)), "place long, feature string")


def _with_label_means(rows: DataFrame, wide: list[str], n_classes: int) -> tuple[DataFrame, list[str]]:
    """Add a number per wide text column, or one per class if there are more than two: the mean label of its value.

    A training row's mean is taken from the other FOLDS - 1 parts of the training rows, so a value that only it has
    tells nothing of its label; one more row with the overall mean counts in, and is all there is for values that
    are missing or unknown.
    """
    targets = [f"cast(label = {k} as double)" for k in range(n_classes)] if n_classes > 2 else ["label"]
    fold = F.pmod(F.xxhash64("key"), F.lit(FOLDS)).cast("int")
    train = rows.where(~F.col("is_test")).withColumn("_fold", fold)
    prior = train.selectExpr(*[f"avg({t}) as p{k}" for k, t in enumerate(targets)]).first()
    names = []
    rows = rows.withColumn("_fold", F.when(~F.col("is_test"), fold))
    for i, c in enumerate(wide):
        found = train.where(col(c).isNotNull()).groupBy(col(c)).agg(
            F.array(*[F.count_if(F.col("_fold") == f) for f in range(FOLDS)]).alias("_n"),
            *[F.array(*[F.expr(f"sum(if(_fold = {f}, {t}, 0D))") for f in range(FOLDS)]).alias(f"_s{k}") for k, t in enumerate(targets)])
        columns = rows.columns
        rows = attach(rows, found, [c])
        outside = lambda a: f"aggregate({a}, 0D, (x, y) -> x + y) - if(_fold is null, 0, {a}[_fold])"
        rows = rows.select(*map(col, columns), *[
            F.expr(f"coalesce(({outside(f'_s{k}')} + {kinds.lit(prior[k])}) / ({outside('_n')} + 1), {kinds.lit(prior[k])})").alias(f"_mean{i}_{k}")
            for k in range(len(targets))])
        names += [(f"_mean{i}_{k}", c if len(targets) == 1 else f"{c}={k}") for k in range(len(targets))]
    made = [m for m, _ in names]
    return rows.withColumn("_means", array_to_vector(F.array(*made))).drop("_fold", *made), [n for _, n in names]


def _spread(rows: DataFrame) -> DataFrame:
    """Stored rows in files enough to keep all cores busy, whatever the files of the table; in order of the key in each.

    Models scan the rows many times and compute far more than they read, and a table of few bytes is read by few tasks.
    """
    n = -(-rows.count() // ROWS_PER_FILE)
    if n <= rows.rdd.getNumPartitions():
        return rows
    return cut_lineage(rows.repartition(n, "key").sortWithinPartitions("key"))


def prepare(df: DataFrame, target: str, key: str, share: float = 0.2, seed: int = 42, wide: int = encode.WIDE) -> Prepared:
    """Drop incomplete rows, split, one-hot encode and assemble.

    ``key`` is a unique column that decides the split; it is not a feature. Text values become ones of a sparse
    vector, whose names are a table. Trees get a text column with more than ``wide`` values as one number instead,
    the mean label of its value by other training rows (one number per class if there are more than two).
    """
    kinds.require(df, target, key)
    df = kinds.nan_to_null(df).na.drop()
    task = infer_task(df, target)
    df = df.withColumns({c: epoch_seconds(df, c) for c in kinds.datetime(df) if c != target})
    split = stratified_split(df, target, key, share, seed) if task == "classification" else \
        random_split(df, key, share, seed)
    if split.limit(MIN_ROWS).count() < MIN_ROWS:
        raise ValueError("At least 5 rows are required for model selection")
    inputs = [c for c in df.columns if c not in (target, key)]
    words = [c for c in kinds.text(df) if c in inputs]
    nums = [f.name for f in df.schema if f.name in inputs and isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    labels, n_classes = None, 0
    if task == "classification":
        split = split.withColumn(target, col(target).cast("string"))
        labels = encode.dictionary(split, [target]).select("place", "level")
        n_classes = labels.count()
        known = labels.select(F.col("level").alias(target), F.col("place").cast("double").alias("_label"))
        split = attach(split, known, [target]).withColumn(target, F.col("_label")).drop("_label")
    # Names of the table may clash with those of the result, so they get numbers.
    renamed = split.select(col(key).alias("key"), col(target).cast("double").alias("label"), "is_test",
                           *[as_double(c).alias(f"n{i}") for i, c in enumerate(nums)], *[col(c).alias(f"w{i}") for i, c in enumerate(words)])
    own = {f"n{i}": c for i, c in enumerate(nums)} | {f"w{i}": c for i, c in enumerate(words)}
    numbers, texts = [c for c in own if c[0] == "n"], [c for c in own if c[0] == "w"]
    renamed = _spread(cut_lineage(renamed))   # read several times
    ready, names = encode.feature_vector(renamed, numbers, texts)
    names = cut_lineage(names.withColumn("_c", F.substring_index("feature", "_", 1)).select(
        "place", F.concat(F.create_map(*[F.lit(x) for pair in own.items() for x in pair])[F.col("_c")],
                          F.expr("substr(feature, length(_c) + 1)")).alias("feature")) if own else names)
    sizes = encode.count_levels(ready, texts)
    large = [c for c in texts if sizes[c] > wide]
    kept = ["key", "features", "label", "is_test"]
    tree_list = None
    if large:
        starts, at = {}, len(nums)
        for c in texts:
            starts[c], at = at, at + sizes[c]
        small = [*range(len(nums)), *[i for c in texts if c not in large for i in range(starts[c], starts[c] + sizes[c])]]
        # At most the numbers and ``wide`` names of each column.
        listed = {r["place"]: r["feature"] for r in names.where(F.col("place") < len(nums)).unionByName(
            reduce(DataFrame.unionByName, [names.where((F.col("place") >= starts[c]) & (F.col("place") < starts[c] + sizes[c]))
                                           for c in texts if c not in large], names.limit(0))).collect()}
        ready, means = _with_label_means(ready, large, n_classes)
        if small:
            ready = VectorSlicer(inputCol="features", outputCol="_small", indices=small).transform(ready)
        ready = VectorAssembler(inputCols=["_small", "_means"] if small else ["_means"], outputCol="tree_features").transform(ready)
        tree_list = [listed[i] for i in small] + [own[m.split("=")[0]] + m[len(m.split("=")[0]):] for m in means]
        kept.append("tree_features")
    ready = _spread(cut_lineage(ready.select(*kept)))
    if n_classes:
        ready = ready.withColumn("label", F.col("label").alias("label", metadata={"ml_attr": {"type": "nominal", "num_vals": n_classes}}))
    return Prepared(task, n_classes, ready.where(~F.col("is_test")), ready.where("is_test"), names, len(nums), labels, tree_list)


def candidates(prepared: Prepared, n_train: int, trees: int = 100, depth: int = 10, boosts: int = 100,
               seed: int = 42) -> dict:
    """Estimator per model name, best-known first."""
    shape = {"featuresCol": prepared.tree_column, "seed": seed}
    if prepared.task == "classification":
        boost = GBTClassifier(maxIter=boosts, stepSize=0.1, maxDepth=3, **shape)
        return {
            "Logistic Regression": LogisticRegression(maxIter=1000, regParam=1.0 / max(n_train, 1), standardization=False),
            "Random Forest": RandomForestClassifier(numTrees=trees, maxDepth=depth, **shape),
            # Boosted classifiers are binary in Spark ML.
            "Gradient Boosting": boost if prepared.n_classes <= 2 else
            softmax.SoftmaxBoosting(prepared.n_classes, boosts, features_col=prepared.tree_column),
        }
    return {
        # Beyond 4,096 features the normal equations give way to iteration.
        "Linear Regression": LinearRegression(solver="auto"),
        "Random Forest": RandomForestRegressor(numTrees=trees, maxDepth=depth, **shape),
        "Gradient Boosting": GBTRegressor(maxIter=boosts, stepSize=0.1, maxDepth=3, **shape),
        "Bayesian Ridge": bayes.BayesianRidge(prepared.tree_column),
    }


def _score(predicted: DataFrame, metric: str) -> float:
    if metric == "accuracy":
        frame = accuracy(predicted, "label", "prediction")
    elif metric == "r2":
        frame = r2(predicted, "label", "prediction")
    else:
        frame = errors(predicted, "label", "prediction").select("rmse")
    return float(frame.first()[0])


def train(prepared: Prepared, names: list[str] | None = None, metric: str | None = None, **options):
    """(score table, fitted models); the table is ranked with the best model first."""
    metric = metric or ("accuracy" if prepared.task == "classification" else "rmse")
    pool = candidates(prepared, prepared.train.count(), **options)
    spark = prepared.train.sparkSession
    rows, fitted = [], {}
    for name in names or list(pool):
        if name not in pool:
            raise ValueError(f"Unknown model: {name}")
        fitted[name] = pool[name].fit(prepared.train)
        rows.append((name, metric, _score(fitted[name].transform(prepared.train), metric),
                     _score(fitted[name].transform(prepared.test), metric)))
    best_first = F.asc("test_score") if metric == "rmse" else F.desc("test_score")
    # A handful of rows, one per candidate.
    rank = F.row_number().over(W.partitionBy("metric").orderBy(best_first, "model"))
    return spark.createDataFrame(rows, SCORE_SCHEMA).withColumn("rank", rank).select(
        "rank", "model", "metric", "train_score", "test_score").orderBy("rank"), fitted


def select_model(df: DataFrame, target: str, key: str, **options):
    """Train every candidate: (ranked scores, best fitted model, prepared data)."""
    prepared = prepare(df, target, key)
    scores, fitted = train(prepared, **options)
    return scores, fitted[scores.first()["model"]], prepared


# Model names of the manual and the advised choices.
MANUAL = {"Linear": {"classification": "Logistic Regression", "regression": "Linear Regression"}}
ADVISED = {"Random Forest Classifier": "Random Forest", "Random Forest Regressor": "Random Forest",
           "Gradient Boosting Classifier": "Gradient Boosting"}


def train_one(df: DataFrame, target: str, key: str, choice: str, metric: str | None = None, **options):
    """Train one named model: (score row, fitted model, prepared data)."""
    prepared = prepare(df, target, key)
    name = MANUAL.get(choice, {}).get(prepared.task) or ADVISED.get(choice, choice)
    scores, fitted = train(prepared, [name], metric, **options)
    return scores, fitted[name], prepared


def baseline(df: DataFrame, target: str, key: str):
    """Linear baseline scored by accuracy, or by r2 for regression."""
    prepared = prepare(df, target, key)
    metric = "accuracy" if prepared.task == "classification" else "r2"
    name = "Logistic Regression" if prepared.task == "classification" else "Linear Regression"
    scores, fitted = train(prepared, [name], metric)
    return scores, fitted[name], prepared


def predictions(model, prepared: Prepared) -> DataFrame:
    """(key, actual, predicted) on the test rows, class names restored."""
    out = model.transform(prepared.test).select("key", "label", "prediction")
    if prepared.labels is None:
        return out.select("key", F.col("label").alias("actual"), F.col("prediction").alias("predicted"))
    for place, name in (("label", "actual"), ("prediction", "predicted")):
        out = attach(out, prepared.labels.select(F.col("place").cast("double").alias(place), F.col("level").alias(name)), [place])
    return out.select("key", "actual", "predicted")
