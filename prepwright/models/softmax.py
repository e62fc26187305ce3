"""Boosted trees for three classes or more as one model: softmax over one tree per class and round."""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepwright.models.trees import Forest, Tree
from prepwright.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Thresholds tried per feature, by quantiles, and the accuracy of these.
BINS = 32
QUANTILE_ACCURACY = 10_000
# Groups of equal binned rows in a stored file.
ROWS_PER_FILE = 25_000
# Sums of so many files are added up by the driver: a shuffle takes longer than the scan of them.
FEW_FILES = 8
STORED = "bins binary, label int, n long, margins binary"
# Rounds after which the margins of the training rows are stored, so that no scan replays more of them.
STORE_EVERY = 10


@dataclass
class Grown:
    """A tree of fixed depth as a heap: node i has the children 2i + 1 and 2i + 2; rows with bin <= cut go left.

    A feature of -1 ends the tree; ``value`` is added to the margin there, ``count`` are training rows.
    """

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    count: np.ndarray

    def nodes_of(self, x: np.ndarray, depth: int) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(depth):
            f = self.feature[at]
            inner = f >= 0
            right = x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return at


def softmax(margins: np.ndarray) -> np.ndarray:
    shifted = np.exp(margins - margins.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def _margins(start: np.ndarray, rounds: list[list[Grown]], x: np.ndarray, depth: int) -> np.ndarray:
    out = start.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += tree.value[tree.nodes_of(x, depth)]
    return out


@dataclass
class SoftmaxModel:
    numClasses: int
    start: np.ndarray
    rounds: list[list[Grown]]
    edges: np.ndarray
    depth: int
    features_col: str
    losses: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` (array, by class) and ``prediction``."""
        model = self

        def predict(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            bins, of = np.unique(_binned(np.stack(x.to_numpy()), model.edges), axis=0, return_inverse=True)
            margins = _margins(np.tile(model.start, (len(bins), 1)), model.rounds, bins, model.depth)
            return pd.Series(list(softmax(margins)[of.ravel()]))
        probability = F.pandas_udf(predict, T.ArrayType(T.DoubleType()))
        out = df.withColumn("probability", probability(vector_to_array(self.features_col)))
        return out.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))

    def forest(self) -> Forest:
        """The trees in the form that attributions read; outputs are the margins of the classes."""
        found, used = [], sorted({int(f) for trees in self.rounds for t in trees for f in t.feature if f >= 0})
        place = {f: i for i, f in enumerate(used)}
        for trees in [None, *self.rounds]:
            for k in range(self.numClasses):
                value = np.zeros(self.numClasses)
                if trees is None:   # where the margins start
                    value[k] = self.start[k]
                    found.append(Tree(np.zeros((1, 1), np.int64), np.full((1, 1), -np.inf), np.full((1, 1), np.inf), np.ones((1, 1)), value[None, :], {}))
                    continue
                found.append(_paths(trees[k], self.edges, place, k, self.numClasses))
        return Forest(found, used, list(range(self.numClasses)))


def _paths(tree: Grown, edges: np.ndarray, place: dict[int, int], k: int, n_classes: int) -> Tree:
    leaves, todo = [], [(0, {})]
    while todo:
        at, conditions = todo.pop()
        f = int(tree.feature[at])
        if f < 0:
            leaves.append((conditions, tree.value[at]))
            continue
        edge = edges[f, tree.cut[at]]
        for child in (2 * at + 1, 2 * at + 2):
            low, high, share = conditions.get(f, (-np.inf, np.inf, 1.0))
            low, high = (low, min(high, edge)) if child % 2 else (max(low, edge), high)
            todo.append((child, conditions | {f: (low, high, share * tree.count[child] / tree.count[at])}))
    shape = len(leaves), max(1, max(len(c) for c, _ in leaves))
    out = Tree(np.zeros(shape, np.int64), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape), np.zeros((len(leaves), n_classes)), {})
    for leaf, (conditions, value) in enumerate(leaves):
        out.value[leaf, k] = value
        for i, (f, (low, high, share)) in enumerate(conditions.items()):
            out.feature[leaf, i], out.low[leaf, i], out.high[leaf, i], out.share[leaf, i] = place[f], low, high, share
    return out


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin of every value: how many of its feature's edges lie below it."""
    return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def fit_edges(df: DataFrame, features: str, bins: int = BINS) -> np.ndarray:
    """(feature, edge): thresholds at the quantiles of each feature, filled up with infinity."""
    ps = ", ".join(str(i / bins) for i in range(1, bins))
    cells = df.select(F.posexplode(vector_to_array(features)).alias("f", "v"))
    found = cells.groupBy("f").agg(F.expr(f"percentile_approx(v, array({ps}), {QUANTILE_ACCURACY})").alias("e"), F.max("v").alias("top")).collect()
    edges = np.full((len(found), bins - 1), np.inf)
    for r in found:
        # An edge at the largest value parts nothing.
        values = [v for v in sorted(set(r["e"])) if v < r["top"]]
        edges[r["f"], :len(values)] = values
    return edges


@dataclass
class SoftmaxBoosting:
    """Estimator with the ``fit``/``transform`` shape of Spark ML, on a vector column and ``label`` (0, 1, …).

    Every round takes the gradient of the log loss once, y_k - p_k for each class k, and fits one regression tree per
    class to it. Leaves get (K - 1) / K * sum(g) / sum(abs(g) * (1 - abs(g))), times ``step``. A level of the
    trees of all classes is one scan of the binned rows, where equal rows of one label are one with their number: tasks add up sums per class, node, feature and bin,
    so the driver gets as many numbers as there are of these, whatever the number of rows.
    """

    n_classes: int
    rounds: int = 100
    depth: int = 3
    step: float = 0.1
    bins: int = BINS
    features_col: str = "features"

    def fit(self, df: DataFrame) -> SoftmaxModel:
        edges = fit_edges(df, self.features_col, self.bins)
        counts = {int(r["label"]): r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}
        total = sum(counts.values())
        # A class without rows starts as if it had a small part of one.
        start = np.log(np.array([max(counts.get(k, 0), 1e-6) / total for k in range(self.n_classes)]))
        rows = self._stored(df.select(vector_to_array(self.features_col).alias("x"), "label"), edges, start)
        if len(rows.inputFiles()) == 1:
            rounds, losses = self._rounds_in_a_task(rows, edges)
            return SoftmaxModel(self.n_classes, start, rounds, edges, self.depth, self.features_col, losses)
        rounds: list[list[Grown]] = []
        losses: list[float] = []
        pending: list[list[Grown]] = []
        for _ in range(self.rounds):
            trees, loss = self._round(lambda grown, level: self._histograms(rows, pending, grown, level, len(edges)), edges)
            losses.append(loss)
            rounds.append(trees)
            pending.append(trees)
            if len(pending) == STORE_EVERY:
                rows, pending = self._advanced(rows, pending), []
        return SoftmaxModel(self.n_classes, start, rounds, edges, self.depth, self.features_col, losses)

    def _stored(self, rows: DataFrame, edges: np.ndarray, start: np.ndarray) -> DataFrame:
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                label = batch.column("label").to_numpy().astype(np.int32)
                found, times = np.unique(np.column_stack([_binned(x, edges), label.view(np.uint8).reshape(len(label), 4)]), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.tobytes() for b in found[:, :-4]], pa.binary()), pa.array(np.ascontiguousarray(found[:, -4:]).view(np.int32).ravel()), pa.array(times)],
                    names=["bins", "label", "n"])
        # Nothing but its bins and its label tells a row from others, so equal ones are scanned once.
        equal = cut_lineage(rows.mapInArrow(run, "bins binary, label int, n long").groupBy("bins", "label").agg(F.sum("n").alias("n")))
        files = max(1, -(-equal.count() // ROWS_PER_FILE))
        return cut_lineage(equal.repartition(files, "bins", "label").sortWithinPartitions("bins", "label").select(
            "bins", "label", "n", F.lit(start.tobytes()).alias("margins")))

    def _advanced(self, rows: DataFrame, rounds: list[list[Grown]]) -> DataFrame:
        depth, k = self.depth, self.n_classes

        def run(batches):
            for batch in batches:
                x, _, _, margins = _matrices(batch, k)
                now = _margins(margins, rounds, x, depth)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("bins", "label", "n")], pa.array([m.tobytes() for m in now], pa.binary())],
                                                 names=["bins", "label", "n", "margins"])
        return cut_lineage(rows.mapInArrow(run, STORED))

    def _rounds_in_a_task(self, rows: DataFrame, edges: np.ndarray) -> tuple[list[list[Grown]], list[float]]:
        """All trees and losses from a single file of rows, which one task scans for every level, without a job for each."""
        booster = self

        def run(batches):
            rounds, losses = [], []
            held = [_matrices(batch, booster.n_classes) for batch in batches if batch.num_rows]
            for _ in range(booster.rounds):
                trees, loss = booster._round(lambda grown, level: booster._summed(held, [], grown, level, len(edges)), edges)
                rounds.append(trees)
                losses.append(loss)
                held = [(x, label, times, _margins(margins, [trees], x, booster.depth)) for x, label, times, margins in held]
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(([[vars(t) for t in trees] for trees in rounds], losses))], pa.binary())], names=["fitted"])
        rounds, losses = pickle.loads(rows.coalesce(1).mapInArrow(run, "fitted binary").first()["fitted"])
        return [[Grown(**t) for t in trees] for trees in rounds], losses

    def _summed(self, parts, rounds: list[list[Grown]], grown: list[Grown], level: int, n_features: int) -> tuple[np.ndarray, float]:
        """(kind of sum, class, node, feature, bin) of a level's nodes over all rows of the parts, and the summed log loss."""
        k, depth, bins = self.n_classes, self.depth, self.bins
        nodes, first = 1 << level, (1 << level) - 1
        cells = k * nodes * n_features * bins
        sums, loss = np.zeros((3, cells)), 0.0
        for x, label, times, margins in parts:
            p = softmax(_margins(margins, rounds, x, depth))
            loss -= float((times * np.log(np.maximum(p[np.arange(len(p)), label], 1e-300))).sum())
            for c in range(k):
                g = (label == c) - p[:, c]
                node = grown[c].nodes_of(x, level) - first
                open_ = node >= 0
                base = ((c * nodes + node[open_])[:, None] * n_features + np.arange(n_features)) * bins + x[open_]
                for i, w in enumerate((g, np.abs(g) * (1 - np.abs(g)), np.ones(len(g)))):
                    sums[i] += np.bincount(base.ravel(), np.repeat((w * times)[open_], n_features), cells)
        return sums.reshape(3, k, nodes, n_features, bins), loss

    def _histograms(self, rows: DataFrame, rounds: list[list[Grown]], grown: list[Grown], level: int, n_features: int) -> tuple[np.ndarray, float]:
        """(class, node, feature, bin, [g, |g| (1 - |g|), g * g, count]) of a level's nodes, and the summed log loss."""
        booster, shape = self, (3, self.n_classes, 1 << level, n_features, self.bins)

        def run(batches):
            sums, loss = booster._summed((_matrices(batch, booster.n_classes) for batch in batches if batch.num_rows), rounds, grown, level, n_features)
            sums = sums.reshape(3, -1)
            at = np.flatnonzero(sums[2])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), *[pa.array(np.append(s[at], loss if i == 0 else 0.0)) for i, s in enumerate(sums)]],
                                             names=["cell", "g", "h", "n"])
        found = rows.mapInArrow(run, "cell long, g double, h double, n double")
        if len(rows.inputFiles()) > FEW_FILES:
            found = found.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
        found = found.toPandas().groupby("cell", as_index=False).sum()
        loss = float(found.loc[found["cell"] < 0, "g"].sum())
        found = found[found["cell"] >= 0]
        out = np.zeros(shape).reshape(3, -1)
        out[:, found["cell"]] = found[["g", "h", "n"]].to_numpy().T
        return out.reshape(shape), loss

    def _round(self, histograms: Callable, edges: np.ndarray) -> tuple[list[Grown], float]:
        size, k = (1 << (self.depth + 1)) - 1, self.n_classes
        grown = [Grown(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)) for _ in range(k)]
        factor = self.step * (k - 1) / k
        log_loss = 0.0

        def set_leaf(tree: Grown, at: int, g: float, h: float, n: float) -> None:
            tree.count[at], tree.value[at] = n, factor * g / h if h > 1e-150 else 0.0
        for level in range(self.depth):
            (g, h, n), loss = histograms(grown, level)
            first = (1 << level) - 1
            for c in range(k):
                for node in range(1 << level):
                    at = first + node
                    if level and tree_ended(grown[c], at):
                        continue
                    left = [np.cumsum(s[c, node], axis=1)[:, :-1] for s in (g, h, n)]
                    whole = [s[c, node, 0].sum() for s in (g, h, n)]
                    if level == 0:
                        set_leaf(grown[c], at, *whole)
                    right_n = whole[2] - left[2]
                    usable = (left[2] > 0) & (right_n > 0)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(usable, left[0] ** 2 / left[2] + (whole[0] - left[0]) ** 2 / right_n - whole[0] ** 2 / max(whole[2], 1), 0.0)
                    f, cut = np.unravel_index(np.argmax(gain), gain.shape)
                    if gain[f, cut] <= 1e-12:
                        continue
                    grown[c].feature[at], grown[c].cut[at] = f, cut
                    part = [s[f, cut] for s in left]
                    set_leaf(grown[c], 2 * at + 1, *part)
                    set_leaf(grown[c], 2 * at + 2, *[w - s for w, s in zip(whole, part)])
            if level == 0:
                log_loss = loss / max(n[0, 0, 0].sum(), 1)
        return grown, log_loss


def tree_ended(tree: Grown, at: int) -> bool:
    """Whether a node was never reached, for its parent did not split."""
    return tree.feature[(at - 1) // 2] < 0


def _matrices(batch: pa.RecordBatch, n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bins, label, number of equal rows and margins of each row of a batch that is not empty."""
    n = batch.num_rows
    x = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(n, -1)
    margins = np.frombuffer(b"".join(batch.column("margins").to_pylist()), float).reshape(n, n_classes).copy()
    return x, batch.column("label").to_numpy(), batch.column("n").to_numpy().astype(float), margins
