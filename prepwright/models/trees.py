"""Exact Shapley values of trained forests and boosted trees.

A leaf of a tree is a game: its value counts if a row meets the conditions of all features on the way to
it. A feature that is left out passes with the share of training rows that went that way. The Shapley value
of a feature in a product of such factors is the integral of a polynomial, which a Gauss rule with enough
points gives exactly, so a leaf costs its features times half their number and not all their subsets.

Where many rows meet a tree, neighbouring leaves are taken together: their few decisions have few outcomes, whose values are
computed once and looked up by each row.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepwright.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cells (row, leaf, feature on the way, point) that are held at once.
CELLS = 1 << 20
# Cells (row, feature, output) that a task keeps for all trees.
KEPT_CELLS = 1 << 22
# Decisions whose outcomes are listed together (15 at most), and the rows from which on that pays.
DECISIONS = 11
LISTED_FROM = 1_000
# Rows of a task, about: the outcomes are listed once for all of them.
ROWS_PER_TASK = 40_000
# Gauss rules made so far, by points.
RULES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@dataclass
class Tree:
    """Leaves by the features on the way to them; unused places have a factor of one.

    ``feature`` (leaf, place) are positions in ``Forest.used``, ``low`` and ``high`` the interval that passes,
    ``share`` the training rows that do, ``value`` (leaf, output) the leaf's part of the prediction.
    """

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray
    listed: dict[tuple[int, int], np.ndarray]

    def base(self) -> np.ndarray:
        return self.share.prod(axis=1) @ self.value


@dataclass
class Forest:
    """The trees of a model, the columns of the feature vector they use, and the classes of their outputs."""

    trees: list[Tree]
    used: list[int]
    classes: list[int]

    def base(self) -> np.ndarray:
        return np.sum([t.base() for t in self.trees], axis=0)


def _leaves(nodes: dict[int, dict], value) -> tuple[list[dict], list]:
    """For each leaf its conditions {feature: [low, high, allowed categories or None, share]} and its value."""
    found, values = [], []
    todo = [(0, {})]
    while todo:
        at, conditions = todo.pop()
        node = nodes[at]
        if node["leftChild"] < 0:
            found.append(conditions)
            values.append(value(node))
            continue
        split = node["split"]
        i, edges = split["featureIndex"], split["leftCategoriesOrThreshold"]
        for child, left in ((node["leftChild"], True), (node["rightChild"], False)):
            low, high, allowed, share = conditions.get(i, (-np.inf, np.inf, None, 1.0))
            if split["numCategories"] < 0:
                low, high = (low, min(high, edges[0])) if left else (max(low, edges[0]), high)
            else:
                passing = np.zeros(split["numCategories"], bool)
                passing[np.array(edges, int)] = True
                passing = passing if left else ~passing
                allowed = passing if allowed is None else allowed & passing
            todo.append((child, conditions | {i: (low, high, allowed, share * nodes[child]["rawCount"] / node["rawCount"])}))
    return found, values


def _tree(nodes: dict[int, dict], value, position: dict[int, int]) -> Tree:
    found, values = _leaves(nodes, value)
    shape = len(found), max(1, max(map(len, found)))
    tree = Tree(np.zeros(shape, np.int64), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape), np.array(values, float), {})
    for leaf, conditions in enumerate(found):
        for place, (i, (low, high, allowed, share)) in enumerate(conditions.items()):
            tree.feature[leaf, place], tree.share[leaf, place] = position[i], share
            tree.low[leaf, place], tree.high[leaf, place] = low, high
            if allowed is not None:
                tree.listed[leaf, place] = allowed
    return tree


def has_trees(model) -> bool:
    return hasattr(model, "treeWeights") or hasattr(model, "forest")


def outputs(model) -> int:
    """How many outputs of a model are explained: one per class, one for two classes and for a regression."""
    n = getattr(model, "numClasses", 0)
    return 1 if n <= 2 else n


def forest_of(spark, model) -> Forest:
    """Read a trained Spark ML forest or boosted model.

    A regression's output is its prediction, a forest classifier's the probability of each class (of the second
    one if there are two), a boosted classifier's the margin. Nodes are read from the stored form of the model.
    """
    if hasattr(model, "forest"):
        return model.forest()
    path = scratch_path(spark, "model")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").collect()
    trees: dict[int, dict[int, dict]] = {}
    for r in rows:
        node = r["nodeData"].asDict(recursive=True)
        trees.setdefault(r["treeID"], {})[node["id"]] = node
    spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).delete(
        spark._jvm.org.apache.hadoop.fs.Path(path), True)

    boosted, n_classes = "GBT" in type(model).__name__, getattr(model, "numClasses", 0)
    weights = model.treeWeights if boosted else [1 / len(trees)] * len(trees)
    classes = [0] if boosted or not n_classes else [1] if n_classes == 2 else list(range(n_classes))

    def value(weight):
        if boosted or not n_classes:
            return lambda node: [weight * node["prediction"]]
        return lambda node: [weight * node["impurityStats"][k] / sum(node["impurityStats"]) for k in classes]
    used = sorted({n["split"]["featureIndex"] for t in trees.values() for n in t.values() if n["leftChild"] >= 0})
    position = {i: k for k, i in enumerate(used)}
    return Forest([_tree(trees[i], value(weights[i]), position) for i in sorted(trees)], used, classes)


def _decisions(tree: Tree, leaf: int) -> dict[int, list[tuple]]:
    """What decides whether a row meets the features on the way to a leaf, by place: (feature, "<=" or ">" or "in", edge or categories)."""
    found: dict[int, list[tuple]] = {}
    for place, f in enumerate(tree.feature[leaf].tolist()):
        low, high = tree.low[leaf, place], tree.high[leaf, place]
        # "x > edge" is the contrary of "x <= edge": one decision for both.
        parts = [(f, "<=", edge, wanted) for edge, wanted in ((low, False), (high, True)) if np.isfinite(edge)]
        if (leaf, place) in tree.listed:
            parts.append((f, "in", tree.listed[leaf, place].tobytes(), True))
        if parts:
            found[place] = parts
    return found


def _groups(tree: Tree) -> tuple[list[tuple[list[tuple], list[tuple[int, dict]]]], list[int]]:
    """Neighbouring leaves with at most DECISIONS decisions in all: [(decisions, [(leaf, its decisions)])]; leaves with more alone."""
    groups, alone = [], []
    for leaf in range(len(tree.value)):
        mine = _decisions(tree, leaf)
        own = {p[:3] for parts in mine.values() for p in parts}
        if len(own) > DECISIONS:
            alone.append(leaf)
        elif own:
            if not groups or len(groups[-1][0] | own) > DECISIONS:
                groups.append((set(), []))
            groups[-1][0].update(own)
            groups[-1][1].append((leaf, mine))
    return [(sorted(d, key=repr), members) for d, members in groups], alone


def _rule(places: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights that integrate the polynomial of so many features from 0 to 1."""
    n = (places + 1) // 2
    if n not in RULES:
        nodes, weights = np.polynomial.legendre.leggauss(n)
        RULES[n] = (nodes + 1) / 2, weights / 2
    return RULES[n]


def _outcomes(n: int) -> np.ndarray:
    """(decision, outcome): whether a decision holds in each of the 2 ** n outcomes."""
    return (np.arange(1 << n) >> np.arange(n)[:, None] & 1).astype(bool)


def _leaf_gains(shares: np.ndarray) -> np.ndarray:
    """(place, outcome): Shapley value of each of a leaf's features for a leaf value of one; bit i of an outcome is whether feature i is met."""
    n = len(shares)
    points, weights = _rule(n)
    factor = shares[:, None, None] * (1 - points) + np.array([0.0, 1.0])[:, None] * points   # (place, met, point)
    whole = np.ones((1, len(points)))
    for i in range(n):
        whole = (factor[i][:, None, :] * whole).reshape(-1, len(points))
    gain = (np.array([0.0, 1.0]) - shares[:, None])[:, :, None] * weights / factor
    out = (gain.reshape(2 * n, -1) @ whole.T).reshape(n, 2, -1)
    return np.where(_outcomes(n), out[:, 1], out[:, 0])


def _listed(tree: Tree, decisions: list[tuple], members: list[tuple[int, dict]]) -> dict[tuple[int, int], np.ndarray]:
    """{(feature, output): value for each outcome of the decisions}, summed over the leaves."""
    bits = dict(zip(decisions, _outcomes(len(decisions))))
    found: dict[tuple[int, int], np.ndarray] = {}
    for leaf, mine in members:
        places = list(mine)
        at = np.zeros(1 << len(decisions), np.int64)
        for i, place in enumerate(places):
            met = np.logical_and.reduce([bits[d] if wanted else ~bits[d] for *d, wanted in mine[place] for d in [tuple(d)]])
            at += met * (1 << i)
        gains = _leaf_gains(tree.share[leaf, places])
        for k in np.flatnonzero(tree.value[leaf]).tolist():
            for f, gain in zip(tree.feature[leaf, places].tolist(), (gains * tree.value[leaf, k]).take(at, axis=1)):
                if (f, k) in found:
                    found[f, k] += gain
                else:
                    found[f, k] = gain.copy()
    return found


def contributions(tree: Tree, x: np.ndarray, n_features: int) -> np.ndarray:
    """(row, feature, output): exact Shapley values of one tree for a matrix of rows."""
    if len(x) < LISTED_FROM:
        return _summed(tree, x, n_features)
    columns, out = np.ascontiguousarray(x.T), np.zeros((n_features, tree.value.shape[1], len(x)))
    groups, alone = _groups(tree)
    for decisions, members in groups:
        outcome = np.zeros(len(x), np.int16)
        for i, (f, sign, edge) in enumerate(decisions):
            holds = columns[f] <= edge if sign == "<=" else np.frombuffer(edge, bool)[columns[f].astype(int)]
            outcome |= holds.astype(np.int16) << np.int16(i)
        outcome = outcome.astype(np.intp)
        for (f, k), values in _listed(tree, decisions, members).items():
            out[f, k] += values.take(outcome)
    out = np.moveaxis(out, 2, 0)
    if alone:
        few = Tree(*[a[alone] for a in (tree.feature, tree.low, tree.high, tree.share, tree.value)],
                   {(alone.index(leaf), place): a for (leaf, place), a in tree.listed.items() if leaf in alone})
        out = out + _summed(few, x, n_features)
    return out


def _summed(tree: Tree, x: np.ndarray, n_features: int) -> np.ndarray:
    """``contributions``, leaf by leaf for every row."""
    leaves, places = tree.feature.shape
    points, weights = _rule(places)
    share = tree.share[None, :, :, None]
    out = np.zeros((len(x), n_features, tree.value.shape[1]))
    step = max(1, CELLS // (leaves * places * len(points)))
    for at in range(0, len(x), step):
        cell = x[at:at + step][:, tree.feature]
        meets = (cell > tree.low) & (cell <= tree.high)
        for (leaf, place), allowed in tree.listed.items():
            meets[:, leaf, place] &= allowed[cell[:, leaf, place].astype(int)]
        passes = meets[..., None].astype(float)
        # What is left of a feature's factor between being out (its share) and in (met or not).
        factor = share * (1 - points) + passes * points
        rest = factor.prod(axis=2, keepdims=True) / factor @ weights[:, None]
        # Unused places have share one and are met: nothing comes of them.
        gain = (meets - tree.share) * rest[..., 0]
        for k in range(tree.value.shape[1]):
            each = gain * tree.value[:, k][None, :, None]
            rows = np.repeat(np.arange(len(each)), leaves * places) * n_features + np.tile(tree.feature.ravel(), len(each))
            out[at:at + step, :, k] += np.bincount(rows, each.ravel(), len(each) * n_features).reshape(len(each), n_features)
    return out


def _chunks(batches, rows: int):
    """The batches of a task as tables of ``rows`` rows, the last one of fewer."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, rows - n))
            n += held[-1].num_rows
            batch = batch.slice(held[-1].num_rows)
            if n == rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def shapley_values(model, rows: DataFrame) -> DataFrame:
    """(key, class, place, contribution, base_value): exact Shapley values of every row of ``rows``.

    ``place`` is the position in the feature vector; features that no tree uses contribute nothing and have no
    row. Contributions and base value add up to the output. What is left out of a row is replaced by the training
    rows that went the same way in each tree, by their counts in the model. Rows need key and features; they
    stay distributed, and the model's trees go to each task.
    """
    spark = rows.sparkSession
    forest = forest_of(spark, model)
    if not forest.used:
        schema = f"key {rows.schema['key'].dataType.simpleString()}, class int, place int, contribution double, base_value double"
        return spark.createDataFrame([], schema)
    # As bytes with their classes, which executors need no copy of.
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(forest))
    column = model.getFeaturesCol() if hasattr(model, "getFeaturesCol") else model.features_col
    cut = VectorSlicer(inputCol=column, outputCol="_used", indices=forest.used).transform(rows)
    # Little to read and much to compute: a task per core at least.
    n = max(-(-rows.count() // ROWS_PER_TASK), spark.sparkContext.defaultParallelism)
    cut = cut.select("key", vector_to_array("_used").alias("x")).repartition(n, "key")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches):
        forest = cloudpickle.loads(sent.value)
        base, width, outputs = forest.base(), len(forest.used), len(forest.classes)
        most, step = max(1, KEPT_CELLS // (width * outputs)), max(1, CELLS // (width * outputs))
        for whole in _chunks(batches, most):
            x = whole.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            found = np.zeros((len(x), width, outputs))
            for tree in forest.trees:
                found += contributions(tree, x, width)
            for at in range(0, len(x), step):
                part = found[at:at + step]
                keys = whole.column("key").slice(at, step).combine_chunks().take(pa.array(np.repeat(np.arange(len(part)), width * outputs)))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(np.tile(np.array(forest.classes, np.int32), len(part) * width)),
                     pa.array(np.tile(np.repeat(np.array(forest.used, np.int32), outputs), len(part))),
                     pa.array(part.ravel()), pa.array(np.tile(base, len(part) * width))],
                    names=["key", "class", "place", "contribution", "base_value"])
    return cut.mapInArrow(run, f"key {kind}, class int, place int, contribution double, base_value double")
