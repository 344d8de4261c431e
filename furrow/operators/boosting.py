"""Boosted regression trees over tables that do not fit in memory.

The same trees as Spark's `GBTRegressor` grows for squared errors, with all rows and
features in every split: thresholds from a bounded sample of rows, histograms per node,
feature and bin, the best split by variance. Spark keeps an object per row in memory; here
rows are stored in blocks of numbers (a byte per feature and the residual), each level of a
tree is one pass over them, and a pass gives one histogram per task. What the driver holds
is bounded by bins, features and nodes.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import persist_reliably, release

# Task functions travel with the job: executors need not have this package.
register_pickle_by_value(sys.modules[__name__])

# Rows of a block, and rows from which thresholds are found at least.
BLOCK_ROWS = 32_768
SAMPLE_ROWS = 10_000
_BLOCKS = pa.schema([("bins", pa.binary()), ("residual", pa.binary())])
BLOCKS = "bins binary, residual binary"
_EPSILON = float(np.finfo(float).eps)


@dataclass
class Node:
    """A node with count, sum and sum of squares of its rows; a leaf has no feature."""

    stats: np.ndarray
    feature: int | None = None
    bin: int = 0
    gain: float = 0.0
    left: Node | None = None
    right: Node | None = None

    @property
    def prediction(self) -> float:
        return float(self.stats[1] / self.stats[0]) if self.stats[0] else 0.0

    @property
    def impurity(self) -> float:
        return _variance(self.stats)


def _variance(stats: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(stats[0] == 0, 0.0, (stats[2] - stats[1] * stats[1] / stats[0]) / stats[0])[()]


def thresholds_of(values: np.ndarray, expected: float, most: int) -> np.ndarray:
    """At most `most` thresholds between the sampled values; `expected` rows were to be sampled, those missing count as zeros."""
    kept = values[values != 0]
    distinct, counts = np.unique(kept, return_counts=True)
    counts = counts.astype(float)
    zeros = expected - len(kept)
    if zeros > _EPSILON * len(kept) * len(kept):
        at = int(np.searchsorted(distinct, 0.0))
        distinct, counts = np.insert(distinct, at, 0.0), np.insert(counts, at, zeros)
    middle = (distinct[:-1] + distinct[1:]) / 2.0
    if len(distinct) - 1 <= most:
        return middle
    stride, found = expected / (most + 1), []
    current, target = counts[0], stride
    for i in range(1, len(distinct)):
        previous, current = current, current + counts[i]
        if abs(previous - target) < abs(current - target):
            found.append(middle[i - 1])
            target += stride
    return np.array(found)


def _packer(thresholds: list[np.ndarray]) -> Callable:
    """Rows as blocks: the bin of every feature, one feature after the other, and the label, which is the first residual."""

    def block(rows: pa.Table) -> pa.RecordBatch:
        columns = [rows[i].to_numpy() for i in range(len(thresholds) + 1)]
        bins = b"".join(np.searchsorted(t, c, "left").astype(np.uint8).tobytes() for t, c in zip(thresholds, columns))
        label = columns[-1].astype("<f8").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (bins, label)], schema=_BLOCKS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= BLOCK_ROWS:
                yield block(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield block(pa.Table.from_batches(held))

    return pack


def _flat(root: Node) -> tuple[list[Node], np.ndarray, np.ndarray, np.ndarray]:
    """The nodes, and feature, bin and left child of each (the right one follows); leaves lead to themselves."""
    nodes, at = [root], 0
    feature, cut, child = [], [], []
    while at < len(nodes):
        node = nodes[at]
        feature.append(node.feature or 0)
        cut.append(255 if node.feature is None else node.bin)
        child.append(at if node.feature is None else len(nodes))
        if node.feature is not None:
            nodes += [node.left, node.right]
        at += 1
    return nodes, np.array(feature), np.array(cut, np.uint8), np.array(child)


def _places(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, depth: int) -> np.ndarray:
    """The node each row has come to."""
    rows = np.arange(bins.shape[1])
    place = np.zeros(bins.shape[1], np.int64)
    for _ in range(depth):
        place = child[place] + (bins[feature[place], rows] > cut[place])
    return place


def _read(batch: pa.RecordBatch, features: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for bins, residual in zip(batch["bins"], batch["residual"]):
        yield np.frombuffer(bins.as_buffer(), np.uint8).reshape(features, -1), np.frombuffer(residual.as_buffer(), "<f8")


def _counter(features: int, bins_most: int, tree: tuple, depth: int, open_nodes: np.ndarray) -> Callable:
    """Count, sum and sum of squares of the residuals per open node, feature and bin: one histogram per task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(len(tree[0]), -1)
        number[open_nodes] = np.arange(len(open_nodes))
        cells = len(open_nodes) * bins_most
        total = np.zeros((3, features, cells))
        for batch in batches:
            for bins, residual in _read(batch, features):
                node = number[_places(bins, *tree, depth)] * bins_most
                inside = node >= 0
                if not inside.all():
                    bins, node, residual = bins[:, inside], node[inside], residual[inside]
                squares = residual * residual
                for f in range(features):
                    cell = node + bins[f]
                    for k, weight in enumerate((None, residual, squares)):
                        total[k, f] += np.bincount(cell, weight, cells)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["histogram"])

    return count


def _updater(features: int, tree: tuple, depth: int, values: np.ndarray) -> Callable:
    """Blocks with the residuals that `values` of a finished tree leave."""

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (bins, residual) in enumerate(_read(batch, features)):
                left = residual - values[_places(bins, *tree, depth)]
                yield pa.RecordBatch.from_arrays([batch["bins"].slice(row, 1), pa.array([left.tobytes()], pa.binary())], schema=_BLOCKS)

    return update


def _split(histogram: np.ndarray, n_splits: list[int], known: Node | None) -> tuple[Node, np.ndarray, np.ndarray] | Node:
    """The best split of a node from its histogram (3, features, bins), as the node and its children's stats."""
    best = None
    for f, n in enumerate(n_splits):
        if not n:
            continue
        sums = np.cumsum(histogram[:, f, : n + 1], axis=1)
        left = sums[:, :n]
        right = sums[:, n:] - left
        parent = known.stats[:, None] if known is not None else left + right
        whole = left[0] + right[0]
        gain = _variance(parent) - left[0] / whole * _variance(left) - right[0] / whole * _variance(right)
        gain = np.where((left[0] < 1) | (right[0] < 1) | (gain < 0), -np.inf, gain)
        at = int(np.argmax(gain))
        if best is None or gain[at] > best[0]:
            best = (float(gain[at]), f, at, left[:, at], right[:, at])
    stats = known.stats if known is not None else histogram[:, 0].sum(axis=1)
    if best is None or not best[0] > 0:
        return Node(stats)
    node = Node(stats, best[1], best[2], best[0])
    node.left, node.right = Node(best[3]), Node(best[4])
    return node


def _pruned(node: Node) -> Node:
    """Leaves of one parent with one value are that parent's value."""
    if node.feature is None:
        return node
    node.left, node.right = _pruned(node.left), _pruned(node.right)
    if node.left.feature is None and node.right.feature is None and node.left.prediction == node.right.prediction:
        return Node(node.stats)
    return node


def _grow(blocks: DataFrame, n_splits: list[int], depth: int, scale: float) -> Node:
    """One tree over the residuals times `scale`, level by level."""
    bins_most = max(n_splits) + 1
    root, open_ = Node(np.zeros(3)), None
    for level in range(depth):
        nodes, *tree = _flat(root)
        numbers = [0] if open_ is None else [i for i, node in enumerate(nodes) if any(node is o for o in open_)]
        count = _counter(len(n_splits), bins_most, tuple(tree), level, np.array(numbers))
        parts = blocks.mapInArrow(count, "histogram binary").collect()
        shape = (3, len(n_splits), len(numbers), bins_most)
        histogram = sum((np.frombuffer(bytes(p.histogram)).reshape(shape) for p in parts), np.zeros(shape))
        histogram *= np.array([1.0, scale, scale * scale]).reshape(3, 1, 1, 1)
        following = []
        for i, number in enumerate(numbers):
            node = nodes[number]
            found = _split(histogram[:, :, i], n_splits, None if open_ is None else node)
            node.__dict__.update(found.__dict__)
            if node.feature is not None:
                following += [child for child in (node.left, node.right) if abs(child.impurity) >= _EPSILON]
        open_ = following
        if not open_:
            break
    return _pruned(root)


def _model(spark, booster: GBTRegressor, trees: list[Node], weights: list[float], thresholds: list[np.ndarray]) -> GBTRegressionModel:
    """The trees as a model of Spark, which scores, saves and loads like any other."""
    ml, mllib = spark._jvm.org.apache.spark.ml, spark._jvm.org.apache.spark.mllib
    gateway = spark.sparkContext._gateway

    def array(kind, values):
        out = gateway.new_array(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    def java(node: Node):
        stats = mllib.tree.impurity.VarianceCalculator(array(spark._jvm.double, [float(s) for s in node.stats]), int(node.stats[0]))
        if node.feature is None:
            return ml.tree.LeafNode(node.prediction, float(node.impurity), stats)
        split = ml.tree.ContinuousSplit(node.feature, float(thresholds[node.feature][node.bin]))
        return ml.tree.InternalNode(node.prediction, float(node.impurity), node.gain, java(node.left), java(node.right), split, stats)

    kind = ml.regression.DecisionTreeRegressionModel
    found = [kind(f"{booster.uid}_{i}", java(tree), len(thresholds)) for i, tree in enumerate(trees)]
    whole = ml.regression.GBTRegressionModel(booster.uid, array(kind, found), array(spark._jvm.double, weights), len(thresholds))
    return booster._copyValues(GBTRegressionModel(whole))


def _sample(numbers: DataFrame, share: float, seed: int) -> pa.Table:
    """The rows that Spark's trainer samples for its thresholds."""
    if share < 1:
        spark = numbers.sparkSession
        start = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        rows = numbers._jdf.toJavaRDD().sample(False, share, start)
        numbers = DataFrame(spark._jsparkSession.createDataFrame(rows, numbers._jdf.schema()), spark)
    return numbers.toArrow()


def fit(rows: DataFrame, inputs: Sequence[str], label: str, booster: GBTRegressor, n: int) -> GBTRegressionModel:
    """A boosted regression over `n` rows without empty values, by the settings of `booster`."""
    numbers = rows.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(inputs)], F.col(label).cast("double").alias("label"))
    most = min(booster.getMaxBins(), n) - 1
    wanted = max(booster.getMaxBins() ** 2, SAMPLE_ROWS)
    share = wanted / n if wanted < n else 1.0
    sample = _sample(numbers, share, booster.getSeed())
    thresholds = [thresholds_of(sample[i].to_numpy(), share * n, most) for i in range(len(inputs))]
    n_splits = [len(t) for t in thresholds]
    blocks = persist_reliably(numbers.mapInArrow(_packer(thresholds), BLOCKS))
    trees, weights = [], []
    for i in range(booster.getMaxIter()):
        # Squared errors: the first tree learns the label, the others twice what is left.
        scale, weight = (1.0, 1.0) if i == 0 else (2.0, booster.getStepSize())
        tree = _grow(blocks, n_splits, booster.getMaxDepth(), scale)
        trees.append(tree)
        weights.append(weight)
        if i + 1 < booster.getMaxIter():
            nodes, *flat = _flat(tree)
            values = np.array([node.prediction * weight for node in nodes])
            before, blocks = blocks, persist_reliably(blocks.mapInArrow(_updater(len(inputs), tuple(flat), booster.getMaxDepth(), values), BLOCKS))
            release(before)
    release(blocks)
    return _model(rows.sparkSession, booster, trees, weights, thresholds)
