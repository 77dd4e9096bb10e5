"""Second-order gradient boosting of binary labels over binned features, all folds at once.

The features of every fold are cut at quantiles into at most ``bins`` bins. Training rows lie as blocks of bin
numbers in the executors; they are never sent anywhere. A level of a tree is one job: each block adds up
gradients and curvatures per (fold, node, feature, bin), the sums of all blocks are added in a tree, and the
driver, which holds nothing but these sums, takes the split of largest gain per node. Leaves have Newton weights
with an L2 term. Rows and columns are sampled per tree by hash, so a lost block is computed anew alike. Margins
are carried on every ``ADVANCE`` trees; in between a block applies the latest trees itself.

A feature without two different values is never split, a fold of one class gets leaves of that class. The
sums have folds * nodes * features * bins entries, whatever the number of rows.
"""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 100_000
FEW_BLOCKS = 8  # so many blocks' sums are added by the driver, more of them in a tree
ADVANCE = 10
LEAST_GAIN = 1e-6

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no installation of this module


@dataclass(frozen=True)
class Settings:
    """The inventory's parameters (fixed values): 200 trees of 4 levels, rate 0.05, 0.9 of rows and columns."""

    trees: int = 200
    depth: int = 4
    rate: float = 0.05
    share: float = 0.9
    l2: float = 1.0
    least_weight: float = 1.0
    bins: int = 256
    seed: int = 42


@dataclass(frozen=True)
class Tree:
    """One tree per fold as arrays (fold, node); the children of node i are 2i + 1 and 2i + 2."""

    feature: np.ndarray  # -1 for a leaf
    bin: np.ndarray  # the right child has this bin and those above
    threshold: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty(folds: int, depth: int) -> Tree:
        shape = (folds, 2 ** (depth + 1) - 1)
        return Tree(np.full(shape, -1), np.zeros(shape, np.int64), *(np.zeros(shape) for _ in range(3)))


#: Training rows as arrays: place of the fold, bins, label, number for sampling, margin.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Model:
    folds: list[int]
    trees: list[Tree] = field(default_factory=list)

    def importance(self, features: int) -> np.ndarray:
        """(fold, feature): mean gain of the feature's splits, as shares of their sum."""
        total, splits = (np.zeros((len(self.folds), features)) for _ in range(2))
        for tree in self.trees:
            fold, node = np.nonzero(tree.feature >= 0)
            np.add.at(total, (fold, tree.feature[fold, node]), tree.gain[fold, node])
            np.add.at(splits, (fold, tree.feature[fold, node]), 1)
        mean = total / np.maximum(splits, 1)
        return mean / np.maximum(mean.sum(axis=1, keepdims=True), 1e-300)


def _mixed(numbers: np.ndarray, salt: int) -> np.ndarray:
    """Numbers from 0 to 1 that look random for each salt."""
    z = numbers.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _nodes(tree: Tree, fold: np.ndarray, right_of, levels: int) -> np.ndarray:
    node = np.zeros(len(fold), dtype=np.int64)
    for _ in range(levels):
        feature = tree.feature[fold, node]
        inner = feature >= 0
        node = np.where(inner, 2 * node + 1 + right_of(feature, node), node)
    return node


def _advanced(block: Block, trees: list[Tree], depth: int) -> Block:
    fold, bins, label, number, margin = block
    margin, rows = margin.copy(), np.arange(len(fold))
    for tree in trees:
        node = _nodes(tree, fold, lambda f, n, t=tree: bins[rows, f] >= t.bin[fold, n], depth)
        margin += tree.value[fold, node]
    return fold, bins, label, number, margin


def _sums(block: Block, latest: list[Tree], tree: Tree, turn: int, level: int, settings: Settings) -> np.ndarray:
    """(gradient or curvature, fold, node of the level, feature, bin)."""
    folds, first = tree.feature.shape[0], 2**level - 1
    fold, bins, label, number, margin = _advanced(block, latest, settings.depth)
    rows = np.arange(len(fold))
    node = _nodes(tree, fold, lambda f, n: bins[rows, f] >= tree.bin[fold, n], level) - first
    taken = (node >= 0) & (_mixed(number, settings.seed + 1 + turn) < settings.share)
    chance = 1 / (1 + np.exp(-margin[taken]))
    slot = (fold[taken] * 2**level + node[taken]) * settings.bins
    bins, weights = bins[taken], (chance - label[taken], np.maximum(chance * (1 - chance), 1e-16))
    size = folds * 2**level * settings.bins
    out = [[np.bincount(slot + bins[:, f], w, size) for f in range(bins.shape[1])] for w in weights]
    return np.array(out).reshape(2, bins.shape[1], folds, 2**level, settings.bins).transpose(0, 2, 3, 1, 4)


def _grow(tree: Tree, sums: np.ndarray, level: int, allowed: np.ndarray, cuts: np.ndarray, settings: Settings) -> None:
    """The best split of every node of the level, and the weights of its children."""
    gradient, curvature = sums
    worth = lambda g, h: g * g / (h + settings.l2)
    weight = lambda g, h: -settings.rate * g / (h + settings.l2)
    left_g, left_h = (np.cumsum(s, axis=-1)[..., :-1] for s in (gradient, curvature))
    all_g, all_h = (s.sum(axis=-1, keepdims=True) for s in (gradient, curvature))
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = worth(left_g, left_h) + worth(right_g, right_h) - worth(all_g, all_h)
    fits = (left_h >= settings.least_weight) & (right_h >= settings.least_weight) & allowed[None, None, :, None]
    gain = np.where(fits & np.isfinite(cuts)[:, None], gain, -np.inf)
    flat = gain.reshape(*gain.shape[:2], -1)
    best = flat.argmax(axis=-1)
    first = 2**level - 1
    for fold, at in np.ndindex(best.shape):
        if level == 0:
            tree.value[fold, 0] = weight(all_g[fold, 0, 0, 0], all_h[fold, 0, 0, 0])
        if flat[fold, at, best[fold, at]] <= LEAST_GAIN:
            continue
        f, b = divmod(int(best[fold, at]), gain.shape[-1])
        node = first + at
        tree.feature[fold, node], tree.bin[fold, node], tree.threshold[fold, node] = f, b + 1, cuts[fold, f, b]
        tree.gain[fold, node] = gain[fold, at, f, b]
        tree.value[fold, 2 * node + 1] = weight(left_g[fold, at, f, b], left_h[fold, at, f, b])
        tree.value[fold, 2 * node + 2] = weight(right_g[fold, at, f, b], right_h[fold, at, f, b])


def cut_points(train: DataFrame, bins: int) -> DataFrame:
    """(fold, feature, cuts) of rows (fold, values): the values at places floor(j * n / bins) of each sorted feature."""
    long = train.select("fold", F.posexplode("values").alias("feature", "x"))
    order = Window.partitionBy("fold", "feature")
    placed = long.select(
        "fold", "feature", "x", (F.row_number().over(order.orderBy("x")) - 1).alias("at"), F.count("*").over(order).alias("n")
    )
    j = F.greatest(F.ceil(F.col("at") * bins / F.col("n")), F.lit(1))
    chosen = placed.where((j < bins) & (F.floor(j * F.col("n") / bins) == F.col("at")))
    return chosen.groupBy("fold", "feature").agg(F.array_sort(F.collect_set("x")).alias("cuts"))


def _packer(folds: list[int], cuts: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if batches else None
        if table is None or not table.num_rows:
            return
        fold = np.searchsorted(folds, table.column("fold").to_numpy())
        values = np.stack(table.column("values").to_pylist())
        bins = np.zeros(values.shape, dtype=np.uint8)
        for (k, f), points in cuts.items():
            bins[fold == k, f] = np.searchsorted(points, values[fold == k, f], side="right")
        label, number = table.column("label").to_numpy().astype(np.float64), table.column("number").to_numpy()
        block = (fold, bins, label, number, np.zeros(len(fold)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

    return run


def fit(train: DataFrame, settings: Settings = Settings()) -> Model:
    """One model per fold from rows (fold, date, label, features)."""
    rows = train.select("fold", "label", vector_to_array("features").alias("values"), F.xxhash64("date").alias("number"))
    known = cut_points(rows, settings.bins).collect()
    folds = sorted({r.fold for r in known})
    if not folds:
        return Model([])
    features = 1 + max(r.feature for r in known)
    cuts = np.full((len(folds), features, settings.bins - 1), np.inf)
    for r in known:
        cuts[folds.index(r.fold), r.feature, : len(r.cuts)] = r.cuts
    points = {(k, f): cuts[k, f][np.isfinite(cuts[k, f])] for k in range(len(folds)) for f in range(features)}
    parts = max(1, math.ceil(rows.count() / BLOCK_ROWS))
    packed = rows.coalesce(parts) if parts < 64 else rows.repartition(parts)
    blocks = packed.mapInArrow(_packer(folds, points), "block binary").rdd.map(lambda r: pickle.loads(r.block)).persist()
    code = train.sparkSession.sparkContext.broadcast(cloudpickle.dumps(_sums))  # once, not with every job
    model, latest, old = Model(folds), [], None
    for number in range(settings.trees):
        tree = Tree.empty(len(folds), settings.depth)
        order = np.argsort(_mixed(np.arange(features), settings.seed + 7919 * (number + 1)))
        allowed = np.zeros(features, dtype=bool)
        allowed[order[: max(1, int(settings.share * features))]] = True
        for level in range(settings.depth):
            first = 2**level - 1
            if level and (tree.feature[:, (first - 1) // 2 : first] < 0).all():
                break
            task = (latest, tree, number, level, settings)
            part = blocks.map(lambda block, code=code, task=task: pickle.loads(code.value)(block, *task))
            sums = part.treeReduce(np.add) if parts > FEW_BLOCKS else sum(part.collect())
            _grow(tree, sums, level, allowed, cuts, settings)
        if old is not None:
            old.unpersist()
            old = None
        model.trees.append(tree)
        latest.append(tree)
        if len(latest) == ADVANCE:
            old, blocks = blocks, blocks.map(lambda b, late=tuple(latest): _advanced(b, late, settings.depth)).persist()
            latest = []
    code.unpersist()
    for held in (old, blocks):
        if held is not None:
            held.unpersist()
    return model


def scores(rows: DataFrame, model: Model) -> DataFrame:
    """(fold, date, label, score): the chance of label 1, for rows (fold, date, label, features) of the model's folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fold = np.searchsorted(model.folds, batch.column(0).to_numpy())
            values, at = np.stack(batch.column(3).to_pylist()), np.arange(batch.num_rows)
            margin = np.zeros(batch.num_rows)
            for tree in model.trees:
                depth = int(math.log2(tree.feature.shape[1] + 1)) - 1
                node = _nodes(tree, fold, lambda f, n, t=tree: values[at, f] >= t.threshold[fold, n], depth)
                margin += tree.value[fold, node]
            score = pa.array(1 / (1 + np.exp(-margin)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], score], names=["fold", "date", "label", "score"])

    asked = rows.where(F.col("fold").isin(model.folds)).select("fold", "date", "label", vector_to_array("features").alias("values"))
    return asked.mapInArrow(run, "fold int, date date, label int, score double")
