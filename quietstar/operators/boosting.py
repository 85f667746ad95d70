"""Gradient boosted trees over histograms, several models in one training.

Features are binned once, at exact quantiles, and rows with equal bins, label and training sets become one weighted cell, so a
round costs as much as there are distinct cells and not as there are rows. Each level of a tree is one Spark job over the
stored cells that adds up the gradient histograms of all models together (the folds of a cross-validation and the final model,
told apart by a bit each); only the histograms, whose size rests on the parameters alone, reach the driver, which picks the
splits. Running margins stay in the tasks and are written to the shared folder every ``WRITTEN`` rounds, which keeps the plan
short and survives lost executors. Up to ``CELLS`` cells, counted first, are one block; there is nothing to add up then, and the
same steps run in a task for each model, many rounds at a time, to the same trees.

Gradients are rounded to a fixed grain, so sums don't rest on the order in which tasks end, and rows are drawn by a hash of
their cell: the same table gives the same trees however it is partitioned.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_back
from . import ranking

#: Cells for one task, and rounds between two writes of the margins: where jobs add up blocks, and where one block is all.
CELLS = 500_000
WRITTEN = 16
TOGETHER = 50
GRAIN = float(1 << 20)
_PLACE = np.uint64(0x9E3779B97F4A7C15)


# bins and cells -----------------------------------------------------------------------------


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Per feature at most ``bins - 1`` ascending edges, exact quantiles; a value's bin is the number of edges below it."""
    tall = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(features)])).alias("x")).select("x.f", "x.v")
    shares = {f"p{i}": i / (bins - 1) for i in range(bins - 1)}
    found = {r["f"]: sorted({r[p] for p in shares}) for r in ranking.exact_percentiles(tall, ["f"], "v", shares).collect()}
    return [found.get(i, []) for i in range(len(features))]


def bin_column(value: Column, edges: Sequence[float], first: int = 0) -> Column:
    """The number of ``edges`` below a value, by nested comparisons that stay in generated code."""
    if not edges:
        return F.lit(first)
    middle = len(edges) // 2
    return F.when(value <= F.lit(edges[middle]), bin_column(value, edges[:middle], first)).otherwise(bin_column(value, edges[middle + 1 :], first + middle + 1))


def _to_block(models: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = [b.to_pandas() for b in batches if b.num_rows]
        if not frames:
            return
        table = pd.concat(frames)
        bins = table.filter(regex="^bin").to_numpy().T.astype(np.uint8)
        block = {
            "bins": np.ascontiguousarray(bins), "label": table["label"].to_numpy(float), "rows": table["rows"].to_numpy(np.int64),
            "mask": table["mask"].to_numpy(np.int64), "margin": np.zeros((models, len(table))),
            "own": _mixed(np.concatenate([bins.astype(np.uint64), table[["label", "mask"]].to_numpy().T.astype(np.uint64)])),
        }
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], ["block"])

    return run


def _each_block(run: Callable[[int, dict], tuple[list, dict]]):
    """Trees and the block after them, of each model's block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model, packed in zip(batch.column(0), batch.column(1), strict=True):
                done = [pickle.dumps(x) for x in run(model.as_py(), pickle.loads(packed.as_py()))]
                columns = [pa.array([model.as_py()], pa.int32()), *[pa.array([x], pa.binary()) for x in done]]
                yield pa.RecordBatch.from_arrays(columns, ["model", "trees", "block"])

    return work


def _mixed(parts: np.ndarray) -> np.ndarray:
    out = np.zeros(parts.shape[1], np.uint64)
    for part in parts:
        out = (out ^ part) * _PLACE
        out ^= out >> np.uint64(29)
    return out


# work inside tasks --------------------------------------------------------------------------


def _uniform(own: np.ndarray, *salts: int) -> np.ndarray:
    mixed = own.copy()
    for salt in salts:
        mixed = (mixed ^ np.uint64(salt + 1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(29)
    return ((mixed >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def drawn_rows(own: np.ndarray, rows: np.ndarray, share: float, *salts: int) -> np.ndarray:
    """How many of a cell's rows take part, each with chance ``share``: counted up to eight rows, by the normal law beyond."""
    if share >= 1:
        return rows
    out, some = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for i in range(min(8, int(rows.max(initial=0)))):
        some = some[rows[some] > i]
        out[some] += _uniform(own[some], *salts, i) < share
    many = rows > 8
    normal = np.sqrt(-2 * np.log(_uniform(own[many], *salts, 8))) * np.cos(2 * np.pi * _uniform(own[many], *salts, 9))
    out[many] = np.clip(np.rint(rows[many] * share + normal * np.sqrt(rows[many] * share * (1 - share))), 0, rows[many])
    return out


def descend(bins: np.ndarray, feature: np.ndarray, threshold: np.ndarray, levels: int) -> np.ndarray:
    """The node of each column of ``bins`` after at most ``levels`` splits of one tree."""
    at = np.zeros(bins.shape[1], np.int64)
    every = np.arange(bins.shape[1])
    for _ in range(levels):
        by = feature[at]
        right = bins[by, every] > threshold[at]
        at = np.where(by >= 0, 2 * at + 1 + right, at)
    return at


@dataclass
class Tree:
    """One round: a full binary tree for each model; ``feature`` is -1 at leaves, ``value`` is what a leaf adds."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, models: int, depth: int) -> Tree:
        shape = models, 2 ** (depth + 1) - 1
        return cls(np.full(shape, -1, np.int8), np.zeros(shape, np.uint8), np.zeros(shape), np.zeros(shape))


def _advance(tree: Tree, depth: int, block: dict) -> dict:
    """A block with the margins after a round."""
    margin = block["margin"].copy()
    for m in range(len(margin)):
        margin[m] += tree.value[m][descend(block["bins"], tree.feature[m], tree.threshold[m], depth)]
    return block | {"margin": margin}


#: Numbers of models and what their positive rows weigh.
Models = Sequence[tuple[int, float]]


def _gradients(models: Models, share: float, salts: tuple[int, int], block: dict) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each model the cells it learns from in a round, with their gradients and curvatures."""
    out = []
    for i, (m, weight) in enumerate(models):
        some = np.flatnonzero(block["mask"] >> m & 1)
        label = block["label"][some]
        rows = drawn_rows(block["own"][some], block["rows"][some], share, *salts, m) * np.where(label > 0, weight, 1.0)
        chance = 1 / (1 + np.exp(-block["margin"][i, some]))
        out.append((some, *(np.rint(x * GRAIN) / GRAIN for x in (rows * (chance - label), rows * chance * (1 - chance)))))
    return out


def _histograms(tree: Tree, level: int, bins: int, gradients: list[tuple[np.ndarray, np.ndarray, np.ndarray]], block: dict) -> np.ndarray:
    """Sums of gradient and curvature by model, node of ``level``, feature and bin."""
    first, width = 2**level - 1, len(block["bins"])
    out = np.zeros((len(gradients), 2**level, width, bins, 2))
    for i, (some, *sums) in enumerate(gradients):
        codes = block["bins"][:, some]
        node = descend(codes, tree.feature[i], tree.threshold[i], level) - first
        there = node >= 0
        if not there.all():
            codes, node, sums = codes[:, there], node[there], [x[there] for x in sums]
        for f in range(width):
            key = node * bins + codes[f]
            for j, x in enumerate(sums):
                out[i, :, f, :, j] = np.bincount(key, x, minlength=2**level * bins).reshape(-1, bins)
    return out


def _node_sums(node: np.ndarray, nodes: int, bins: int, codes: np.ndarray, sums: Sequence[np.ndarray]) -> np.ndarray:
    """Sums by node, feature and bin."""
    out = np.zeros((nodes, len(codes), bins, len(sums)))
    for f, code in enumerate(codes):
        key = node * bins + code
        for j, x in enumerate(sums):
            out[:, f, :, j] = np.bincount(key, x, minlength=nodes * bins).reshape(-1, bins)
    return out


def _level_sums(bins: int, gradients: tuple[np.ndarray, np.ndarray, np.ndarray], block: dict) -> Callable[[Tree, int], np.ndarray]:
    """What ``_histograms`` gives for one model, called level by level as its tree grows.

    Cells move down with the tree. Of two children the one with fewer cells is added up and the other is what their parent has
    besides, which is exact because gradients lie on the grain.
    """
    some, *sums = gradients
    codes, at, above = block["bins"][:, some], np.zeros(len(some), np.int64), None

    def run(tree: Tree, level: int) -> np.ndarray:
        nonlocal codes, at, sums, above
        if above is None:
            above = _node_sums(at, 1, bins, codes, sums)
            return above[None]
        by = tree.feature[0][at]
        moving = by >= 0
        if not moving.all():
            codes, at, by, sums = codes[:, moving], at[moving], by[moving], [x[moving] for x in sums]
        at = 2 * at + 1 + (codes[by, np.arange(len(at))] > tree.threshold[0][at])
        node, nodes = at - (2**level - 1), 2**level
        cells = np.bincount(node, minlength=nodes).reshape(-1, 2)
        fewer = cells.argmin(axis=1)
        less = np.flatnonzero(node & 1 == fewer[node >> 1])
        part = _node_sums(node[less] >> 1, nodes // 2, bins, codes[:, less], [x[less] for x in sums])
        out, each = np.zeros((nodes, *above.shape[1:])), np.arange(nodes // 2)
        out[2 * each + fewer] = part
        out[2 * each + 1 - fewer] = np.where(cells.any(axis=1)[:, None, None, None], above - part, 0)
        above = out
        return above[None]

    return run


def _block_sums(tree: Tree, level: int, bins: int, models: Models, share: float, salts: tuple[int, int], block: dict) -> np.ndarray:
    return _histograms(tree, level, bins, _gradients(models, share, salts, block), block)


# training -----------------------------------------------------------------------------------


def best_splits(sums: np.ndarray, allowed: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, feature and last bin to the left of the best split of each (model, node); no gain where none is worth it."""
    below = sums.cumsum(axis=3)[..., :-1, :]
    total = sums.sum(axis=3, keepdims=True)
    above = total - below
    worth = lambda s: s[..., 0] ** 2 / (s[..., 1] + ridge)
    gain = worth(below) + worth(above) - worth(total)
    gain[(below[..., 1] < least) | (above[..., 1] < least) | ~allowed[:, None, :, None]] = 0
    flat = gain.reshape(*gain.shape[:2], -1)
    best = flat.argmax(axis=2)
    return np.take_along_axis(flat, best[..., None], 2)[..., 0], best // gain.shape[3], best % gain.shape[3]


@dataclass
class BoostedModel:
    """The trees of all models with the bins they split on. ``features`` names the columns that are scored."""

    features: list[str]
    edges: list[list[float]]
    depth: int
    rounds: list[Tree] = field(default_factory=list)

    def margins(self, codes: np.ndarray, model: np.ndarray | int = 0) -> np.ndarray:
        """Sums of leaves for columns of bins; ``model`` is one number or one for each column."""
        out = np.zeros(codes.shape[1])
        which = np.broadcast_to(np.asarray(model), out.shape)
        for m in np.unique(which):
            own = np.flatnonzero(which == m)
            for tree in self.rounds:
                out[own] += tree.value[m][descend(codes[:, own], tree.feature[m], tree.threshold[m], self.depth)]
        return out

    def transform(self, df: DataFrame, model: Column | int = 0, probability: str = "probability") -> DataFrame:
        """``df`` with the chance of the positive class under a model: one for all rows or a number on each."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def score(packed: pd.DataFrame) -> pd.Series:
            # Rows of a batch that share bins are scored once.
            cells, inverse = np.unique(packed.to_numpy(), axis=0, return_inverse=True)
            margin = shared.value.margins(np.ascontiguousarray(cells[:, 1:].T), cells[:, 0])
            return pd.Series((1 / (1 + np.exp(-margin)))[inverse.ravel()])

        number = model if isinstance(model, Column) else F.lit(model)
        codes = [bin_column(F.col(c), e).cast("int").alias(f"bin{i}") for i, (c, e) in enumerate(zip(self.features, self.edges, strict=True))]
        return df.withColumn(probability, score(F.struct(number.cast("int").alias("model"), *codes)))

    def importances(self, model: int = 0) -> dict[str, float]:
        """Share of the gain of all splits by feature; even where nothing was split."""
        gains = np.zeros(len(self.features))
        for tree in self.rounds:
            split = tree.feature[model] >= 0
            np.add.at(gains, tree.feature[model][split], tree.gain[model][split])
        gains = gains / gains.sum() if gains.sum() else np.full(len(gains), 1 / len(gains))
        return dict(zip(self.features, gains.tolist(), strict=True))

    def node_table(self, spark: SparkSession) -> DataFrame:
        """The trees as a table: model, round, node (children of ``i`` are ``2i+1`` and ``2i+2``), feature and largest value to the
        left, or what a leaf adds."""
        rows = []
        for number, tree in enumerate(self.rounds):
            for m, node in zip(*np.nonzero((tree.feature >= 0) | (tree.value != 0)), strict=True):
                f = int(tree.feature[m, node])
                split = (self.features[f], self.edges[f][int(tree.threshold[m, node])]) if f >= 0 else (None, None)
                rows.append((int(m), number, int(node), *split, float(tree.value[m, node]), float(tree.gain[m, node])))
        return spark.createDataFrame(rows, "model int, round int, node int, feature string, up_to double, adds double, gain double")


class GBTClassifier:
    """Boosted trees under logistic loss. Parameters carry the names they have in Spark's own trainer."""

    def __init__(
        self, *, featuresCol: Sequence[str], labelCol: str = "label", maxIter: int = 300, maxDepth: int = 5, stepSize: float = 0.05,
        subsamplingRate: float = 0.8, featureSubsetStrategy: float = 0.8, maxBins: int = 32, ridge: float = 1.0, minWeight: float = 1.0, seed: int = 42,
    ):
        self.features, self.label, self.rounds, self.depth, self.step = list(featuresCol), labelCol, maxIter, maxDepth, stepSize
        self.row_share, self.feature_share, self.bins, self.ridge, self.least, self.seed = subsamplingRate, featureSubsetStrategy, maxBins, ridge, minWeight, seed

    def cells(self, df: DataFrame, edges: list[list[float]], training: Sequence[Column]) -> DataFrame:
        """Rows counted by bins, label and ``mask``, which has a bit for each model that learns from them."""
        mask = sum((F.shiftleft(c.cast("long"), m) for m, c in enumerate(training)), F.lit(0).cast("long"))
        codes = [bin_column(F.col(c).cast("double"), e).cast("int").alias(f"bin{i}") for i, (c, e) in enumerate(zip(self.features, edges, strict=True))]
        rows = df.select(*codes, F.col(self.label).cast("int").alias("label"), mask.alias("mask")).where("mask <> 0")
        return rows.groupBy(*[f"bin{i}" for i in range(len(codes))], "label", "mask").agg(F.count(F.lit(1)).alias("rows"))

    def fit(self, df: DataFrame, training: Sequence[Column]) -> BoostedModel:
        """One model for each condition in ``training`` (63 at most), on the rows for which it holds; positives weigh as much as
        negatives in each."""
        spark, models = df.sparkSession, len(training)
        edges = quantile_edges(df, self.features, self.bins)
        model = BoostedModel(self.features, edges, self.depth)
        cells = read_back(spark, self.cells(df, edges, training), "cells")
        count = lambda m, y: F.sum(F.when((F.col("label") == y) & (F.shiftright("mask", m) % 2 == 1), F.col("rows")).otherwise(0))
        totals = cells.agg(F.count(F.lit(1)), *[count(m, y) for m in range(models) for y in (0, 1)]).first()
        counts = [int(x or 0) for x in totals[1:]]
        weights = [no / yes if yes else 1.0 for no, yes in zip(counts[::2], counts[1::2], strict=True)]
        if not totals[0]:
            return model
        parts = -(-totals[0] // CELLS)
        alone = parts == 1
        if not alone:  # blocks of half the size or more where that keeps more cores busy
            parts = min(2 * parts, max(parts, spark.sparkContext.defaultParallelism))
        laid = cells.repartition(parts, *[c for c in cells.columns if c != "rows"])
        blocks = read_back(spark, laid.mapInArrow(_to_block(1 if alone else models), "block binary"), "blocks")
        grow = self._in_one_task if alone else self._over_tasks
        model.rounds.extend(grow(spark, blocks, list(enumerate(weights)), max(len(e) for e in edges) + 1))
        return model

    def _in_one_task(self, spark: SparkSession, blocks: DataFrame, models: Models, bins: int) -> list[Tree]:
        """One block holds all cells, so its sums are complete: a task for each model goes on by itself for ``TOGETHER`` rounds."""
        out: list[Tree] = []
        blocks = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(len(models) - 1))).alias("model"), "block").repartition(len(models))
        for first in range(0, self.rounds, TOGETHER):
            run = partial(self._rounds, range(first, min(first + TOGETHER, self.rounds)), models, bins)
            done = read_back(spark, blocks.mapInArrow(_each_block(run), "model int, trees binary, block binary"), "rounds")
            grown = [pickle.loads(row[0]) for row in done.orderBy("model").select("trees").collect()]
            out.extend(Tree(*map(np.concatenate, zip(*trees, strict=True))) for trees in zip(*grown, strict=True))
            blocks = done.select("model", "block")
        return out

    def _rounds(self, numbers: range, models: Models, bins: int, model: int, block: dict) -> tuple[list[tuple], dict]:
        trees: list[Tree] = []
        for number in numbers:
            sums = _level_sums(bins, _gradients([models[model]], self.row_share, (self.seed, number), block)[0], block)
            trees.append(self._grow(sums, number, len(models), [model]))
            block = _advance(trees[-1], self.depth, block)
        return [(t.feature, t.threshold, t.value, t.gain) for t in trees], block

    def _over_tasks(self, spark: SparkSession, blocks: DataFrame, models: Models, bins: int) -> list[Tree]:
        """A job for each level adds up the sums of all blocks."""
        state, filled, out = self._state(blocks), [], []
        for number in range(self.rounds):
            sums = lambda tree, level, state=state, number=number: state.map(
                partial(_block_sums, tree, level, bins, models, self.row_share, (self.seed, number))
            ).treeReduce(np.add)
            tree = self._grow(sums, number, len(models), range(len(models)))
            out.append(tree)
            # The first job of a round fills its state from the one before, which can go then.
            for old in filled:
                old.unpersist()
            filled, state = [state], state.map(partial(_advance, tree, self.depth)).persist(StorageLevel.MEMORY_AND_DISK)
            if number % WRITTEN == WRITTEN - 1 and number + 1 < self.rounds:
                packed = spark.createDataFrame(state.map(lambda b: (pickle.dumps(b),)), "block binary")
                filled, state = [*filled, state], self._state(read_back(spark, packed, "margins"))
        for old in [*filled, state]:
            old.unpersist()
        return out

    def _state(self, blocks: DataFrame) -> RDD:
        return blocks.rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)

    def _grow(self, sums_of: Callable[[Tree, int], np.ndarray], number: int, total: int, grown: Sequence[int]) -> Tree:
        """A tree for each of the models ``grown`` of ``total``; ``sums_of`` gives the histograms of a level of the tree so far."""
        width = len(self.features)
        draw = np.random.default_rng([self.seed, number])
        taken = max(1, round(self.feature_share * width))
        allowed = np.zeros((total, width), bool)
        for m in range(total):
            allowed[m, draw.permutation(width)[:taken]] = True
        allowed, models = allowed[list(grown)], len(grown)
        tree = Tree.empty(models, self.depth)
        alive = np.ones((models, 1), bool)
        for level in range(self.depth):
            sums = sums_of(tree, level)
            first = 2**level - 1
            if level == 0:
                whole = sums[:, 0, 0].sum(axis=1)
                tree.value[:, 0] = -self.step * whole[:, 0] / (whole[:, 1] + self.ridge)
            gain, feature, last = best_splits(sums, allowed, self.ridge, self.least)
            split = alive & (gain > 1e-12)
            next_alive = np.zeros((models, 2 ** (level + 1)), bool)
            for m, node in zip(*np.nonzero(split), strict=True):
                at, f, b = first + node, feature[m, node], last[m, node]
                tree.feature[m, at], tree.threshold[m, at], tree.gain[m, at], tree.value[m, at] = f, b, gain[m, node], 0
                left, total = sums[m, node, f, : b + 1].sum(axis=0), sums[m, node, f].sum(axis=0)
                for child, s in ((2 * at + 1, left), (2 * at + 2, total - left)):
                    tree.value[m, child] = -self.step * s[0] / (s[1] + self.ridge)
                next_alive[m, [2 * node, 2 * node + 1]] = True
            alive = next_alive
            if not alive.any():
                break
        return tree
