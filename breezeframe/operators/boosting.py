"""Multiclass boosting with a softmax: trees whose leaves hold a value for each class.

A level of a tree takes one pass over the rows. Tasks add up, for each node, input and bin,
the gradients of all classes; Spark adds these histograms up in a tree of tasks, and the driver,
which gets nodes x inputs x bins sums whatever the data, picks the splits. Rows never leave their tasks.

NULL and NaN are a bin of their own, the last. Classes without rows have probability 0; without
any rows all classes are alike. Splits need LEAST_ROWS on both sides. Sums of floating numbers
depend on their order, so equal gains may fall to either of two splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .models import packed

BINS, DEPTH, ROUNDS, RATE, L2, LEAST_ROWS = 32, 3, 40, 0.2, 3.0, 25
CLASSES = 6


@dataclass(frozen=True)
class Tree:
    """Nodes in heap order: a row goes right where its bin of `feature` is above `cut`; values (leaf, class)."""

    feature: np.ndarray
    cut: np.ndarray
    values: np.ndarray

    def leaves(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The place of each row among the nodes of a depth."""
        node, rows = np.zeros(len(bins), int), np.arange(len(bins))
        for _ in range(depth):
            node = 2 * node + 1 + (bins[rows, self.feature[node]] > self.cut[node])
        return node - (2**depth - 1)


@dataclass(frozen=True)
class Boosted:
    inputs: tuple[str, ...]
    edges: list[np.ndarray]
    start: np.ndarray
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for k, edges in enumerate(self.edges):
            out[:, k] = np.where(np.isnan(x[:, k]), BINS, np.searchsorted(edges, x[:, k]))
        return out

    def chances(self, bins: np.ndarray) -> np.ndarray:
        raw = np.repeat(self.start[None, :], len(bins), axis=0)
        for tree in self.trees:
            raw += tree.values[tree.leaves(bins, self.depth)]
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _vector(inputs: tuple[str, ...]) -> Column:
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in inputs])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), width)


def _binned(model: Boosted):
    """A batch of rows as one row of three arrays: labels, weights and bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = model.bins(_matrix(batch.column(2), len(model.inputs)))
            found = (batch.column(0).to_numpy().astype(np.int32), batch.column(1).to_numpy().astype(float), bins)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in found], names=["label", "weight", "bins"])

    return run


def _histograms(model: Boosted, tree: Tree, level: int):
    """Sums of rows, gradients and curvatures of the rows of a task: (stat, slot), (node, input, bin) numbered through."""
    width, classes = len(model.inputs), len(model.start)
    slots = 2**level * width * (BINS + 1)

    def run(blocks: Iterator) -> Iterator[np.ndarray]:
        total = np.zeros((1 + 2 * classes, slots))
        for block in blocks:
            y, w, bins = np.frombuffer(block[0], np.int32), np.frombuffer(block[1])[:, None], np.frombuffer(block[2], np.uint8).reshape(-1, width).astype(int)
            p = model.chances(bins)
            stats = np.hstack([np.ones_like(w), w * (p - np.eye(classes)[y]), w * p * (1 - p)])
            node = tree.leaves(bins, level)
            for k in range(width):
                slot = (node * width + k) * (BINS + 1) + bins[:, k]
                for s in range(stats.shape[1]):
                    total[s] += np.bincount(slot, stats[:, s], slots)
        yield total

    return run


def best_splits(sums: np.ndarray, l2: float, least: float) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each node of sums (stat, node, input, bin): (input, cut, leaf value left, and right) before the rate; a cut of BINS where none gains."""
    classes = (sums.shape[0] - 1) // 2
    left = sums.cumsum(axis=3)
    whole = left[..., -1:]
    right = whole - left
    score = lambda s: (s[1 : 1 + classes] ** 2 / (s[1 + classes :] + l2)).sum(axis=0)
    gain = score(left) + score(right) - score(whole)
    gain[(left[0] < least) | (right[0] < least)] = -np.inf
    value = lambda s: -s[1 : 1 + classes] / (s[1 + classes :] + l2)
    out = []
    for node in range(sums.shape[1]):
        k, cut = np.unravel_index(int(gain[node].argmax()), gain[node].shape)
        if gain[node, k, cut] > 1e-9:
            out.append((int(k), int(cut), value(left[:, node, k, cut]), value(right[:, node, k, cut])))
        else:
            same = value(whole[:, node, 0, 0])
            out.append((0, BINS, same, same))
    return out


def _level(blocks: RDD, model: Boosted, tree: Tree, level: int) -> np.ndarray:
    sums = blocks.mapPartitions(_histograms(model, tree, level)).treeReduce(np.add)
    return sums.reshape(len(sums), 2**level, len(model.inputs), BINS + 1)


def begun(train: DataFrame, inputs: tuple[str, ...], classes: int, depth: int) -> Boosted:
    """The model without trees: bin edges by approximate quantiles and the log of each class's share of the weight."""
    shares = [k / BINS for k in range(1, BINS)]
    # NaN is missing too, and would be the greatest number.
    cuts = [F.percentile_approx(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), shares, 10_000).alias(f"q{k}") for k, c in enumerate(inputs)]
    mass = [F.sum(F.when(F.col("label") == k, F.col("weight")).otherwise(0.0)).alias(f"w{k}") for k in range(classes)]
    row = train.agg(*cuts, *mass).first()
    edges = [np.unique(np.array(row[f"q{k}"] or [], float)) for k in range(len(inputs))]
    w = np.array([row[f"w{k}"] or 0.0 for k in range(classes)])
    start = np.where(w > 0, np.log(np.maximum(w, 1e-300) / max(w.sum(), 1e-300)), -np.inf) if w.sum() else np.zeros(classes)
    return Boosted(tuple(inputs), edges, start, depth)


def fit(train: DataFrame, inputs: tuple[str, ...], classes: int = CLASSES, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, l2: float = L2, least: float = LEAST_ROWS) -> Boosted:
    """train has `label` (0 to classes - 1), perhaps `weight`, and the inputs; other columns are ignored."""
    weight = F.col("weight").cast("double") if "weight" in train.columns else F.lit(1.0)
    own = train.where("label IS NOT NULL").select(F.col("label").cast("int").alias("label"), weight.alias("weight"), *[F.col(c).alias(f"x{k}") for k, c in enumerate(inputs)])
    names = tuple(f"x{k}" for k in range(len(inputs)))
    first = begun(own, names, classes, depth)
    model = Boosted(tuple(inputs), first.edges, first.start, depth)
    # Three passes a round, so no more tasks than the rows need, and a plain job for each.
    rows = packed(own.select("label", "weight", _vector(names).alias("x")))
    blocks = rows.mapInArrow(_binned(model), "label binary, weight binary, bins binary").rdd.map(tuple).persist()
    try:
        for _ in range(rounds if np.isinf(model.start).any() or model.start.any() else 0):
            tree = Tree(np.zeros(2**depth - 1, int), np.full(2**depth - 1, BINS), np.zeros((2**depth, classes)))
            for level in range(depth):
                for node, (k, cut, a, b) in enumerate(best_splits(_level(blocks, model, tree, level), l2, least)):
                    at = 2**level - 1 + node
                    tree.feature[at], tree.cut[at] = k, cut
                    if level == depth - 1:
                        tree.values[2 * node], tree.values[2 * node + 1] = rate * a, rate * b
            model.trees.append(tree)
    finally:
        blocks.unpersist()
        rows.unpersist()
    return model


def with_chances(df: DataFrame, model: Boosted, name: str = "probability") -> DataFrame:
    """df with an array of each class's probability, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def chances(x: pd.Series) -> pd.Series:
        return pd.Series(list(model.chances(model.bins(np.array(x.tolist(), float).reshape(len(x), len(model.inputs))))))

    return df.withColumn(name, chances(_vector(model.inputs)))
