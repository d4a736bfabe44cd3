"""Boosted trees over binned features, with squared, absolute and Huber loss.

Features are cut into at most `bins` bins by quantiles. A level of a tree is one pass: each task adds up gradients and counts by
(node, feature, bin) over its Arrow batches and sends these sums; an aggregation adds the tasks', and the driver, which
holds nodes x features x bins numbers, picks the splits. Trees are small and go to the tasks by value. Every `fold` rounds the predictions so far are
written into the rows and the lineage is cut, so that a pass works out at most `fold` trees and the plan doesn't grow with the rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.distribution import exact_quantiles
from tidemark.sources.scratch import shared_root

LOSSES = ("squared", "absolute", "huber")


@dataclass(frozen=True)
class Boost:
    loss: str = "huber"
    rounds: int = 100
    depth: int = 3
    rate: float = 0.1
    bins: int = 64
    #: Rows that a leaf needs, and what is added to a leaf's count when its value is worked out.
    least_rows: int = 20
    shrink: float = 1.0
    #: Huber: residuals beyond this quantile of the first ones count as linear.
    share: float = 0.9
    fold: int = 25


@dataclass
class Tree:
    """Nodes in breadth-first order; feature -1 is a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def picked(self, columns: np.ndarray, of: np.ndarray, depth: int, node: int = 0) -> np.ndarray:
        """What `of` holds for the node that each row comes to within so many levels; columns: the rows' bins, a row of the array a feature."""
        f = self.feature[node]
        if f < 0 or not depth:
            return of[node]
        return np.where(columns[f] > self.bin[node], self.picked(columns, of, depth - 1, 2 * node + 2), self.picked(columns, of, depth - 1, 2 * node + 1))

    def nodes(self, columns: np.ndarray, depth: int) -> np.ndarray:
        return np.broadcast_to(self.picked(columns, np.arange(len(self.feature)), depth), columns.shape[1:])


@dataclass
class Boosted:
    features: list[str]
    edges: list[list[float]]
    start: float
    delta: float
    settings: Boost
    trees: list[Tree] = field(default_factory=list)

    def binned(self) -> Column:
        """The bins of a row's features: how many edges lie below each; a null or NaN is in the first."""
        at = lambda name, edges: F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col(name).cast("double"))) if edges else F.lit(0)
        return F.array(*[F.when(F.col(n).isNull() | F.isnan(F.col(n).cast("double")), 0).otherwise(at(n, e)).cast("int") for n, e in zip(self.features, self.edges, strict=True)])

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """df with the predictions, as one expression of each tree's splits in the JVM."""
        total = F.lit(self.start)
        for t in self.trees:
            total = total + self._branch(t, 0)
        return df.withColumn(name, total)

    def _branch(self, t: Tree, node: int) -> Column:
        f = int(t.feature[node])
        if f < 0:
            return F.lit(float(t.value[node]))
        x, edge = F.col(self.features[f]).cast("double"), self.edges[f][int(t.bin[node])]
        return F.when((x > edge) & ~F.isnan(x), self._branch(t, 2 * node + 2)).otherwise(self._branch(t, 2 * node + 1))


def gradient(loss: str, residual: np.ndarray, delta: float) -> np.ndarray:
    """What a round fits: the negative gradient of the loss."""
    if loss == "squared":
        return residual
    return np.sign(residual) if loss == "absolute" else np.clip(residual, -delta, delta)


def split(sums: np.ndarray, counts: np.ndarray, settings: Boost) -> tuple[int, int, float]:
    """(feature, bin, gain) of a node's best split from its sums and counts by feature and bin; feature -1 without one.

    The gain is what the squared sums by count rise by; of equal ones the first feature and the lowest bin.
    """
    left_s, left_n = np.cumsum(sums, axis=1)[:, :-1], np.cumsum(counts, axis=1)[:, :-1]
    all_s, all_n = sums.sum(axis=1, keepdims=True), counts.sum(axis=1, keepdims=True)
    right_s, right_n = all_s - left_s, all_n - left_n
    ok = (left_n >= settings.least_rows) & (right_n >= settings.least_rows)
    k = settings.shrink
    gain = np.where(ok, left_s**2 / (left_n + k) + right_s**2 / (right_n + k) - all_s**2 / (all_n + k), -np.inf)
    gain = np.round(gain, 9)
    if not gain.size or gain.max() <= 1e-9:
        return -1, 0, 0.0
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return int(f), int(b), float(gain[f, b])


def fit(train: DataFrame, features: list[str], label: str, settings: Boost = Boost()) -> Boosted:
    """A model of the label by the features; rows without a label don't count. Without rows it predicts 0."""
    if settings.loss not in LOSSES:
        raise ValueError(f"loss is one of {LOSSES}")
    rows = train.where(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))).select(*features, F.col(label).cast("double").alias("__y"))
    at = [i / settings.bins for i in range(1, settings.bins)]
    cut = rows.agg(*[F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.array(*[F.lit(a) for a in at]), F.lit(100 * settings.bins)).alias(f"e{i}") for i, f in enumerate(features)]).first()
    edges = [sorted(set(cut[f"e{i}"] or [])) for i in range(len(features))]
    if settings.loss == "squared":
        start = rows.agg(F.avg("__y")).first()[0]
    else:
        start = (exact_quantiles(rows, "__y", [0.5]).first().q or [None])[0]
    start = float(start or 0.0)
    delta = 0.0
    if settings.loss == "huber":
        delta = float((exact_quantiles(rows.select(F.abs(F.col("__y") - start).alias("__r")), "__r", [settings.share]).first().q or [0.0])[0] or 0.0)
    model = Boosted(features, edges, start, delta, settings)
    held = rows.select(model.binned().alias("x"), "__y", F.lit(start).alias("f")).persist()
    folded = 0
    for k in range(settings.rounds):
        if k and k % settings.fold == 0:
            before, held = held, _checkpointed(_added(held, model.trees[folded:], settings.depth))
            before.unpersist()
            folded = k
        tree = _grown(held, model, folded)
        if tree.feature[0] < 0:
            break  # no split lowers the loss
        model.trees.append(tree)
    held.unpersist()
    return model


def _grown(held: DataFrame, model: Boosted, folded: int) -> Tree:
    settings, n_features = model.settings, len(model.features)
    size = 2 ** (settings.depth + 1) - 1
    tree = Tree(np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros(size))
    width = max((len(e) for e in model.edges), default=0) + 1
    for level in range(settings.depth):
        low, n_nodes = 2**level - 1, 2**level
        got = _sums(held, model, folded, tree, level, width)
        sums, counts = got[0].reshape(n_nodes, n_features, width), got[1].reshape(n_nodes, n_features, width)
        for i in range(n_nodes):
            node = low + i
            n = counts[i, 0].sum() if n_features else 0
            if not n:
                continue
            if level and tree.feature[(node - 1) // 2] < 0:
                continue
            f, b, _ = split(sums[i], counts[i], settings)
            if f < 0:
                tree.value[node] = settings.rate * sums[i, 0].sum() / (n + settings.shrink)
                continue
            tree.feature[node], tree.bin[node] = f, b
            for child, part in ((2 * node + 1, slice(0, b + 1)), (2 * node + 2, slice(b + 1, width))):
                tree.value[child] = settings.rate * sums[i, f, part].sum() / (counts[i, f, part].sum() + settings.shrink)
    return tree


def _sums(held: DataFrame, model: Boosted, folded: int, tree: Tree, level: int, width: int) -> np.ndarray:
    """Gradients and counts by node of the level, feature and bin: an array of two rows."""
    trees, settings, n_features, delta = model.trees[folded:], model.settings, len(model.features), model.delta
    low, n_nodes = 2**level - 1, 2**level
    cells = n_nodes * n_features * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n_nodes, n_features, width))
        for b in batches:
            x = np.ascontiguousarray(np.asarray(b.column(0).flatten()).reshape(b.num_rows, n_features).T)
            f = np.asarray(b.column(2), dtype=np.float64).copy()
            for t in trees:
                f += t.picked(x, t.value, settings.depth)
            g = gradient(settings.loss, np.asarray(b.column(1)) - f, delta)
            at = tree.nodes(x, level) - low
            inside = at >= 0  # a leaf above this level is settled
            if not inside.all():
                x, g, at = x[:, inside], g[inside], at[inside]
            for j in range(n_features):
                keys = at * width + x[j]
                total[0, :, j] += np.bincount(keys, weights=g, minlength=n_nodes * width).reshape(n_nodes, width)
                total[1, :, j] += np.bincount(keys, minlength=n_nodes * width).reshape(n_nodes, width)
        total = total.reshape(2, cells)
        some = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[0, some]), pa.array(total[1, some])], names=["cell", "g", "n"])

    out = np.zeros((2, cells))
    for r in held.mapInArrow(run, "cell long, g double, n double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).collect():  # nodes x features x bins
        out[:, r.cell] = r.g, r.n
    return out


def _added(held: DataFrame, trees: list[Tree], depth: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.ascontiguousarray(np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1).T) if b.num_rows else np.zeros((1, 0), dtype=np.int64)
            f = np.asarray(b.column(2), dtype=np.float64).copy()
            for t in trees:
                f += t.picked(x, t.value, depth)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f)], names=b.schema.names)

    return held.mapInArrow(run, held.schema)


def _checkpointed(df: DataFrame) -> DataFrame:
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)
