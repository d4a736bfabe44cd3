"""Boosted trees against a plain version over the same bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as B


def data(n=1000, seed=2):
    g = np.random.default_rng(seed)
    x = np.column_stack([g.normal(size=n), g.integers(0, 5, n), g.normal(size=n)])
    y = np.sin(2 * x[:, 0]) + 0.5 * (x[:, 1] > 2) + 0.1 * g.normal(size=n)
    y[:15] += 40  # outliers
    return x, y


def plain(bins, y, start, delta, s, width):
    """Predictions after each round, tree by tree, with loops."""
    f = np.full(len(y), start)
    for _ in range(s.rounds):
        r = y - f
        g = r if s.loss == "squared" else np.sign(r) if s.loss == "absolute" else np.clip(r, -delta, delta)

        def grow(rows, depth, g=g):
            best = (1e-9, None)
            if depth < s.depth:
                for j in range(bins.shape[1]):
                    for b in range(width - 1):
                        left, right = rows[bins[rows, j] <= b], rows[bins[rows, j] > b]
                        if len(left) >= s.least_rows and len(right) >= s.least_rows:
                            part = lambda at: g[at].sum() ** 2 / (len(at) + s.shrink)
                            gain = round(part(left) + part(right) - part(rows), 9)
                            if gain > best[0]:
                                best = (gain, (left, right))
            if best[1] is None:
                step[rows] = s.rate * g[rows].sum() / (len(rows) + s.shrink)
            else:
                for at in best[1]:
                    grow(at, depth + 1)

        step = np.zeros(len(y))
        grow(np.arange(len(y)), 0)
        f = f + step
    return f


@pytest.fixture(scope="module")
def df(spark):
    x, y = data()
    return spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))], "id int, a double, b double, c double, y double").repartition(3).cache()


@pytest.mark.parametrize("loss", B.LOSSES)
def test_boosting_equals_plain_version(df, loss):
    s = B.Boost(loss=loss, rounds=7, bins=12, fold=3)
    model = B.fit(df, ["a", "b", "c"], "y", s)
    rows = model.transform(df.withColumn("x", model.binned())).orderBy("id").collect()
    bins, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    start = y.mean() if loss == "squared" else np.median(y)
    assert model.start == pytest.approx(start) and (loss != "huber" or model.delta == pytest.approx(np.quantile(np.abs(y - start), 0.9)))
    want = plain(bins, y, start, model.delta, s, max(len(e) for e in model.edges) + 1)
    assert np.allclose([r.prediction for r in rows], want, atol=1e-8) and len(model.trees) == 7


def test_huber_minds_outliers_less(df):
    x, y = data()
    clean = y.copy()
    clean[:15] -= 40
    off = {}
    for loss in ("squared", "huber"):
        rows = B.fit(df, ["a", "b", "c"], "y", B.Boost(loss=loss, rounds=25, bins=16, rate=0.3)).transform(df).orderBy("id").collect()
        off[loss] = np.abs(np.array([r.prediction for r in rows]) - clean)[15:].mean()
    assert off["huber"] < off["squared"] and off["huber"] < 0.25


def test_nulls_and_no_rows(spark, df):
    some = df.withColumn("a", F.when(F.col("id") % 9 == 0, None).when(F.col("id") % 9 == 1, float("nan")).otherwise(F.col("a"))).withColumn("y", F.when(F.col("id") % 11 == 0, None).otherwise(F.col("y")))
    model = B.fit(some, ["a", "b"], "y", B.Boost(rounds=3))
    assert model.transform(some).where("prediction is null or isnan(prediction)").isEmpty()
    assert B.fit(df.limit(0), ["a"], "y", B.Boost(rounds=2)).transform(df).agg(F.max("prediction")).first()[0] == 0


def test_picked_by_whole_columns():
    """A tree's nodes by comparisons of whole columns are those of walking down row by row, and cost no look-up a row."""
    g = np.random.default_rng(5)
    tree = B.Tree(np.array([0, 1, -1, 2, 0, -1, -1] + [-1] * 8), np.array([3, 2, 0, 1, 1, 0, 0] + [0] * 8), np.arange(15.0) / 7)
    x = g.integers(0, 6, (3, 500))
    for depth in range(4):
        want = []
        for row in x.T:
            at = 0
            for _ in range(depth):
                f = tree.feature[at]
                at = at if f < 0 else 2 * at + 1 + int(row[f] > tree.bin[at])
            want.append(at)
        assert (tree.nodes(x, depth) == want).all() and (tree.picked(x, tree.value, depth) == tree.value[want]).all()
