"""Many fits in one pass against MLlib, against fits on resampled rows, and against plain sums."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.operators import models as M
from tidemark.operators import newton as N


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(3)
    out = []
    for i in range(600):
        grp = "ab"[i % 2]
        x = g.normal(size=3 if grp == "a" else 2)
        z = x[0] - 0.5 * x[1] + (1.0 if grp == "a" else -0.3)
        out.append((grp, [float(v) for v in x], float(g.random() < 1 / (1 + np.exp(-z))), float(z + g.normal()), i // 4))
    out += [(None, [1.0, 1.0, 1.0], 1.0, 0.0, 1), ("a", None, 1.0, 0.0, 1), ("b", [0.0, 0.0], None, None, 2)]
    return spark.createDataFrame(out, "grp string, x array<double>, y double, t double, c int").repartition(3).cache()


def test_logistic_equals_mllib(rows):
    fits = N.logistic_many(rows, "x", "y", [0.01, 1.0, 10.0], group="grp")
    assert [(f.group, f.c) for f in fits] == [(g, c) for g in "ab" for c in (0.01, 1.0, 10.0)] and all(f.converged for f in fits)
    for f in fits:
        own = rows.where((F.col("grp") == f.group) & F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("features", array_to_vector("x"))
        m = M.logistic(own, "y", f.c)
        n = len(m.coefficients)
        assert np.allclose(f.coefficients[:n], m.coefficients, atol=1e-5) and f.intercept == pytest.approx(m.intercept, abs=1e-5)
        assert not any(f.coefficients[n:])


def test_ridge_solves_the_normal_equations(rows):
    for f in N.ridge_many(rows, "x", "t", [0.1, 10.0], group="grp"):
        own = rows.where((F.col("grp") == f.group) & F.col("x").isNotNull() & F.col("t").isNotNull()).collect()
        x, t = np.array([[1.0, *r.x] for r in own]), np.array([r.t for r in own])
        b = np.linalg.solve(x.T @ x + f.c * np.diag([0.0, *[1.0] * (x.shape[1] - 1)]), x.T @ t)
        assert np.allclose([f.intercept, *f.coefficients][: len(b)], b, atol=1e-9)


def test_draws_are_fits_on_resampled_rows(spark, rows):
    """A draw's fit is that on rows repeated by their cluster's weight, and the same for other partitions."""
    own = rows.where("grp = 'a' and x is not null and y is not null")
    fits = N.logistic_many(own, "x", "y", [1.0], draws=8, cluster="c")
    again = N.logistic_many(own.repartition(5), "x", "y", [1.0], draws=8, cluster="c")
    assert all(f.converged for f in fits)
    assert np.allclose([f.coefficients for f in fits], [f.coefficients for f in again], atol=1e-6)
    hashed = own.withColumn("h", F.xxhash64("c")).collect()
    weights = N.draw_weights(np.array([r.h for r in hashed]), 8, 7).astype(int)
    for k in (0, 5):
        grown = [(r.x, r.y) for r, w in zip(hashed, weights[:, k], strict=True) for _ in range(w)]
        one = N.logistic_many(spark.createDataFrame(grown, "x array<double>, y double"), "x", "y", [1.0])[0]
        assert np.allclose(one.coefficients, fits[k].coefficients, atol=1e-5)


def test_weights_are_poisson_and_by_cluster():
    w = N.draw_weights(np.arange(4000) * 7919, 50, 1)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.5
    assert (N.draw_weights(np.array([7, 7, 8]), 20, 1)[0] == N.draw_weights(np.array([7]), 20, 1)[0]).all()


def test_draw_sums(rows):
    own = rows.where("y is not null")
    got = {(r.g, r.draw): (r.y, r.drawn) for r in N.draw_sums(own, "c", ["y"], 6, group="grp").collect()}
    hashed = own.withColumn("h", F.xxhash64("c")).collect()
    w = N.draw_weights(np.array([r.h for r in hashed]), 6, 7)
    for g in "ab":
        at = [i for i, r in enumerate(hashed) if r.grp == g]
        for k in range(6):
            assert got[g, k] == pytest.approx((sum(w[i, k] * hashed[i].y for i in at), w[at, k].sum()))


def test_no_rows(rows):
    assert N.logistic_many(rows.limit(0), "x", "y", [1.0], group="grp") == [] and N.ridge_many(rows.limit(0), "x", "t", [1.0]) == []


def test_separable_classes_converge(spark):
    df = spark.createDataFrame([([float(i)], float(i > 5)) for i in range(12)], "x array<double>, y double")
    (f,) = N.logistic_many(df, "x", "y", [1000.0])
    assert f.converged and f.coefficients[0] > 1


def _passes(monkeypatch):
    """Rows that each pass over all draws reads, and whether it tries each draw's own parameters."""
    whole, seen = N._sums, []

    def noted(rows, per_batch, width):
        out = whole(rows, per_batch, width)
        if any(len(of) > 1 for of in out.values()):
            seen.append((rows.count(), per_batch.__qualname__.split(".")[0]))
        return out

    monkeypatch.setattr(N, "_sums", noted)
    return seen


def test_draws_of_few_different_rows(spark, monkeypatch):
    """Weights are added up by the different rows once; steps run over these sums and give the same fits."""
    seen = _passes(monkeypatch)
    df = spark.range(3000).select(F.col("id").alias("c"), F.array((F.col("id") % 4).cast("double"), (F.col("id") % 3).cast("double")).alias("x"), (F.xxhash64("id") % 3 == 0).cast("double").alias("y"))
    df = df.unionByName(df.where("c % 2 = 0").withColumn("x", F.array(F.lit(5.0), F.lit(1.0)))).repartition(3)  # clusters of several rows
    fits = N.logistic_many(df, "x", "y", [1.0], draws=12, cluster="c")
    assert all(f.converged for f in fits) and len(fits) == 12 and seen and all(n <= 26 for n, _ in seen)
    monkeypatch.setattr(N, "PATTERNS", 0)
    apart = N.logistic_many(df, "x", "y", [1.0], draws=12, cluster="c")
    assert np.allclose([[f.intercept, *f.coefficients] for f in fits], [[f.intercept, *f.coefficients] for f in apart], atol=1e-7)


def test_draws_start_near_their_minimum(spark, monkeypatch):
    """Continuous features: one pass at the fit of all rows, and at most two by the draws' own probabilities."""
    seen = _passes(monkeypatch)
    df = spark.range(20_000).select("id", F.array(F.randn(1), F.randn(2), F.randn(3)).alias("x"), F.rand(4).alias("u")).withColumn("y", (F.col("u") < 1 / (1 + F.exp(-F.col("x")[0] / 2))).cast("double")).persist()
    fits = N.logistic_many(df, "x", "y", [1.0], draws=20, cluster="id")
    assert all(f.converged for f in fits) and [q for _, q in seen][:1] == ["_near"] and len(seen) <= 3
    rows = df.withColumn("h", F.xxhash64("id")).collect()
    w = N.draw_weights(np.array([r.h for r in rows]), 20, 7)[:, 3]
    x, y, b = np.array([[1.0, *r.x] for r in rows]), np.array([r.y for r in rows]), np.array([fits[3].intercept, *fits[3].coefficients])
    assert np.abs(x.T @ (w * (1 / (1 + np.exp(-x @ b)) - y)) + [0, *b[1:]]).max() < 1e-3  # at the minimum


def test_weights_by_table():
    """Looked up by 16 bits, they are those of all 53."""
    bits = N.mixed(np.arange(1, 300_001, dtype=np.uint64))
    at = (bits >> np.uint64(11)).astype(np.float64) * 2.0**-53
    settled = N._WEIGHT[(bits >> np.uint64(48)).astype(int)]
    known = settled < 255
    assert (settled[known] == np.searchsorted(N._CDF, at[known], side="right")).all() and known.mean() > 0.999
    assert (N.draw_weights(np.arange(50), 9, 3, np.array([2, 7])) == N.draw_weights(np.arange(50), 9, 3)[:, [2, 7]]).all()
