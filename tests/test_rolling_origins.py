"""Parts of the rolling origins: rows by origin without joins, scores of all fits in one pass, areas from two shuffles."""

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import distribution as D
from tidemark.operators import models as M
from tidemark.operators import newton as N
from tidemark.plans import fitted

FOLDER = "/root/testdata/sf0.001"


def _plan(df, **conf):
    spark = df.sparkSession
    conf = {"spark.sql.adaptive.enabled": "false", **conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_rows_by_origin(spark):
    """The same rows as by anti-joins on the customers of the evaluation year; a row without a customer stays in training."""
    frame = fitted.order_frame(spark, FOLDER)
    odd = frame.withColumn("o_custkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")))
    held, by = fitted._by_origin(odd)
    every = reduce(DataFrame.unionByName, by.values())
    got = {(r.origin, r.part): (r.n, round(r.s, 6)) for r in every.groupBy("origin", "part").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()}
    held.unpersist()
    want = {}
    for train_end, validation, evaluation in fitted.ORIGINS:
        seen = odd.where(F.col("year") == evaluation).select("o_custkey").distinct()
        for part, rows in (("train", odd.where(F.col("year") <= train_end).join(seen, "o_custkey", "left_anti")), ("validation", odd.where(F.col("year") == validation)), ("evaluation", odd.where(F.col("year") == evaluation))):
            r = rows.agg(F.count("*").alias("n"), F.sum("y").alias("s")).first()
            if r.n:
                want[str(evaluation), part] = (r.n, round(r.s, 6))
    assert got == want and len(want) == 6


def test_rows_by_origin_need_no_further_shuffle(spark):
    """Customers of an evaluation year are told in the sort that the frame has already."""
    frame = fitted.order_frame(spark, FOLDER)
    held, _ = fitted._by_origin(frame)
    held.unpersist()
    spark.catalog.clearCache()
    plan = _plan(held)
    assert plan.count("Exchange hash") == _plan(frame).count("Exchange hash") and plan.count("Sort [o_custkey") == 1  # on customers


def test_linear_scores(spark):
    """Each row by the fits of its group, in their order; equal features have equal scores, whatever batch they are in."""
    g = np.random.default_rng(1)
    x = [[float(v) for v in g.normal(size=3)] for _ in range(40)]
    rows = spark.createDataFrame([("ab"[i % 2], x[(i // 2) % 40], i) for i in range(4000)] + [("c", x[0], -1), ("a", None, -2), (None, x[0], -3)], "grp string, x array<double>, i int").repartition(7)
    fits = [N.Fit("a", 1.0, None, 0.5, (1.0, 0.0, -2.0), True), N.Fit("b", 1.0, None, -1.0, (0.1, 0.2), True), N.Fit("a", 2.0, None, 0.0, (3.0, 1.0, 1.0), True)]
    got = N.linear_scores(rows, "x", "grp", fits, ["i"]).collect()
    assert len(got) == 4001
    for r in got:
        own = [f for f in fits if f.group == r.grp]
        want = [f.intercept + sum(a * b for a, b in zip(x[(r.i // 2) % 40], f.coefficients, strict=False)) for f in own]
        assert [v for v in (r.z0, r.z1) if v is not None] == pytest.approx(want)
    assert len({(r.grp, r.z0) for r in got if r.grp != "c"}) == 80


def test_area_of_few_shuffles(spark):
    """Pairs by brute force, with ties, nulls and a group of one class; counts are shuffled twice and joined with nothing."""
    g = np.random.default_rng(2)
    rows = [("abc"[i % 3], int(g.random() < 0.4) if i % 3 < 2 else 1, float(g.integers(0, 60)) if i % 4 else float(g.normal())) for i in range(3000)]
    df = spark.createDataFrame([*rows, ("a", None, 1.0), ("b", 1, None), (None, 1, 2.0), (None, 0, 1.0)], "k string, label int, score double").repartition(3)
    out = D.auc(df, ["k"], "label", "score")
    got = {r.k: r.auc for r in out.collect()}
    for k in "ab":
        pos, neg = (np.array([s for q, y, s in rows if q == k and y == v]) for v in (1, 0))
        assert got[k] == pytest.approx(((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg)), abs=1e-12)
    assert got["c"] is None and got[None] == 1.0
    plan = _plan(out)
    assert "Join" not in plan and sum("score" in x.split("hashpartitioning(")[1].split(")")[0] for x in plan.splitlines() if "Exchange hash" in x) == 1
    none = D.auc(df.where("k = 'a'"), [], "label", "score").collect()
    assert len(none) == 1 and none[0].auc == pytest.approx(got["a"])


def test_preprocessors_of_groups(spark):
    """Each group's is that of its rows alone: levels, gaps and constant columns differ."""
    rows = spark.range(600).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("grp"), F.when(F.col("id") % 5 != 0, F.col("id") % 17).cast("double").alias("v"), F.when(F.col("id") % 3 == 0, 4.0).otherwise(F.col("id") % 7).alias("w"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("l"), F.col("id") % 2)).otherwise("m").alias("c"))
    rows = rows.withColumn("v", F.when((F.col("grp") == "b") & F.col("v").isNull(), 1.0).otherwise(F.col("v")))
    got = M.fit_preprocessors(rows, "grp", ["v", "w"], ["c"])
    for g in "ab":
        want = M.fit_preprocessor(rows.where(F.col("grp") == g), ["v", "w"], ["c"])
        assert [c[:2] for c in got[g].columns] == [c[:2] for c in want.columns] and got[g].medians == want.medians and got[g].levels == want.levels
        assert np.allclose([c[2:] for c in got[g].columns], [c[2:] for c in want.columns])


def test_held_rows_are_not_persisted_again(spark, monkeypatch):
    df = spark.range(300).select(F.lit("a").alias("g"), F.array(F.col("id") / 100).alias("x"), (F.col("id") % 2).cast("double").alias("y"))
    seen = []
    whole = N._sums
    monkeypatch.setattr(N, "_sums", lambda rows, *a: (seen.append(rows.is_cached), whole(rows, *a))[1])
    fits = [N.ridge_many(df, "x", "y", [1.0], group="g", held=h)[0] for h in (True, False)] + [N.logistic_many(df, "x", "y", [1.0], group="g", held=h)[0] for h in (True, False)]
    assert fits[0] == fits[1] and fits[2] == fits[3]
    assert not seen[0] and seen[1] and not seen[2] and seen[-1]
