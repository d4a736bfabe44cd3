"""Operators on groups that hold a large share of all rows: by their plans, no task sorts a whole group."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import distribution as D
from tidemark.operators import relational as R


def test_adjusted_p_values_in_bands(spark):
    """Many bands, ties, nulls, and windows that only run forward."""
    g = random.Random(4)
    rows = [(f, i, g.choice([None, g.random(), g.randrange(20) / 200])) for f in ("a", "b", None) for i in range(400)]
    df = spark.createDataFrame(rows, "f string, i int, p double")
    out = D.benjamini_hochberg(df, "f", "p", "i")
    got = {(r.f, r.i): r.p_adjusted for r in out.collect()}
    assert len(got) == 1200
    for f in ("a", "b", None):
        own = sorted((p, i) for h, i, p in rows if h == f and p is not None)
        low = 1.0
        for rank in range(len(own), 0, -1):
            low = min(low, own[rank - 1][0] * len(own) / rank)
            assert got[f, own[rank - 1][1]] == pytest.approx(low)
        assert all(got[h, i] is None for h, i, p in rows if h == f and p is None)
    assert "currentrow$(), unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_quantiles_of_few_groups_keep_rows_in_place(spark):
    """Rows meet their group's brackets by broadcast even where Spark wouldn't choose it; a shuffle by group would be one task a group."""
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "a").alias("g"), (F.col("id") * 7919 % 20_011 * 1.0).alias("v"))
    want = {g: sorted(i * 7919 % 20_011 for i in range(20_000) if (i % 2 == 0) == (g == "a")) for g in ("a", None)}
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = D.exact_quantiles(df, "v", [0.5], ["g"])
        assert {r.g: r.q[0] for r in out.collect()} == {g: (v[4999] + v[5000]) / 2 for g, v in want.items()}
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_quantiles_of_many_groups(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_GROUPS", 3)
    df = spark.range(500).select((F.col("id") % 5).alias("g"), F.col("id").cast("double").alias("v"))
    assert {r.g: r.q[0] for r in D.exact_quantiles(df, "v", [0.5], ["g"]).collect()} == {g: 247.5 + g - 0.0 for g in range(5)}


def test_spearman_in_bands(spark):
    """Ties, two values that fill a group, a null group; windows are cut by band and not by group alone."""
    import pandas as pd

    g = random.Random(6)
    rows = [(k, float(g.randrange(5)), g.choice([g.gauss(0, 1), 1.0])) for k in ("a", None) for _ in range(500)] + [("b", float(i % 2), float(i % 3)) for i in range(60)]
    out = D.spearman(spark.createDataFrame(rows, "k string, x double, y double"), "k", "x", "y")
    got = {r.k: (r.pearson, r.spearman) for r in out.collect()}
    for k in ("a", "b", None):
        own = pd.DataFrame([r[1:] for r in rows if r[0] == k], columns=["x", "y"])
        assert got[k] == pytest.approx((own.x.corr(own.y), own.x.rank().corr(own.y.rank())))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("__band" in w for w in plan.split("\n") if "Window [" in w)


def test_spine_counts_by_counted_tasks(spark, monkeypatch):
    """Each key once with its rows in each source, no joins, and more tasks where there are more rows."""
    monkeypatch.setattr(R, "SPINE_ROWS", 50)
    a = spark.createDataFrame([(i % 70, "x") for i in range(300)] + [(None, "x")], "k long, w string")
    b = spark.createDataFrame([(i, "x") for i in range(60, 90)], "k long, w string")
    out = R.spine_counts({"n_a": a, "n_b": b}, ["k", "w"])
    got = {r.k: (r.n_a, r.n_b) for r in out.collect()}
    assert got == {k: (sum(i % 70 == k for i in range(300)), int(60 <= k < 90)) for k in range(90)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and out.rdd.getNumPartitions() == 7
