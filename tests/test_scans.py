"""Scans in parts give what one window gives, for a key with half of all rows, and their tasks don't hold that key."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scans
from tidemark.operators import temporal as T

DAY0 = datetime(2020, 1, 1)


def table(seed, n=900):
    g = random.Random(seed)
    rows = []
    for i in range(n):
        key = g.choice(["hot", "hot", "hot", "a", "b", None, f"k{g.randrange(40)}"])
        at = None if g.random() < 0.02 else DAY0 + timedelta(hours=g.randrange(600) if g.random() < 0.5 else g.randrange(40))
        rows.append((i, key, at, g.choice(["x", "x", "y", None])))
    return rows


SCHEMA = "id int, k string, at timestamp, state string"


def same(a, b):
    key = lambda r: tuple(map(str, r))
    return sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


@pytest.mark.parametrize("most", [25, 10**6])
@pytest.mark.parametrize("direction, strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
def test_asof_in_parts(spark, most, direction, strict):
    anchors = spark.createDataFrame(table(1), SCHEMA).select("id", "k", "at").repartition(3)
    facts = spark.createDataFrame(table(2, 300), SCHEMA).select("k", F.col("at").alias("t"), F.col("id").alias("v"), F.col("state").alias("s"))
    args = ("k", "at", "t", ["v", "s"])
    assert same(scans.asof_join(anchors, facts, *args, direction=direction, strict=strict, order=["v"], most=most), T.asof_join(anchors, facts, *args, direction=direction, strict=strict, order=["v"]))


@pytest.mark.parametrize("most", [25, 10**6])
def test_islands_in_parts(spark, most):
    rows = spark.createDataFrame(table(3), SCHEMA).repartition(3)
    assert same(scans.islands(rows, "k", "at", ["id"], "state", most=most), T.islands(rows, "k", ["at", "id"], "state"))


@pytest.mark.parametrize("most", [25, 10**6])
def test_interval_union_in_parts(spark, most):
    g = random.Random(6)
    rows = [("hot" if g.random() < 0.6 else g.choice("abc"), (d := date(2020, 1, 1) + timedelta(days=g.randrange(3000))), None if g.random() < 0.02 else d + timedelta(days=g.choice([0, 1, 2, 3, 200 if g.random() < 0.05 else 1]))) for _ in range(700)]
    df = spark.createDataFrame(rows, "k string, a date, b date").repartition(3)
    assert same(scans.interval_union(df, "k", "a", "b", most=most), T.interval_union(df, "k", "a", "b"))


def test_a_hot_key_is_cut(spark):
    """Parts are about `most` rows each, cut alike whatever the partitions, and equal times stay together."""
    rows = spark.createDataFrame(table(4, 3000), SCHEMA)
    for df in (rows, rows.repartition(7)):
        cut = scans.cuts(scans.times_of((df, "k", "at")), 100)
        parts = scans.with_parts(df, "k", "at", cut).where("at is not null")
        sizes = {(r.k, r["__part"]): r["count"] for r in parts.groupBy("k", "__part").count().collect()}
        assert max(n for (k, _), n in sizes.items() if k == "hot") < 260 and len([1 for k, _ in sizes if k == "hot"]) > 8
        assert parts.groupBy("k", "at").agg(F.count_distinct("__part").alias("n")).where("n > 1").isEmpty()
        assert not [1 for (k, p), _ in sizes.items() if k != "hot" and p and sizes.get((k, 0), 0) < 10]


def test_empty(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert scans.islands(rows, "k", "at", ["id"], "state").count() == 0
    assert scans.asof_join(rows, rows.select("k", F.col("at").alias("t"), F.col("id").alias("v")), "k", "at", "t", ["v"]).count() == 0
    assert scans.interval_union(rows.select("k", "at", F.col("at").alias("b")), "k", "at", "b").count() == 0
