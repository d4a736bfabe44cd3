"""What is known before each order: one shuffle by customer, no copy of the orders beside it, the same values as an as-of join."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import resampling as B
from tidemark.operators import temporal as T
from tidemark.plans import fitted, point_in_time

ORDERS = "o_orderkey long, o_custkey long, o_orderdate timestamp, o_totalprice double, o_orderpriority string"


def _orders(spark):
    day = lambda n: None if n is None else datetime(1996, 1, 1 + n)
    rows = [(1, 7, 0, 10.0, "a"), (2, 7, 3, 20.0, "b"), (3, 7, 3, 30.0, "a"), (4, 7, 5, 40.0, "b"), (5, 8, 1, 50.0, "a"), (6, None, 2, 60.0, "a"), (7, None, 4, 70.0, "b"), (8, 7, None, 80.0, "a"), (9, 8, 6, None, "b"), (10, 8, 9, 90.0, None), (11, 8, 12, 95.0, "b")]
    return spark.createDataFrame([(k, c, day(n), p, q) for k, c, n, p, q in rows], ORDERS)


def _exchanges(df, *of):
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        df.sparkSession.conf.unset("spark.sql.adaptive.enabled")
    lines = [x.strip() for x in plan.splitlines() if "Exchange hash" in x and "Reused" not in x]
    return [x for x in lines if any(o in x for o in of)]


def test_previous_order_is_the_as_of_value(spark):
    """Of several orders of a time the one with the greatest key; none without a customer, a time, or for orders of the same time."""
    orders = _orders(spark)
    facts = orders.select("o_custkey", F.col("o_orderdate").alias("prev_date"), F.col("o_orderkey").alias("prev_key"), F.col("o_totalprice").alias("prev_value"))
    want = T.asof_join(orders, facts, "o_custkey", "o_orderdate", "prev_date", ["prev_key", "prev_value"], strict=True, order=["prev_key"])
    got = point_in_time.with_previous(orders)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == sorted(map(tuple, want.select(got.columns).collect()), key=lambda r: r[0])
    assert {r.o_orderkey: r.prev_key for r in got.collect() if r.prev_key} == {2: 1, 3: 1, 4: 3, 9: 5, 10: 9, 11: 10}


def test_paired_predictions_shuffle_the_orders_once(spark, tmp_path):
    """No line items are read, means and predictions share one shuffle by customer, and none is made by order or priority."""
    _orders(spark).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, "x"), (8, "y")], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    rows = fitted._paired(spark, str(tmp_path))
    assert {r.o_orderkey: (round(r.baseline, 9), round(r.candidate, 9)) for r in rows.collect()} == _by_hand()
    assert len(_exchanges(rows, "o_custkey", "o_orderkey")) == 1
    assert len(_exchanges(rows, "o_orderpriority")) == 1  # the means' sums
    clusters = B.cluster_sums(rows, "o_custkey", "baseline", "candidate", "y")
    assert len(_exchanges(clusters, "o_custkey", "o_orderkey")) == 1
    assert fitted.cluster_bootstrap_ci(spark, str(tmp_path)).first().n_draws > 4000


def _by_hand():
    from math import log

    known = {2: (20.0, "b", 10.0), 3: (30.0, "a", 10.0), 4: (40.0, "b", 30.0), 9: (None, "b", 50.0), 11: (95.0, "b", 90.0)}
    mean = {"a": log(30), "b": (log(20) + log(40) + log(95)) / 3}
    return {k: (round(mean[q], 9), round(0.9 * mean[q] + 0.1 * log(before), 9)) for k, (_, q, before) in known.items()}


def test_features_of_orders_are_shuffled_by_customer_once(spark):
    """The frame of the models takes its columns along: once by order for the line items, once by customer."""
    frame = fitted.order_frame(spark, "/root/testdata/sf0.001", "o_orderstatus")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = _exchanges(frame, "hashpartitioning")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == 3 and sum("o_custkey" in x.split("hashpartitioning(")[1].split(")")[0] for x in found) == 1
    assert frame.columns[-3:] == ["year", "y", "large"] and frame.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()


def test_draw_sums_count_clusters(spark):
    from tidemark.operators import newton as N

    rows = spark.range(90).select("id", (F.col("id") % 3).alias("g"), F.lit(1.0).alias("v")).repartition(4)
    got = N.draw_sums(rows, "id", ["v"], 5, group="g").collect()
    assert len(got) == 15 and all(r.clusters == 30 and r.v == pytest.approx(r.drawn) for r in got)
