"""Plans that Spark may run twice: sums of doubles needn't be the same bits both times, and the results must hold all the same."""

import random

from pyspark.sql import functions as F

from tidemark.operators import resampling as B
from tidemark.plans import entities


def shaken(c):
    """The value with a little noise that is new whenever it is worked out."""
    return F.udf(lambda x: x + random.random() * 1e-6, "double").asNondeterministic()(c)


def test_permutations_of_values_that_change(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), shaken(F.col("id") % 7 * 1.0).alias("v"))
    keyed = B.permutation_heterogeneity(rows, "g", "v", key="id", draws=40).first()
    assert keyed.n_draws == 40 and 0 < keyed.p_value <= 1
    assert B.permutation_heterogeneity(rows, "g", "v", draws=40).first().n_draws == 40


def test_slots_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(B, "SLOT_ROWS", 100)
    rows = spark.range(2000).select("id", (F.col("id") % 2).alias("g"), (F.col("id") % 2 + F.col("id") % 11 / 10).alias("v"))
    assert B.permutation_heterogeneity(rows, "g", "v", key="id", draws=60, slots=2).first().p_value < 0.05


def test_yearly_sums_that_change(spark, monkeypatch):
    """Both predictions must be told of the same sums, even if those differ each time they are worked out."""
    whole = entities.table
    monkeypatch.setattr(entities, "table", lambda *a: whole(*a).withColumn("o_totalprice", shaken(F.col("o_totalprice"))))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        assert entities.paired_predictions(spark, "/root/testdata/sf0.001").count() > 0
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
