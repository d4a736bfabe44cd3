"""Joins with asserted cardinality, consolidation of sources, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    """Raises if a key stands twice; one aggregation, stopped at the first."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key {keys} isn't unique: {twice[0]}")


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    assert_unique(right, keys)
    return left.join(right, keys, how)


def flagged_join(left: DataFrame, right: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """left with right's columns and whether it was found."""
    return left.join(right.withColumn("__there", F.lit(True)), keys, "left").withColumn(flag, F.coalesce("__there", F.lit(False))).drop("__there")


def coverage_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of either side, with both, left_only or right_only."""
    l, r = left.select(*keys, F.lit(1).alias("__l")), right.select(*keys, F.lit(1).alias("__r"))
    out = l.join(r, keys, "full")
    side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return out.select(*keys, side.alias("coverage"))


def key_spine(*sources: DataFrame) -> DataFrame:
    """Each key of any source once."""
    return reduce(lambda a, b: a.unionByName(b), sources).distinct()


#: Rows of a task of a spine's counts.
SPINE_ROWS = 1_000_000


def spine_counts(sources: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Each key of any source once, with its rows in each source (0: none). Rows with a null in the key don't count.

    What the sources' counts joined back to their spine give, by one shuffle and one aggregation: nothing is sorted or joined, and
    there are as many tasks as the counted rows need, so a task's share doesn't grow with the input.
    """
    known = {name: df.select(*keys).dropna() for name, df in sources.items()}
    marked = [df.select(*keys, *[F.lit(int(n == name)).alias(n) for n in sources]) for name, df in known.items()]
    every = reduce(DataFrame.unionByName, marked)
    least = int(every.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = every.repartition(max(least, -(-every.count() // SPINE_ROWS)), *keys)
    return dealt.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in sources])


def prioritised(*candidates: tuple[Column, str]) -> tuple[Column, Column]:
    """The first value that is there, and the name of its source."""
    value = F.coalesce(*[c for c, _ in candidates])
    source = F.lit(None).cast("string")
    for c, name in reversed(candidates):
        source = F.when(c.isNotNull(), name).otherwise(source)
    return value, source


def agreement(*cs: Column) -> Column:
    """missing, single, agree or differ, by the values that are there."""
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cs])
    return F.when(n == 0, "missing").when(n == 1, "single").when(F.greatest(*cs) == F.least(*cs), "agree").otherwise("differ")


def consensus(value: str) -> tuple[Column, Column]:
    """The value if a group has exactly one, and whether it has several."""
    n = F.count_distinct(value)
    return F.when(n == 1, F.min(value)), n > 1


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def later_wins(base: DataFrame, newer: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """base with newer rows on top: of each key the row of the newer side, else of the base."""
    both = base.withColumn("__turn", F.lit(0)).unionByName(newer.withColumn("__turn", F.lit(1)), allowMissingColumns=True)
    return top_per_key(both, keys, [F.col("__turn").desc(), *order]).drop("__turn")


def leave_one_out(df: DataFrame, group: str, value: str, weight: Column | None = None) -> Column:
    """Weighted mean of the group without the row itself; null for a group of one."""
    w = Window.partitionBy(group)
    k = F.when(F.col(value).isNotNull(), F.lit(1.0) if weight is None else weight)
    total, weights = F.sum(F.col(value) * k).over(w), F.sum(k).over(w)
    rest = weights - F.coalesce(k, F.lit(0.0))
    return F.when(rest > 0, (total - F.coalesce(F.col(value) * k, F.lit(0.0))) / rest)


def rest_means(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """df with the mean of the other rows of the group and __rows, how many it has. Groups are aggregated and joined back, so a large one isn't held by one task."""
    sums = df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__rows"), F.sum(value).alias("__sum"), F.count(value).alias("__n"))
    own = F.col(value)
    rest = F.col("__n") - own.isNotNull().cast("int")
    out = df.join(sums, F.col(group).eqNullSafe(F.col("__g")))
    return out.withColumn(name, F.when(rest > 0, (F.col("__sum") - F.coalesce(own, F.lit(0.0))) / rest)).drop("__g", "__sum", "__n")


def referential_profile(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows, nulls, matched and unmatched rows of a reference, and how many keys aren't found."""
    keys = parent.select(F.col(parent_key).alias("__p")).distinct()
    joined = child.groupBy(child_key).count().join(keys, F.col(child_key) == F.col("__p"), "left")
    n, found = F.col("count"), F.col("__p").isNotNull()
    null = F.col(child_key).isNull()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return joined.agg(zero(F.sum(n)).alias("n_rows"), zero(F.sum(F.when(null, n))).alias("n_null"), zero(F.sum(F.when(found, n))).alias("n_matched"), zero(F.sum(F.when(~found & ~null, n))).alias("n_unmatched"), F.count_if(~found & ~null).alias("n_missing_keys"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each column: rows, nulls, distinct values, zeros, negatives, least and greatest as doubles. One pass."""
    long = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column_name", "x")
    return long.groupBy("column_name").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("x").isNull()).alias("n_null"), F.count_distinct("x").alias("n_distinct"), F.count_if(F.col("x") == 0).alias("n_zero"), F.count_if(F.col("x") < 0).alias("n_negative"), F.min("x").alias("least"), F.max("x").alias("greatest")
    )


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """step, stage, n and the shares kept from the stage before and from the first; each stage holds all conditions up to it."""
    held: list[Column] = []
    counts = []
    for _, c in stages:
        held.append(c)
        counts.append(F.count_if(reduce(lambda a, b: a & b, held)))
    one = df.agg(*[c.alias(f"s{i}") for i, c in enumerate(counts)])
    rows = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(name).alias("stage"), F.col(f"s{i}").alias("n"), (F.col(f"s{i - 1}") if i else F.col("s0")).alias("before"), F.col("s0").alias("start")) for i, (name, _) in enumerate(stages)])
    out = one.select(F.explode(rows).alias("r")).select("r.*")
    share = lambda a: F.when(F.col(a) > 0, F.round(F.col("n") / F.col(a), 6))
    return out.select("step", "stage", "n", share("before").alias("kept_from_previous"), share("start").alias("kept_from_start"))
