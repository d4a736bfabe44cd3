"""Peers in each anchor's own window: how many facts each member of a group has in a trailing window, and the exact median of that at any time.

A member's count within the window is a step function of time: it rises when a fact enters the window and falls when it
leaves. So the histogram of a group's counts changes only at these steps, and adding up the changes gives the
histogram at any time. Anchors meet only the different counts of their group, never its facts or its members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.temporal import asof_join


def window_counts(facts: DataFrame, member: str, day: str, days: int) -> DataFrame:
    """member, since (a day's number) and n: from that day on, a member has n facts in the `days` days before, until its next row."""
    per_day = facts.where(F.col(member).isNotNull() & F.col(day).isNotNull()).groupBy(member, F.unix_date(F.to_date(day)).alias("d")).agg(F.count("*").alias("k"))
    enters, leaves = F.struct((F.col("d") + 1).alias("since"), F.col("k").alias("change")), F.struct((F.col("d") + days + 1).alias("since"), (-F.col("k")).alias("change"))
    changes = per_day.select(member, F.inline(F.array(enters, leaves))).groupBy(member, "since").agg(F.sum("change").alias("change")).where("change != 0")
    along = Window.partitionBy(member).orderBy("since").rowsBetween(Window.unboundedPreceding, 0)
    return changes.select(member, "since", F.sum("change").over(along).alias("n"))


def peer_medians(anchors: DataFrame, members: DataFrame, steps: DataFrame, group: str, member: str, day: str) -> DataFrame:
    """group, day, n_peers and peer_median for each different (group, day) of the anchors: the median of all the group's members' counts.

    members: member and group, a row each; members without facts count with 0. steps: what window_counts gives. A group's rows are
    added up by count and day before they are sorted, so a large group is no larger than its days and different counts.
    """
    before = F.coalesce(F.lag("n").over(Window.partitionBy(member).orderBy("since")), F.lit(0))
    moves = steps.withColumn("was", before).join(members.select(member, group), member)
    changes = moves.select(group, "since", F.inline(F.array(F.struct(F.col("n").alias("n"), F.lit(1).alias("change")), F.struct(F.col("was").alias("n"), F.lit(-1).alias("change")))))
    changes = changes.groupBy(group, "n", "since").agg(F.sum("change").alias("change")).where("change != 0")
    along = Window.partitionBy(group, "n").orderBy("since").rowsBetween(Window.unboundedPreceding, 0)
    heights = changes.select(F.struct(group, "n").alias("cell"), "since", F.sum("change").over(along).alias("height"))
    sizes = members.groupBy(group).agg(F.count("*").alias("n_peers"))
    counts = changes.select(group, "n").unionByName(sizes.select(group, F.lit(0).cast("long").alias("n"))).distinct()
    asked = anchors.select(group, F.unix_date(F.to_date(day)).alias("at")).where(f"{group} is not null and at is not null").distinct()
    cells = asked.join(counts, group).select("at", F.struct(group, "n").alias("cell"))
    told = asof_join(cells, heights, "cell", "at", "since", ["height"]).select(F.col(f"cell.{group}").alias(group), "at", F.col("cell.n").alias("n"), F.coalesce("height", F.lit(0)).alias("height"))
    told = told.join(sizes, group).withColumn("height", F.col("height") + F.when(F.col("n") == 0, F.col("n_peers")).otherwise(0))
    upto = told.withColumn("upto", F.sum("height").over(Window.partitionBy(group, "at").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    at_place = lambda p: F.min(F.when(F.col("upto") > p, F.col("n")))
    median = (at_place(F.floor((F.col("n_peers") - 1) / 2)) + at_place(F.floor(F.col("n_peers") / 2))) / 2
    return upto.groupBy(group, "at", "n_peers").agg(median.alias("peer_median")).select(group, F.date_from_unix_date("at").alias(day), "n_peers", "peer_median")
