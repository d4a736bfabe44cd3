"""Scans along time for keys that may hold a large share of all rows: as-of joins, spells and interval unions in parts.

A scan in one window sorts a whole key in one task. Here a key of more than `most` rows is cut into parts of consecutive times;
each part is reduced to a summary (its last fact, its first and last state and changes, its furthest end), the summaries of a key
are scanned, at most `BINS` rows, and what comes before a part is carried into it. Both halves are associative, so the
results are those of one window.

The cuts come from counts of a key's rows by `BINS` equal spans of its time. They depend on the rows alone, not on how they
were partitioned, so a task that runs again cuts alike. Rows of one time are never cut apart; a key whose rows nearly all lie in one
span stays together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Spans of time by which a long key's rows are counted.
BINS = 8192
#: Rows of a key up to which it is one part.
MOST = 1_000_000
#: Long keys whose cuts (a number a span, 32 KB) are broadcast, at most 32 MB; more are joined by shuffles.
BROADCAST_KEYS = 1_000


def position(df: DataFrame, at: str) -> Column:
    """A time as a number: microseconds, days or the number itself."""
    kind = df.schema[at].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(at).cast("timestamp")).cast("double")
    return F.unix_date(at).cast("double") if isinstance(kind, T.DateType) else F.col(at).cast("double")


def cuts(times: DataFrame, most: int = MOST) -> DataFrame:
    """__key, __low, __span and __parts (the part of each span) of every key with more than `most` rows. times: __key and __pos."""
    sizes = times.groupBy("__key").agg(F.count("*").alias("__n"), F.min("__pos").alias("__low"), F.max("__pos").alias("__high")).where((F.col("__n") > most) & (F.col("__high") > F.col("__low")))
    long_keys = sizes.select(F.col("__key").alias("__k"), "__low", ((F.col("__high") - F.col("__low")) / BINS).alias("__span"))
    counted = times.join(long_keys, F.col("__key") == F.col("__k")).groupBy("__key", "__low", "__span", span_of(F.col("__pos")).alias("__bin")).agg(F.count("*").alias("__n"))
    every = long_keys.select(F.col("__k").alias("__key"), "__low", "__span", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("__bin"), F.lit(0).cast("long").alias("__n"))
    dense = counted.unionByName(every).groupBy("__key", "__low", "__span", "__bin").agg(F.sum("__n").alias("__n"))
    before = Window.partitionBy("__key", "__low", "__span").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    placed = dense.withColumn("__part", F.floor(F.coalesce(F.sum("__n").over(before), F.lit(0)) / most).cast("int"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("__bin", "__part"))), lambda x: x["__part"])  # BINS of them
    return placed.groupBy("__key", "__low", "__span").agg(parts.alias("__parts"))


def span_of(pos: Column) -> Column:
    return F.least(F.floor((pos - F.col("__low")) / F.col("__span")), F.lit(BINS - 1)).cast("int")


def with_parts(rows: DataFrame, key: str, at: str, cut: DataFrame) -> DataFrame:
    """rows with __part: the place of the row's part along its key; 0 for keys that aren't cut."""
    few = cut.select(F.col("__key").alias("__k"), "__low", "__span", "__parts")
    if few.count() <= BROADCAST_KEYS:
        few = F.broadcast(few)
    joined = rows.join(few, F.col(key) == F.col("__k"), "left")
    part = F.coalesce(F.get("__parts", span_of(position(rows, at))), F.lit(0)).cast("int")
    return joined.withColumn("__part", part).drop("__k", "__low", "__span", "__parts")


def times_of(*tables: tuple[DataFrame, str, str]) -> DataFrame:
    """__key and __pos of the rows of several tables that go through one scan."""
    return reduce(DataFrame.unionByName, [df.select(F.col(k).alias("__key"), position(df, at).alias("__pos")).where("__key is not null and __pos is not null") for df, k, at in tables])


def carried(rows: DataFrame, key: str, side: DataFrame, names: list[str]) -> DataFrame:
    """rows with the columns of `side` (key, __part and names), which has a row only for cut keys."""
    own = side.select(F.col(key).alias("__k"), F.col("__part").alias("__p"), *names)
    return rows.join(own, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__part") == F.col("__p")), "left").drop("__k", "__p")


def asof_join(anchors: DataFrame, facts: DataFrame, key: str, at: str, fact_at: str, values: list[str], *, direction: str = "backward", strict: bool = False, order: list[str] | None = None, most: int = MOST) -> DataFrame:
    """What temporal.asof_join gives, for keys of any length: anchors with the values of the latest fact before (next after) them.

    Null keys or times match nothing. order: which of several facts at one time comes last (backward) or first (forward).
    """
    back, order = direction == "backward", order or []
    payload = [fact_at, *values]
    known = facts.where(F.col(key).isNotNull() & F.col(fact_at).isNotNull())
    cut = cuts(times_of((anchors, key, at), (known, key, fact_at)), most)
    a, f = with_parts(anchors, key, at, cut), with_parts(known, key, fact_at, cut)
    fact = F.struct(*[F.col(c).alias(c) for c in payload])
    ranked = F.struct(position(facts, fact_at).alias("__0"), *[F.col(o).alias(f"__{i + 1}") for i, o in enumerate(order)])
    edge = F.max_by if back else F.min_by
    ends = f.groupBy(key, "__part").agg(edge(fact, ranked).alias("__end"))
    # every part that anchors stand in, with the end of the nearest part before (behind) it that has facts
    parts = a.groupBy(key, "__part").agg(F.lit(None).cast(ends.schema["__end"].dataType).alias("__end")).unionByName(ends).groupBy(key, "__part").agg(F.first("__end", ignorenulls=True).alias("__end"))
    along = Window.partitionBy(key).orderBy(F.col("__part") if back else -F.col("__part")).rowsBetween(Window.unboundedPreceding, -1)
    long_keys = cut.select(F.col("__key").alias(key))
    past = parts.join(long_keys, key, "left_semi").withColumn("__past", F.last("__end", ignorenulls=True).over(along)).where("__past is not null")
    left = a.select(F.struct(*anchors.columns).alias("__row"), F.col(key).alias("__key"), "__part", position(anchors, at).alias("__at"), F.lit(None).cast(ends.schema["__end"].dataType).alias("__fact"), F.lit(0 if strict else 2).alias("__turn"), *[F.lit(None).cast(facts.schema[o].dataType).alias(f"__o{i}") for i, o in enumerate(order)])
    right = f.select(F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.col(key).alias("__key"), "__part", position(facts, fact_at).alias("__at"), fact.alias("__fact"), F.lit(1).alias("__turn"), *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)])
    time = F.col("__at").asc() if back else F.col("__at").desc()
    ties = [F.col(f"__o{i}").asc() if back else F.col(f"__o{i}").desc() for i in range(len(order))]
    w = Window.partitionBy("__key", "__part").orderBy(time, "__turn", *ties).rowsBetween(Window.unboundedPreceding, 0)
    seen = left.unionByName(right).withColumn("__fact", F.last("__fact", ignorenulls=True).over(w)).where("__row is not null")
    seen = carried(seen, "__key", past.select(F.col(key).alias("__key"), "__part", "__past"), ["__past"])
    there = F.col("__key").isNotNull() & F.col("__at").isNotNull()
    return seen.select("__row.*", *[F.when(there, F.coalesce("__fact", "__past")[c]).alias(c) for c in payload])


def islands(rows: DataFrame, key: str, at: str, order: list[str], state: str, *, most: int = MOST) -> DataFrame:
    """rows with island: the running number of the run of equal states, in the order of `at` and then `order`.

    Rows without a time come first, in one part; a null state equals a null state. Rows without a key are one key.
    """
    cut = cuts(times_of((rows, key, at)), most)
    parts = with_parts(rows, key, at, cut).withColumn("__part", F.when(F.col(at).isNull(), -1).otherwise(F.col("__part")))
    w = Window.partitionBy(key, "__part").orderBy(at, *order)
    changed = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.col(state).eqNullSafe(F.lag(state).over(w))).cast("int"))
    inside = parts.withColumn("__changed", changed).withColumn("__inside", F.sum("__changed").over(w))
    place = F.struct(F.col(at).alias("a"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    held = F.struct(F.col(state).alias("state"))
    ends = inside.groupBy(key, "__part").agg(F.min_by(held, place).alias("__first"), F.max_by(held, place).alias("__last"), F.sum("__changed").alias("__changes"))
    along = Window.partitionBy(key).orderBy("__part")
    new = (~F.col("__first.state").eqNullSafe(F.lag("__last.state").over(along)) | (F.row_number().over(along) == 1)).cast("int")
    told = ends.withColumn("__new", new)
    upto = F.sum(F.col("__new") + F.col("__changes")).over(along) - F.col("__changes")
    first = told.withColumn("__upto", upto).where("__part != 0")  # of a key in one part it is 1
    out = carried(inside, key, first, ["__upto"])
    # part 0 may stand behind rows without a time
    zero = told.withColumn("__upto", upto).where("__part = 0 and __upto != 1").select(F.col(key).alias("__k0"), F.col("__upto").alias("__zero"))
    out = out.join(zero, F.col(key).eqNullSafe(F.col("__k0")) & (F.col("__part") == 0), "left")
    return out.select(*rows.columns, (F.coalesce("__upto", "__zero", F.lit(1)) + F.col("__inside")).alias("island"))


def interval_union(rows: DataFrame, key: str, start: str, end: str, *, most: int = MOST) -> DataFrame:
    """(key, start, end) of the merged intervals; touching ones become one. Intervals without a start or an end don't count."""
    kept = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(key, start, end)
    cut = cuts(times_of((kept, key, start)), most)
    parts = with_parts(kept, key, start, cut)
    long_keys = cut.select(F.col("__key").alias(key))
    w = Window.partitionBy(key, "__part").orderBy(start, end)
    along = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    furthest = parts.join(long_keys, key, "left_semi").groupBy(key, "__part").agg(F.max(end).alias("__end")).withColumn("__past", F.max("__end").over(along)).where("__past is not null")
    reach = F.greatest(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("__past"))
    marked = carried(parts, key, furthest, ["__past"]).withColumn("__new", F.coalesce(F.col(start) > reach, F.lit(True)).cast("int"))
    numbered = marked.withColumn("__own", F.sum("__new").over(w)).drop("__past")
    offset = marked.join(long_keys, key, "left_semi").groupBy(key, "__part").agg(F.sum("__new").alias("__n")).withColumn("__before", F.sum("__n").over(along)).where("__before is not null")
    out = carried(numbered, key, offset, ["__before"]).withColumn("__id", F.col("__own") + F.coalesce("__before", F.lit(0)))
    return out.groupBy(key, "__id").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__id")
