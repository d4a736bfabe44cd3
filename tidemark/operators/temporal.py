"""Point-in-time joins and spells. None explodes anchors with facts unless the result asks for each pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_join(anchors: DataFrame, facts: DataFrame, key: str, at: str, fact_at: str, values: list[str], *, direction: str = "backward", strict: bool = False, order: list[str] | None = None) -> DataFrame:
    """anchors with the values of the latest fact before (or the next after) each anchor, and its time as <fact_at>.

    Anchors and facts of a key are sorted once, and the last fact seen is carried forward; no anchor meets more than one
    fact. strict: a fact at the very time of the anchor doesn't count. order: which of several facts at one time comes
    last (backward) or first (forward). Anchors without a fact get nulls; null keys or times match nothing.
    """
    back = direction == "backward"
    order = order or []
    payload = F.struct(F.col(fact_at).alias(fact_at), *[F.col(v).alias(v) for v in values])
    # with strict backward, anchors stand before facts of the same time; forward is the mirror image
    left = anchors.select(F.struct(*anchors.columns).alias("__row"), F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(None).cast(_type(facts, payload)).alias("__fact"), F.lit(0 if strict else 2).alias("__turn"), *[F.lit(None).cast(facts.schema[o].dataType).alias(f"__o{i}") for i, o in enumerate(order)])
    right = facts.where(F.col(key).isNotNull() & F.col(fact_at).isNotNull()).select(F.lit(None).cast(_type(anchors, F.struct(*anchors.columns))).alias("__row"), F.col(key).alias("__key"), F.col(fact_at).alias("__at"), payload.alias("__fact"), F.lit(1).alias("__turn"), *[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)])
    time = F.col("__at").asc() if back else F.col("__at").desc()
    ties = [F.col(f"__o{i}").asc() if back else F.col(f"__o{i}").desc() for i in range(len(order))]
    w = Window.partitionBy("__key").orderBy(time, "__turn", *ties).rowsBetween(Window.unboundedPreceding, 0)
    seen = left.unionByName(right).withColumn("__fact", F.last("__fact", ignorenulls=True).over(w)).where("__row is not null")
    there = F.col("__key").isNotNull() & F.col("__at").isNotNull()
    return seen.select("__row.*", *[F.when(there, F.col(f"__fact.{c}")).alias(c) for c in (fact_at, *values)])


def no_older(df: DataFrame, at: str, fact_at: str, values: list[str], seconds: float) -> DataFrame:
    """What asof_join found, null where the fact is older than so many seconds."""
    age = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(fact_at).cast("timestamp"))) / 1e6
    fresh = age <= seconds
    return df.withColumns({c: F.when(fresh, F.col(c)) for c in (fact_at, *values)})


def _type(df: DataFrame, c: Column) -> str:
    return df.select(c.alias("x")).schema["x"].dataType.simpleString()


def nearest_join(anchors: DataFrame, facts: DataFrame, key: str, anchor_id: str, at: str, fact_at: str, value: str, tolerance: float) -> DataFrame:
    """anchors with the value nearest in time on either side within a tolerance in seconds; of equal gaps the earlier one."""
    before = asof_join(anchors, facts, key, at, fact_at, [value], order=[value]).withColumnsRenamed({fact_at: "__t1", value: "__v1"})
    both = asof_join(before, facts, key, at, fact_at, [value], direction="forward", strict=True, order=[value]).withColumnsRenamed({fact_at: "__t2", value: "__v2"})
    seconds = lambda a, b: (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 1e6
    g1, g2 = seconds(F.col(at), F.col("__t1")), seconds(F.col("__t2"), F.col(at))
    first = g1.isNotNull() & (g2.isNull() | (g1 <= g2))
    gap = F.when(first, g1).otherwise(g2)
    ok = gap <= tolerance
    names = [c for c in both.columns if not c.startswith("__")]
    return both.select(*names, F.when(ok, F.when(first, F.col("__t1")).otherwise(F.col("__t2"))).alias(fact_at), F.when(ok, F.when(first, F.col("__v1")).otherwise(F.col("__v2"))).alias(value), F.when(ok, gap).alias("gap_seconds"))


def window_join(anchors: DataFrame, facts: DataFrame, key: str, at: str, fact_key: str, fact_at: str, start_days: int, end_days: int, *, closed: str = "left") -> DataFrame:
    """anchors left-joined with each fact of their key in [at + start, at + end), or (.., ..] with closed='right'.

    Facts should be pre-aggregated to what the window needs: each row of the result is one anchor with one fact.
    """
    lo, hi = F.col(at) + F.make_dt_interval(F.lit(start_days)), F.col(at) + F.make_dt_interval(F.lit(end_days))
    inside = (F.col(fact_at) >= lo) & (F.col(fact_at) < hi) if closed == "left" else (F.col(fact_at) > lo) & (F.col(fact_at) <= hi)
    return anchors.join(facts, (F.col(key) == F.col(fact_key)) & inside, "left")


def trailing_sum(events: DataFrame, key: str, at: str, values: dict[str, Column], days: int) -> DataFrame:
    """Each event with sums over its key's events in [at - days, at). One sort by key and time, no join."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-days * 86_400_000_000, -1)
    return events.withColumns({name: F.sum(c).over(w) for name, c in values.items()})


def lag_join(panel: DataFrame, key: str, period: str, value: str, lags: list[int]) -> DataFrame:
    """panel with the value of exactly so many periods before; a gap gives null."""
    out = panel
    for lag in lags:
        w = Window.partitionBy(key).orderBy(period).rangeBetween(-lag, -lag)
        out = out.withColumn(f"{value}_lag{lag}", F.max(value).over(w))
    return out


def islands(rows: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """rows with island: the running number of the run of equal states that each is in."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = F.coalesce(~F.col(state).eqNullSafe(F.lag(state).over(w)) | (F.row_number().over(w) == 1), F.lit(True)).cast("int")
    return rows.withColumn("__changed", changed).withColumn("island", F.sum("__changed").over(w)).drop("__changed")


def interval_union(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end) of the merged intervals; touching ones become one."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = rows.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("__new", F.coalesce(F.col(start) > reach, F.lit(True)).cast("int")).withColumn("__part", F.sum("__new").over(w))
    return part.groupBy(key, "__part").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__part")


def overlap_days(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Days of [start, end] within [low, high); 0 outside."""
    return F.greatest(F.lit(0), F.datediff(F.least(end, high), F.greatest(start, low)))
