"""Queries on time: as-of and window joins, lags, spells, targets. Each stands with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.functions import scalars as S
from tidemark.operators import relational as R
from tidemark.operators import temporal as T
from tidemark.sources.tables import table

SQL: dict[str, str] = {}
DAY = 86_400_000_000


def _in_time() -> WindowSpec:
    return Window.partitionBy("o_custkey").orderBy("__at")


def _timed(orders: DataFrame) -> DataFrame:
    """orders by customer with their time in microseconds: windows that order by this one column share a sort."""
    return orders.repartition("o_custkey").withColumn("__at", F.unix_micros(F.col("o_orderdate").cast("timestamp")))


def with_previous(orders: DataFrame) -> DataFrame:
    """orders with prev_date, prev_key and prev_value: the customer's latest order at an earlier time, of several the one with the greatest key.

    A running maximum over orders by customer and time: they meet once, with no second copy of them as facts, and are shuffled before
    the records of the maximum are made. Orders without a customer or a time have no previous one, and are none.
    """
    return _previous(_timed(orders)).drop("__at")


def _previous(timed: DataFrame) -> DataFrame:
    there = F.col("o_custkey").isNotNull() & F.col("o_orderdate").isNotNull()
    own = F.when(there, F.struct(F.col("o_orderdate").alias("prev_date"), F.col("o_orderkey").alias("prev_key"), F.col("o_totalprice").alias("prev_value")))
    last = F.when(there, F.max(own).over(_in_time().rangeBetween(Window.unboundedPreceding, -1)))
    return timed.withColumn("__last", last).select(*timed.columns, "__last.*")


def order_features(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """The orders (key, customer, date, price and more columns of theirs) with what is known before each.

    Facts are summed by order first; the window and the previous order come from one shuffle and sort by customer and time.
    """
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", *more)
    carried = table(spark, d, "lineitem", "l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    facts = orders.join(carried, orders.o_orderkey == carried.l_orderkey, "left").drop("l_orderkey")
    w = _in_time().rangeBetween(-365 * DAY, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = _previous(_timed(facts)).withColumns({"games_365": F.count("o_orderkey").over(w), "appearances_365": zero(F.sum("n_lines").over(w)).cast("bigint"), "minutes_365": F.coalesce(F.sum("quantity").over(w), F.lit(0.0))})
    share = F.when(F.col("games_365") > 0, F.round(F.least(F.col("minutes_365") / (90.0 * F.col("games_365")), F.lit(1.05)), 6))
    return out.select(*orders.columns, "games_365", "appearances_365", "minutes_365", share.alias("opportunity_share"), "prev_value", F.datediff("o_orderdate", "prev_date").cast("bigint").alias("staleness_days"))


def pit_order_features(spark: SparkSession, d: str) -> DataFrame:
    """Orders of the customer in the 365 days before each order, what they carried, and the latest earlier value."""
    return order_features(spark, d).drop("o_custkey", "o_orderdate", "o_totalprice")


SQL["pit_order_features"] = """
WITH win AS (
  SELECT a.o_orderkey, count(DISTINCT x.o_orderkey) AS games_365, count(l.l_orderkey) AS appearances_365, coalesce(sum(l.l_quantity), 0.0) AS minutes_365
  FROM orders a LEFT JOIN orders x ON x.o_custkey = a.o_custkey AND x.o_orderdate >= a.o_orderdate - INTERVAL 365 DAY AND x.o_orderdate < a.o_orderdate
  LEFT JOIN lineitem l ON l.l_orderkey = x.o_orderkey GROUP BY a.o_orderkey),
prior AS (
  SELECT o_orderkey, prev_value, prev_date FROM (
    SELECT a.o_orderkey, p.o_totalprice AS prev_value, p.o_orderdate AS prev_date, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY p.o_orderdate DESC, p.o_orderkey DESC) AS rn
    FROM orders a JOIN orders p ON p.o_custkey = a.o_custkey AND p.o_orderdate < a.o_orderdate) q WHERE rn = 1)
SELECT a.o_orderkey, w.games_365, w.appearances_365, w.minutes_365,
  CASE WHEN w.games_365 > 0 THEN round(least(w.minutes_365 / (90.0 * w.games_365), 1.05), 6) END AS opportunity_share, p.prev_value, date_diff('day', p.prev_date, a.o_orderdate) AS staleness_days
FROM orders a JOIN win w USING (o_orderkey) LEFT JOIN prior p USING (o_orderkey)"""


def asof_event_value_backward(spark: SparkSession, d: str) -> DataFrame:
    """Each event with the latest earlier event of its user and the gap in seconds."""
    events = table(spark, d, "events", "event_id", "user_id", "ts", "value")
    facts = events.select("user_id", F.col("ts").alias("prior_ts"), F.col("value").alias("prior_value"), F.col("event_id").alias("prior_id"))
    out = T.asof_join(events, facts, "user_id", "ts", "prior_ts", ["prior_value", "prior_id"], strict=True, order=["prior_id"])
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prior_ts").cast("timestamp"))) / 1e6
    return out.select("event_id", "prior_id", F.round("prior_value", 6).alias("prior_value"), F.round(gap, 3).alias("staleness_seconds"))


SQL["asof_event_value_backward"] = """
WITH f AS (SELECT user_id, ts, max(event_id) AS prior_id FROM events GROUP BY 1, 2),
g AS (SELECT f.user_id, f.ts, f.prior_id, e.value FROM f JOIN events e ON e.event_id = f.prior_id)
SELECT e.event_id, g.prior_id, round(g.value, 6) AS prior_value, round((epoch_us(e.ts) - epoch_us(g.ts)) / 1e6, 3) AS staleness_seconds
FROM events e ASOF LEFT JOIN g ON e.user_id = g.user_id AND e.ts > g.ts"""


def asof_nearest_tolerance(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's signup nearest in time within 30 days, and the band of the gap."""
    events = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    anchors = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    facts = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("signup_ts"), F.col("event_id").alias("signup_id"))
    out = T.nearest_join(anchors, facts, "user_id", "event_id", "ts", "signup_ts", "signup_id", 30 * 86400.0)
    g = F.col("gap_seconds")
    band = F.when(g <= 86400, "1d").when(g <= 7 * 86400, "7d").when(g <= 30 * 86400, "30d").otherwise("none")
    return out.select("event_id", F.round(g, 3).alias("gap_seconds"), band.alias("band"))


SQL["asof_nearest_tolerance"] = """
WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), s AS (SELECT user_id, ts FROM events WHERE event_type = 'signup'),
g AS (SELECT p.event_id, min(abs(epoch_us(p.ts) - epoch_us(s.ts)) / 1e6) AS gap FROM p LEFT JOIN s USING (user_id) GROUP BY 1)
SELECT event_id, CASE WHEN gap <= 2592000 THEN round(gap, 3) END AS gap_seconds,
  CASE WHEN gap <= 86400 THEN '1d' WHEN gap <= 604800 THEN '7d' WHEN gap <= 2592000 THEN '30d' ELSE 'none' END AS band FROM g"""


def first_after_anchor(spark: SparkSession, d: str) -> DataFrame:
    """The customer's next order and the days to it."""
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    later = orders.select("o_custkey", F.col("o_orderdate").alias("next_date"), F.col("o_orderkey").alias("next_key"))
    out = T.asof_join(orders, later, "o_custkey", "o_orderdate", "next_date", ["next_key"], direction="forward", strict=True, order=["next_key"])
    return out.select("o_orderkey", "next_key", F.datediff("next_date", "o_orderdate").cast("bigint").alias("days_to_next"))


SQL["first_after_anchor"] = """
SELECT o_orderkey, next_key, date_diff('day', o_orderdate, next_date) AS days_to_next FROM (
  SELECT a.o_orderkey, a.o_orderdate, n.o_orderkey AS next_key, n.o_orderdate AS next_date, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY n.o_orderdate, n.o_orderkey) AS rn
  FROM orders a LEFT JOIN orders n ON n.o_custkey = a.o_custkey AND n.o_orderdate > a.o_orderdate) q WHERE rn = 1"""


def customer_years(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice")
    return orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


_YEARS = "WITH y AS (SELECT o_custkey, year(o_orderdate)::INT AS year, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2)"


def lag_by_year_gap_safe(spark: SparkSession, d: str) -> DataFrame:
    """Customer-year totals with those of exactly one, two and three years before."""
    return T.lag_join(customer_years(spark, d), "o_custkey", "year", "total", [1, 2, 3])


SQL["lag_by_year_gap_safe"] = _YEARS + """
SELECT y.o_custkey, y.year, y.total, a.total AS total_lag1, b.total AS total_lag2, c.total AS total_lag3 FROM y
LEFT JOIN y a ON a.o_custkey = y.o_custkey AND a.year = y.year - 1 LEFT JOIN y b ON b.o_custkey = y.o_custkey AND b.year = y.year - 2 LEFT JOIN y c ON c.o_custkey = y.o_custkey AND c.year = y.year - 3"""


def rolling_three_and_trend(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the three preceding years that are there, and the change between the last two of them."""
    w = Window.partitionBy("o_custkey").orderBy("year").rangeBetween(-3, -1)
    out = T.lag_join(customer_years(spark, d), "o_custkey", "year", "total", [1, 2]).withColumn("mean_3", F.round(F.avg("total").over(w), 4))
    return out.select("o_custkey", "year", "mean_3", F.round(F.col("total_lag1") - F.col("total_lag2"), 4).alias("trend"))


SQL["rolling_three_and_trend"] = _YEARS + """
SELECT y.o_custkey, y.year, round((SELECT avg(total) FROM y p WHERE p.o_custkey = y.o_custkey AND p.year BETWEEN y.year - 3 AND y.year - 1), 4) AS mean_3, round(a.total - b.total, 4) AS trend
FROM y LEFT JOIN y a ON a.o_custkey = y.o_custkey AND a.year = y.year - 1 LEFT JOIN y b ON b.o_custkey = y.o_custkey AND b.year = y.year - 2"""


def prior_season_fallback(spark: SparkSession, d: str) -> DataFrame:
    """For each customer and target year the latest total of that year or before, and how old it is."""
    panel = customer_years(spark, d)
    wanted = panel.select("o_custkey").distinct().select("o_custkey", F.explode(F.sequence(F.lit(1996), F.lit(2000), F.lit(2))).alias("target"))
    out = T.asof_join(wanted, panel, "o_custkey", "target", "year", ["total"])
    return out.select("o_custkey", "target", "total", (F.col("target") - F.col("year")).alias("age"))


SQL["prior_season_fallback"] = _YEARS + """, w AS (SELECT DISTINCT o_custkey, target FROM orders, (SELECT unnest([1996, 1998, 2000])::INT AS target) t)
SELECT w.o_custkey, target, total, target - year AS age FROM w ASOF LEFT JOIN y ON y.o_custkey = w.o_custkey AND w.target >= y.year"""


def peer_median_window(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each customer in 1995 against the median of its nation's customers."""
    orders = table(spark, d, "orders", "o_custkey", "o_orderdate").where("o_orderdate >= timestamp_ntz'1995-01-01' and o_orderdate < timestamp_ntz'1996-01-01'")
    counts = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    out = table(spark, d, "customer", "c_custkey", "c_nationkey").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_nationkey", F.coalesce("n", F.lit(0)).alias("n_orders"))
    medians = out.groupBy("c_nationkey").agg(F.percentile("n_orders", 0.5).alias("peer_median"))
    return out.join(medians, "c_nationkey").select("c_custkey", "n_orders", "peer_median", F.round(S.safe_divide(F.col("n_orders"), F.col("peer_median")), 6).alias("coverage"))


SQL["peer_median_window"] = """
WITH n AS (SELECT c_custkey, c_nationkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1, 2),
m AS (SELECT c_nationkey, quantile_cont(n_orders, 0.5) AS peer_median FROM n GROUP BY 1)
SELECT c_custkey, n_orders, peer_median, CASE WHEN peer_median > 0 THEN round(n_orders / peer_median, 6) END AS coverage FROM n JOIN m USING (c_nationkey)"""


def interval_overlap_days(spark: SparkSession, d: str) -> DataFrame:
    """Days of each open order (order to last shipment) in the first quarter of 1996, and their share."""
    spans = _order_spans(spark, d)
    low, high = F.lit("1996-01-01").cast("date"), F.lit("1996-04-01").cast("date")
    days = S.clip(T.overlap_days(F.col("start"), F.col("end"), low, high), 0)
    length = F.datediff("end", "start")
    return spans.select("l_orderkey", days.cast("bigint").alias("days_in"), F.round(S.safe_divide(days, length), 6).alias("share")).where("days_in > 0")


def _order_spans(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "lineitem", "l_orderkey", "l_shipdate").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last_ship"))
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    both = last.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "o_custkey", F.to_date("o_orderdate").alias("start"), F.greatest(F.to_date("last_ship"), F.to_date("o_orderdate")).alias("end"))


_SPANS = """WITH s AS (SELECT l_orderkey, o_custkey, o_orderdate::DATE AS a, greatest(max(l_shipdate)::DATE, o_orderdate::DATE) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_custkey, o_orderdate)"""
SQL["interval_overlap_days"] = _SPANS + """, o AS (SELECT l_orderkey, greatest(0, date_diff('day', greatest(a, DATE '1996-01-01'), least(b, DATE '1996-04-01'))) AS days_in, date_diff('day', a, b) AS n FROM s)
SELECT l_orderkey, days_in, CASE WHEN n > 0 THEN round(days_in / n, 6) END AS share FROM o WHERE days_in > 0"""


def interval_union_days(spark: SparkSession, d: str) -> DataFrame:
    """Days on which a customer had any open order, overlaps counted once."""
    merged = T.interval_union(_order_spans(spark, d), "o_custkey", "start", "end")
    return merged.groupBy("o_custkey").agg(F.count("*").alias("n_spells"), F.sum(F.datediff("end", "start")).alias("days"))


SQL["interval_union_days"] = _SPANS + """, r AS (SELECT *, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS part FROM r),
m AS (SELECT o_custkey, part, min(a) AS a, max(b) AS b FROM i GROUP BY 1, 2)
SELECT o_custkey, count(*) AS n_spells, sum(date_diff('day', a, b))::BIGINT AS days FROM m GROUP BY 1"""


def spell_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal event types of a user: type, length, first and last event."""
    runs = T.islands(table(spark, d, "events", "event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n_events"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_id"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_id"))


SQL["spell_islands"] = """
WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM c)
SELECT user_id, island, min(event_type) AS event_type, count(*) AS n_events, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM i GROUP BY 1, 2"""


def reason_codes_target(spark: SparkSession, d: str) -> DataFrame:
    """Activity in both of two years after the first order: 1, 0, or null with the reasons why it isn't known."""
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    cutoff = orders.agg(F.max(F.to_date("o_orderdate")).alias("cutoff"))
    first = F.min(F.to_date("o_orderdate")).over(Window.partitionBy("o_custkey"))
    days = F.datediff(F.to_date("o_orderdate"), F.col("anchor"))
    per = orders.withColumn("anchor", first).groupBy("o_custkey", "anchor").agg(F.count_if(days.between(1, 365)).alias("y1"), F.count_if(days.between(366, 730)).alias("y2"))
    out = per.crossJoin(F.broadcast(cutoff))  # one row
    seen1, seen2 = S.observable(F.col("anchor"), 365, F.col("cutoff")), S.observable(F.col("anchor"), 730, F.col("cutoff"))
    few = F.col("y1") + F.col("y2") < 2
    known = seen1 & seen2 & ~few
    return out.select("o_custkey", F.when(known, ((F.col("y1") >= 1) & (F.col("y2") >= 1)).cast("int")).alias("target"), S.reasons((~seen1, "year1_not_observed"), (~seen2, "year2_not_observed"), (few, "too_few_orders")).alias("reasons"))


SQL["reason_codes_target"] = """
WITH a AS (SELECT o_custkey, min(o_orderdate::DATE) AS anchor FROM orders GROUP BY 1), c AS (SELECT max(o_orderdate::DATE) AS cutoff FROM orders),
p AS (SELECT o_custkey, anchor, count(*) FILTER (date_diff('day', anchor, o_orderdate::DATE) BETWEEN 1 AND 365) AS y1, count(*) FILTER (date_diff('day', anchor, o_orderdate::DATE) BETWEEN 366 AND 730) AS y2 FROM orders JOIN a USING (o_custkey) GROUP BY 1, 2)
SELECT o_custkey, CASE WHEN anchor + 730 <= cutoff AND y1 + y2 >= 2 THEN (y1 >= 1 AND y2 >= 1)::INT END AS target,
  concat_ws(';', CASE WHEN anchor + 365 > cutoff THEN 'year1_not_observed' END, CASE WHEN anchor + 730 > cutoff THEN 'year2_not_observed' END, CASE WHEN y1 + y2 < 2 THEN 'too_few_orders' END) AS reasons FROM p, c"""


def reason_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each reason is given."""
    return reason_codes_target(spark, d).select(F.explode(F.split("reasons", ";")).alias("reason")).where("reason != ''").groupBy("reason").agg(F.count("*").alias("n"))


SQL["reason_counts"] = f"WITH t AS ({SQL['reason_codes_target']}) SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ';')) AS reason FROM t) u WHERE reason <> '' GROUP BY 1"


def competing_states(spark: SparkSession, d: str) -> DataFrame:
    """What came first after each signup within 30 days: a purchase, an error, something else or nothing."""
    events = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    anchors = events.where("event_type = 'signup'").select("event_id", "user_id", "ts")
    after = events.where("event_type != 'signup'").select("user_id", F.col("ts").alias("next_ts"), F.col("event_type").alias("next_type"), F.col("event_id").alias("next_id"))
    out = T.asof_join(anchors, after, "user_id", "ts", "next_ts", ["next_type", "next_id"], direction="forward", strict=True, order=["next_id"])
    inside = F.col("next_ts") <= F.col("ts") + F.expr("interval 30 days")
    state = F.when(inside & (F.col("next_type") == "purchase"), "purchase").when(inside & (F.col("next_type") == "error"), "error").when(inside, "other").otherwise("none")
    return out.select("event_id", state.alias("state"))


SQL["competing_states"] = """
SELECT event_id, CASE WHEN nts <= ts + INTERVAL 30 DAY THEN CASE WHEN ntype IN ('purchase', 'error') THEN ntype ELSE 'other' END ELSE 'none' END AS state FROM (
  SELECT a.event_id, a.ts, n.ts AS nts, n.event_type AS ntype, row_number() OVER (PARTITION BY a.event_id ORDER BY n.ts, n.event_id) AS rn
  FROM events a LEFT JOIN events n ON n.user_id = a.user_id AND n.ts > a.ts AND n.event_type <> 'signup' WHERE a.event_type = 'signup') q WHERE rn = 1"""


def anchor_profile(spark: SparkSession, d: str) -> DataFrame:
    """Each order with its customer's recent (180 days) and earlier (to 365 days) order rates, the shift, a smoothed share of large ones, and the latest date used."""
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    by = Window.partitionBy("o_custkey").orderBy(F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    recent, all_ = by.rangeBetween(-180 * DAY, -1), by.rangeBetween(-365 * DAY, -1)
    big = (F.col("o_totalprice") > 150000).cast("int")
    out = orders.select("o_orderkey", "o_orderdate", F.count("*").over(recent).alias("n_recent"), F.count("*").over(all_).alias("n_all"), F.coalesce(F.sum(big).over(all_), F.lit(0)).alias("n_big"), F.max("o_orderdate").over(all_).alias("latest"))
    earlier = F.col("n_all") - F.col("n_recent")
    return out.select("o_orderkey", "n_recent", earlier.alias("n_earlier"), F.round(F.col("n_recent") / 180.0 - earlier / 185.0, 6).alias("rate_shift"), F.round(S.smoothed(F.col("n_big"), F.col("n_all")), 6).alias("big_share"), F.coalesce(F.col("latest") < F.col("o_orderdate"), F.lit(True)).alias("no_leak"))


SQL["anchor_profile"] = """
WITH p AS (SELECT a.o_orderkey, count(x.o_orderkey) FILTER (x.o_orderdate >= a.o_orderdate - INTERVAL 180 DAY) AS r, count(x.o_orderkey) AS n, count(*) FILTER (x.o_totalprice > 150000) AS big
  FROM orders a LEFT JOIN orders x ON x.o_custkey = a.o_custkey AND x.o_orderdate < a.o_orderdate AND x.o_orderdate >= a.o_orderdate - INTERVAL 365 DAY GROUP BY 1)
SELECT o_orderkey, r AS n_recent, n - r AS n_earlier, round(r / 180.0::DOUBLE - (n - r) / 185.0::DOUBLE, 6) AS rate_shift, round((big + 1) / (n + 2), 6) AS big_share, true AS no_leak FROM p"""


BOUNDS = (0, 182, 365, 547, 730, 912, 1095, 1277, 1460)


def person_periods(spark: SparkSession, d: str) -> DataFrame:
    """Person-period rows of the time to the next order, and the hazard and survival of each half-year."""
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    cutoff = orders.agg(F.max(F.to_date("o_orderdate")).alias("cutoff"))
    day = F.to_date("o_orderdate")
    subjects = orders.select("o_orderkey", F.datediff(F.lead(day).over(w), day).alias("event_days"), day.alias("day")).crossJoin(F.broadcast(cutoff))  # one row
    subjects = subjects.select("o_orderkey", F.when(F.col("event_days") > 0, F.col("event_days")).alias("event_days"), F.least(F.lit(1460), F.datediff("cutoff", "day")).alias("followup"))
    spans = F.array(*[F.struct(F.lit(i + 1).alias("period"), F.lit(a).alias("low"), F.lit(b).alias("high")) for i, (a, b) in enumerate(zip(BOUNDS, BOUNDS[1:], strict=False))])
    rows = subjects.select("*", F.explode(spans).alias("s")).select("*", "s.*")
    here = F.coalesce((F.col("event_days") > F.col("low")) & (F.col("event_days") <= F.col("high")), F.lit(False))
    alive = F.col("event_days").isNull() | (F.col("event_days") > F.col("low"))
    return rows.where(alive & (here | (F.col("followup") >= F.col("high")))).select("o_orderkey", "period", here.cast("int").alias("hazard_event"))


def person_period_hazard(spark: SparkSession, d: str) -> DataFrame:
    per = person_periods(spark, d).groupBy("period").agg(F.count("*").alias("n_at_risk"), F.sum("hazard_event").alias("n_events"))
    h = F.least(F.greatest(F.col("n_events") / F.col("n_at_risk"), F.lit(1e-6)), F.lit(1 - 1e-6))
    survival = F.exp(F.sum(F.log(1 - h)).over(Window.orderBy("period")))  # eight rows
    return per.select("period", "n_at_risk", "n_events", F.round(h, 6).alias("hazard"), F.round(survival, 6).alias("survival"))


SQL["person_period_hazard"] = """
WITH c AS (SELECT max(o_orderdate::DATE) AS cutoff FROM orders),
s AS (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS e, least(1460, date_diff('day', o_orderdate::DATE, cutoff)) AS f FROM orders, c),
p(period, low, high) AS (VALUES (1, 0, 182), (2, 182, 365), (3, 365, 547), (4, 547, 730), (5, 730, 912), (6, 912, 1095), (7, 1095, 1277), (8, 1277, 1460)),
t AS (SELECT period, (CASE WHEN e > 0 THEN e END) AS e, f, low, high FROM s, p),
r AS (SELECT period, coalesce(e > low AND e <= high, false)::INT AS ev FROM t WHERE (e IS NULL OR e > low) AND (coalesce(e > low AND e <= high, false) OR f >= high)),
h AS (SELECT period, count(*) AS n_at_risk, sum(ev)::BIGINT AS n_events, least(greatest(sum(ev) / count(*), 1e-6), 1 - 1e-6) AS hz FROM r GROUP BY 1)
SELECT period, n_at_risk, n_events, round(hz, 6) AS hazard, round(exp(sum(ln(1 - hz)) OVER (ORDER BY period)), 6) AS survival FROM h"""


def consecutive_growth_cagr(spark: SparkSession, d: str) -> DataFrame:
    """Nation-year revenue with one-year growth, three-year compound growth and the mean and spread of three full years."""
    orders = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice").join(table(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    years = orders.groupBy("c_nationkey", F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))
    out = T.lag_join(years, "c_nationkey", "year", "revenue", [1, 2, 3])
    three = Window.partitionBy("c_nationkey").orderBy("year").rangeBetween(-2, 0)
    full3 = F.count("revenue").over(three) == 3
    out = out.withColumn("mean3", F.when(full3, F.round(F.avg("revenue").over(three), 2))).withColumn("spread3", F.when(full3, F.round(F.stddev_pop("revenue").over(three), 2)))
    there = F.col("revenue_lag1").isNotNull() & F.col("revenue_lag2").isNotNull() & (F.col("revenue_lag3") > 0)
    cagr = F.when(there, F.round(F.pow(F.col("revenue") / F.col("revenue_lag3"), F.lit(1 / 3)) - 1, 6))
    return out.select("c_nationkey", "year", "revenue", F.round(S.safe_divide(F.col("revenue"), F.col("revenue_lag1")) - 1, 6).alias("growth"), cagr.alias("cagr3"), "mean3", "spread3")


SQL["consecutive_growth_cagr"] = """
WITH y AS (SELECT c_nationkey, year(o_orderdate)::INT AS year, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT y.c_nationkey, y.year, y.revenue, round(y.revenue / a.revenue - 1, 6) AS growth, CASE WHEN a.revenue IS NOT NULL AND b.revenue IS NOT NULL AND c.revenue > 0 THEN round(pow(y.revenue / c.revenue, 1 / 3) - 1, 6) END AS cagr3,
  CASE WHEN a.revenue IS NOT NULL AND b.revenue IS NOT NULL THEN round((y.revenue + a.revenue + b.revenue) / 3, 2) END AS mean3,
  CASE WHEN a.revenue IS NOT NULL AND b.revenue IS NOT NULL THEN round((SELECT stddev_pop(x.revenue) FROM y x WHERE x.c_nationkey = y.c_nationkey AND x.year BETWEEN y.year - 2 AND y.year), 2) END AS spread3
FROM y LEFT JOIN y a ON a.c_nationkey = y.c_nationkey AND a.year = y.year - 1 LEFT JOIN y b ON b.c_nationkey = y.c_nationkey AND b.year = y.year - 2 LEFT JOIN y c ON c.c_nationkey = y.c_nationkey AND c.year = y.year - 3"""


def window_batch_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events by day and type: the batch twin of the tumbling stream."""
    events = table(spark, d, "events", "event_id", "ts", "event_type", "value")
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 2).alias("total"))


SQL["window_batch_counts"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n_events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


def session_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a user: runs of events with gaps below six hours."""
    events = table(spark, d, "events", "event_id", "user_id", "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    rows = events.withColumn("new", F.coalesce(gap >= 6 * 3600 * 1_000_000, F.lit(True)).cast("int"))
    per = rows.groupBy("user_id").agg(F.sum("new").alias("n_sessions"), F.count("*").alias("n_events"))
    return per


SQL["session_counts"] = """
WITH g AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
SELECT user_id, count(*) FILTER (gap IS NULL OR gap >= 21600000000) AS n_sessions, count(*) AS n_events FROM g GROUP BY 1"""


def live_overlay_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Latest value of each user and type, later events laid over earlier ones."""
    events = table(spark, d, "events", "event_id", "user_id", "event_type", "ts", "value")
    cut = "timestamp_ntz'2024-01-16'"
    base, newer = events.where(f"ts < {cut}"), events.where(f"ts >= {cut}")
    return R.later_wins(base, newer, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


SQL["live_overlay_upsert"] = "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, round(arg_max(value, (ts, event_id)), 6) AS value FROM events GROUP BY 1, 2"

QUERIES = {
    f.__name__: f
    for f in (
        pit_order_features, asof_event_value_backward, asof_nearest_tolerance, first_after_anchor, lag_by_year_gap_safe, rolling_three_and_trend, prior_season_fallback, peer_median_window, interval_overlap_days, interval_union_days, spell_islands,
        reason_codes_target, reason_counts, competing_states, anchor_profile, person_period_hazard, consecutive_growth_cagr, window_batch_counts, session_counts, live_overlay_upsert,
    )
}
