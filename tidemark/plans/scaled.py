"""Queries on keys that hold a large share of all rows, peers in each anchor's window, and names by similarity. Each stands with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import peers, scans, similarity
from tidemark.operators import temporal as T
from tidemark.sources import nested
from tidemark.sources.tables import table

SQL: dict[str, str] = {}
#: Rows of a part of a long key: few enough that each status is cut, even in small tables.
PART = 2_000


def previous_of_status(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the latest earlier order of its status; a status holds a third of all orders, and is scanned in parts."""
    orders = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    facts = orders.select("o_orderstatus", F.col("o_orderdate").alias("prev_date"), F.col("o_orderkey").alias("prev_key"), F.col("o_totalprice").alias("prev_price"))
    out = scans.asof_join(orders, facts, "o_orderstatus", "o_orderdate", "prev_date", ["prev_key", "prev_price"], strict=True, order=["prev_key"], most=PART)
    return out.select("o_orderkey", "prev_key", F.round(F.col("o_totalprice") - F.col("prev_price"), 2).alias("change"), F.datediff("o_orderdate", "prev_date").cast("bigint").alias("days"))


SQL["previous_of_status"] = """
WITH f AS (SELECT o_orderstatus, o_orderdate, max(o_orderkey) AS prev_key FROM orders GROUP BY 1, 2), g AS (SELECT f.*, o.o_totalprice AS prev_price FROM f JOIN orders o ON o.o_orderkey = prev_key)
SELECT o.o_orderkey, prev_key, round(o.o_totalprice - prev_price, 2) AS change, date_diff('day', g.o_orderdate, o.o_orderdate) AS days FROM orders o ASOF LEFT JOIN g ON g.o_orderstatus = o.o_orderstatus AND o.o_orderdate > g.o_orderdate"""


def price_spells_of_status(spark: SparkSession, d: str) -> DataFrame:
    """Runs of large and of small orders of a status in the order of time, scanned in parts: their number, length and ends."""
    orders = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice").withColumn("large", F.col("o_totalprice") > 250000)
    runs = scans.islands(orders, "o_orderstatus", "o_orderdate", ["o_orderkey"], "large", most=PART)
    place = F.struct("o_orderdate", "o_orderkey")
    return runs.groupBy("o_orderstatus", "island").agg(F.min("large").alias("large"), F.count("*").alias("n_orders"), F.min_by("o_orderkey", place).alias("first_key"), F.max_by("o_orderkey", place).alias("last_key"))


SQL["price_spells_of_status"] = """
WITH c AS (SELECT *, o_totalprice > 250000 AS large, CASE WHEN (o_totalprice > 250000) IS DISTINCT FROM lag(o_totalprice > 250000) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS changed FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey)),
i AS (SELECT *, sum(changed) OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM c)
SELECT o_orderstatus, island, min(large) AS large, count(*) AS n_orders, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_key, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_key FROM i GROUP BY 1, 2"""


def shipping_spans_of_status(spark: SparkSession, d: str) -> DataFrame:
    """Spans of seconds in which orders of a status and large lines were open, one hour each, merged in parts along time."""
    lines = table(spark, d, "lineitem", "l_linestatus", "l_shipdate", "l_quantity")
    spans = lines.select("l_linestatus", F.col("l_shipdate").alias("since"), (F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int"))).alias("until")).where("l_quantity >= 49")
    return scans.interval_union(spans, "l_linestatus", "since", "until", most=PART // 4)


SQL["shipping_spans_of_status"] = """
WITH s AS (SELECT l_linestatus, l_shipdate AS since, l_shipdate + to_days(l_quantity::INT) AS until FROM lineitem WHERE l_quantity >= 49),
r AS (SELECT *, max(until) OVER (PARTITION BY l_linestatus ORDER BY since, until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR since > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_linestatus ORDER BY since, until ROWS UNBOUNDED PRECEDING) AS part FROM r)
SELECT l_linestatus, min(since) AS since, max(until) AS until FROM i GROUP BY l_linestatus, part"""


def peer_median_by_anchor(spark: SparkSession, d: str) -> DataFrame:
    """For each day on which a customer ordered: its orders in the 365 days before, the median of all customers of its nation in those days, and their ratio."""
    orders = table(spark, d, "orders", "o_custkey", "o_orderdate").withColumn("day", F.to_date("o_orderdate"))
    members = table(spark, d, "customer", "c_custkey", "c_nationkey").withColumnRenamed("c_custkey", "o_custkey")
    steps = peers.window_counts(orders, "o_custkey", "day", 365)
    anchors = orders.select("o_custkey", "day").distinct().join(members, "o_custkey")
    medians = peers.peer_medians(anchors, members, steps, "c_nationkey", "o_custkey", "day")
    own = T.asof_join(anchors.withColumn("at", F.unix_date("day")), steps, "o_custkey", "at", "since", ["n"])
    out = own.join(medians, ["c_nationkey", "day"]).withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("o_custkey", "day", F.col("n").alias("n_orders"), "n_peers", "peer_median", F.round(S.safe_divide(F.col("n"), F.col("peer_median")), 6).alias("coverage"))


SQL["peer_median_by_anchor"] = """
WITH o AS (SELECT o_custkey, c_nationkey, o_orderdate::DATE AS day, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
a AS (SELECT DISTINCT c_nationkey, day FROM o),
k AS (SELECT a.c_nationkey, a.day, c.c_custkey, coalesce(sum(o.n), 0)::BIGINT AS n FROM a JOIN customer c ON c.c_nationkey = a.c_nationkey LEFT JOIN o ON o.o_custkey = c.c_custkey AND o.day < a.day AND o.day >= a.day - 365 GROUP BY ALL),
m AS (SELECT c_nationkey, day, count(*) AS n_peers, quantile_cont(n, 0.5) AS peer_median FROM k GROUP BY ALL)
SELECT o.o_custkey, o.day, k.n AS n_orders, n_peers, peer_median, CASE WHEN peer_median > 0 THEN round(k.n / peer_median, 6) END AS coverage
FROM o JOIN m USING (c_nationkey, day) JOIN k ON k.c_custkey = o.o_custkey AND k.day = o.day AND k.c_nationkey = o.c_nationkey"""


def three_tier_name_matches(spark: SparkSession, d: str) -> DataFrame:
    """Parts written in other ways and with typing errors, matched within their brand by name, by sorted words and by ratio."""
    parts, k = table(spark, d, "part", "p_partkey", "p_name", "p_brand"), F.col("p_partkey")
    words = F.split("p_name", " ")
    typed = F.when(k % 7 == 1, F.overlay("p_name", F.lit("x"), F.lit(3), F.lit(1))).when(k % 7 == 2, F.concat("p_name", F.lit("ish"))).when(k % 7 == 3, F.concat_ws(" ", F.get(words, F.lit(1)), words[0])).when(k % 7 == 4, F.translate("p_name", "aeiou", "")).otherwise(F.upper("p_name"))
    named = lambda c: (S.name_key(c).alias("name"), S.token_signature(c).alias("words"))
    left, right = parts.select("p_partkey", "p_brand", *named(typed)), parts.select(k.alias("match_key"), "p_brand", *named(F.col("p_name")))
    lines = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_returnflag")
    mine = lines.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").distinct()
    theirs = lines.where("l_returnflag <> 'R'").select(F.col("l_partkey").alias("match_key"), "l_suppkey").distinct()
    return similarity.three_tier_matches(left, right, ["p_brand"], "p_partkey", "match_key", "name", "words", mine, theirs, "l_suppkey")


def nested_event_documents(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user and day as one nested document each, read back as variants: counts and sums of a qualifier by type and place in the day."""
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value", "props")
    item = F.struct("ts", "event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.struct("value", F.col("props")).alias("body"))).alias("text"))
    days = e.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(item)).alias("items"))  # one user's day
    text = F.concat(F.lit('{"events":['), F.array_join(F.transform("items", lambda x: x["text"]), ","), F.lit("]}"))
    docs = nested.parsed(days.select("user_id", "day", text.alias("text")), "text")
    rows = nested.picked(nested.exploded(docs, "doc", "$.events", ["user_id", "day"]), "item", {"type": ("$.type", "string"), "value": ("$.body.value", "double"), "props": ("$.body.props", "string")})
    rows = nested.picked(nested.parsed(rows, "props", "inner"), "inner", {"k": ("$.k", "int")})
    return rows.groupBy("type", F.least("pos", F.lit(3)).alias("place")).agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.round(F.sum("value"), 4).alias("value"))


SQL["nested_event_documents"] = """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) - 1 AS pos FROM events)
SELECT event_type AS type, least(pos, 3)::INTEGER AS place, count(*) AS n, sum((props->>'$.k')::INT)::BIGINT AS k, round(sum(value), 4) AS value FROM p GROUP BY 1, 2"""


def referred_events(spark: SparkSession, d: str) -> DataFrame:
    """Events whose properties name another one, k places before: its type and the time between, looked up by key."""
    e = nested.parsed(table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "props"), "props")
    e = nested.picked(e, "doc", {"k": ("$.k", "int")}).withColumn("of", F.when(F.col("k") > 0, F.col("event_id") - F.col("k"))).drop("doc")
    out = nested.looked_up(e, "event_id", "of", ["event_type", "ts", "user_id"])
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("ref_ts").cast("timestamp"))) / 1e6
    return out.select("event_id", "of", "ref_event_type", F.round(gap, 3).alias("seconds"), (F.col("user_id") == F.col("ref_user_id")).alias("same_user"))


SQL["referred_events"] = """
WITH e AS (SELECT *, CASE WHEN (props->>'$.k')::INT > 0 THEN event_id - (props->>'$.k')::INT END AS o FROM events)
SELECT e.event_id, e.o AS "of", r.event_type AS ref_event_type, round((epoch_us(e.ts) - epoch_us(r.ts)) / 1e6, 3) AS seconds, e.user_id = r.user_id AS same_user FROM e LEFT JOIN events r ON r.event_id = e.o"""


def part_search_latest(spark: SparkSession, d: str) -> DataFrame:
    """The ten first parts, by name and key, that have a word beginning with 'gi', each with the supplier and day of its most recent line."""
    parts = table(spark, d, "part", "p_partkey", "p_name").where(F.lower("p_name").rlike("(^| )gi"))
    found = parts.orderBy("p_name", "p_partkey").limit(10)
    lines = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber")
    recent = lines.join(F.broadcast(found), F.col("l_partkey") == F.col("p_partkey"), "left_semi").groupBy("l_partkey").agg(F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")).alias("m"))  # ten parts
    names = table(spark, d, "supplier", "s_suppkey", "s_name")
    out = found.join(recent, F.col("l_partkey") == F.col("p_partkey"), "left").join(names, F.col("m.l_suppkey") == F.col("s_suppkey"), "left")
    return out.select("p_partkey", "p_name", F.col("s_name").alias("latest_supplier"), F.to_date("m.l_shipdate").alias("latest_day"))


SQL["part_search_latest"] = """
WITH f AS (SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), '(^| )gi') ORDER BY p_name, p_partkey LIMIT 10),
r AS (SELECT l_partkey, l_suppkey, l_shipdate, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS k FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM f))
SELECT p_partkey, p_name, s_name AS latest_supplier, l_shipdate::DATE AS latest_day FROM f LEFT JOIN r ON l_partkey = p_partkey AND k = 1 LEFT JOIN supplier ON s_suppkey = l_suppkey"""


def page_link_slugs(spark: SparkSession, d: str) -> DataFrame:
    """Links of each page: how many, the last part of the path of each different one, its trailing number, entities resolved; and the text of its title without tags."""
    html = F.coalesce("html", F.lit(""))
    hrefs = F.transform(F.regexp_extract_all(html, F.lit(r"""<a [^>]*href=["']([^"'>]*)["']"""), F.lit(1)), S.unescaped)
    slugs = F.transform(F.array_distinct(hrefs), lambda h: F.regexp_extract(h, r"([^/?#]*)/?(?:[?#].*)?$", 1))
    numbers = F.transform(slugs, lambda s: F.regexp_extract(s, r"([0-9]+)(?:\.[a-z]+)?$", 1))
    title = S.unescaped(F.regexp_replace(F.regexp_extract(html, r"<title>([^\x00]*?)</title>", 1), "<[^>]+>", ""))
    joined = lambda a: F.array_join(F.array_sort(a), "|")
    return table(spark, d, "pages", "page_id", "html").select("page_id", F.size(hrefs).alias("n_links"), joined(slugs).alias("slugs"), joined(F.filter(numbers, lambda n: n != "")).alias("numbers"), F.trim(title).alias("title"))


_UNESCAPED = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"
SQL["page_link_slugs"] = rf"""
WITH h AS (SELECT page_id, coalesce(html, '') AS html, list_transform(regexp_extract_all(coalesce(html, ''), '<a [^>]*href=["'']([^"''>]*)["'']', 1), lambda x: {_UNESCAPED.format("x")}) AS hrefs FROM pages),
s AS (SELECT *, list_transform(list_distinct(hrefs), lambda h: regexp_extract(h, '([^/?#]*)/?(?:[?#].*)?$', 1)) AS slugs FROM h),
n AS (SELECT *, list_filter(list_transform(slugs, lambda s: regexp_extract(s, '([0-9]+)(?:\.[a-z]+)?$', 1)), lambda x: x <> '') AS numbers FROM s)
SELECT page_id, len(hrefs)::INTEGER AS n_links, array_to_string(list_sort(slugs), '|') AS slugs, array_to_string(list_sort(numbers), '|') AS numbers,
  trim({_UNESCAPED.format(r"regexp_replace(regexp_extract(html, '<title>([^\x00]*?)</title>', 1), '<[^>]+>', '', 'g')")}) AS title FROM n"""


QUERIES = {f.__name__: f for f in (previous_of_status, price_spells_of_status, shipping_spans_of_status, peer_median_by_anchor, three_tier_name_matches, nested_event_documents, referred_events, part_search_latest, page_link_slugs)}
