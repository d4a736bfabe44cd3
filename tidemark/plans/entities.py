"""Queries on entities, sets and selections. Each stands with its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as S
from tidemark.operators import distribution as D
from tidemark.operators import entities as E
from tidemark.operators import relational as R
from tidemark.sources.scratch import shared_root
from tidemark.sources.tables import table

SQL: dict[str, str] = {}
QUERIES = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


@query()
def blocked_name_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each part's best matches by name among all other parts of its type and size that share a word."""
    parts = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_size")
    left = parts.select("p_type", "p_size", F.col("p_partkey").alias("left_key"), F.col("p_name").alias("left_name"))
    right = parts.select("p_type", "p_size", F.col("p_partkey").alias("right_key"), F.col("p_name").alias("right_name"))
    return E.blocked_matches(left, right, ["p_type", "p_size"], "left_key", "right_key", "left_name", "right_name", tokens=True, same=True)


@query("""
WITH a AS (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT s_nationkey, s_suppkey FROM supplier),
v AS (SELECT o_custkey, s_nationkey, count(DISTINCT l_suppkey) AS votes FROM a JOIN b ON s_suppkey = l_suppkey GROUP BY 1, 2), z AS (SELECT o_custkey, count(DISTINCT l_suppkey) AS size FROM a GROUP BY 1),
r AS (SELECT *, row_number() OVER w AS place, coalesce(lead(votes) OVER w, 0) AS second FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY votes DESC, s_nationkey))
SELECT o_custkey, s_nationkey, votes, votes - second AS lead, votes - second >= 2 AND votes >= 0.2 * size AS resolved FROM r JOIN z USING (o_custkey) WHERE place = 1""")
def member_vote_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The nation whose suppliers a customer's orders of 1996 share most."""
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").where(F.year("o_orderdate") == 1996)
    left = orders.join(table(spark, d, "lineitem", "l_orderkey", "l_suppkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", F.col("l_suppkey").alias("member")).distinct()
    right = table(spark, d, "supplier", "s_nationkey", "s_suppkey").select("s_nationkey", F.col("s_suppkey").alias("member"))
    return E.member_votes(left, right, "o_custkey", "s_nationkey", "member")


@query("""
WITH m AS (SELECT p_name AS k, min(p_brand) AS brand FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) = 1)
SELECT p_partkey, coalesce(CASE WHEN p_name = 'red widget' THEN 'Brand#override' END, m.brand) AS brand FROM part LEFT JOIN m ON m.k = p_name""")
def alias_map(spark: SparkSession, d: str) -> DataFrame:
    """Names mapped to a brand where it is the only one, with a literal override."""
    parts = table(spark, d, "part", "p_partkey", "p_name", "p_brand")
    return E.mapped(parts.select("p_partkey", "p_name"), parts.select("p_name", F.col("p_brand").alias("brand")), "p_name", "brand", {"red widget": "Brand#override"}).select("p_partkey", "brand")


@query("""
WITH r AS (SELECT DISTINCT o_custkey, year(o_orderdate)::INT AS y, o_orderpriority FROM orders)
SELECT o.o_orderkey, r.o_custkey IS NOT NULL AS seen_last_year FROM orders o LEFT JOIN r ON r.o_custkey = o.o_custkey AND r.y = year(o.o_orderdate) - 1 AND r.o_orderpriority = o.o_orderpriority""")
def tuple_membership(spark: SparkSession, d: str) -> DataFrame:
    """Whether a customer had an order of the same priority in the year before."""
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").withColumn("y", F.year("o_orderdate"))
    seen = orders.select("o_custkey", (F.col("y") + 1).alias("y"), "o_orderpriority").distinct()
    return R.flagged_join(orders, seen, ["o_custkey", "y", "o_orderpriority"], "seen_last_year").select("o_orderkey", "seen_last_year")


@query("""
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND abs(date_diff('day', o_orderdate::DATE, DATE '1998-06-30')) <= 40) AS active FROM customer""")
def proximity_exists(spark: SparkSession, d: str) -> DataFrame:
    """Customers with an order within 40 days of a date."""
    near = table(spark, d, "orders", "o_custkey", "o_orderdate").where(F.abs(F.datediff("o_orderdate", F.lit("1998-06-30").cast("date"))) <= 40).select(F.col("o_custkey").alias("c_custkey")).distinct()
    return R.flagged_join(table(spark, d, "customer", "c_custkey"), near, ["c_custkey"], "active")


@query("""
WITH u AS (SELECT l_orderkey, 'part' AS side, l_partkey AS k FROM lineitem UNION SELECT l_orderkey, 'supplier', l_suppkey FROM lineitem) SELECT side, k, count(*) AS n_orders FROM u GROUP BY 1, 2""")
def role_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each part and of each supplier, from one pass over both roles of a line."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    return lines.withColumnsRenamed({"l_partkey": "part", "l_suppkey": "supplier"}).unpivot("l_orderkey", ["part", "supplier"], "side", "k").distinct().groupBy("side", "k").agg(F.count("*").alias("n_orders"))


@query("""
SELECT a.conv_id, a.turn, a.role, length(b.text)::BIGINT AS previous_chars, b.role AS previous_role FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1""")
def reply_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with length and role of the turn that it answers."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("chars"), (F.col("turn") - 1).alias("answers"))
    return E.self_lookup(turns, "conv_id", "answers", "turn", {"chars": "previous_chars", "role": "previous_role"}).select("conv_id", "turn", "role", "previous_chars", "previous_role")


@query("""
WITH y AS (SELECT o_custkey, year(o_orderdate)::INT AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), p AS (SELECT a.o_custkey, a.y, a.v AS actual, b.v AS baseline, (b.v + c.v) / 2 AS candidate FROM y a JOIN y b ON b.o_custkey = a.o_custkey AND b.y = a.y - 1 JOIN y c ON c.o_custkey = a.o_custkey AND c.y = a.y - 2)
SELECT y, count(*) AS n, round(avg(abs(actual - baseline)), 2) AS baseline_mae, round(avg(abs(actual - candidate)), 2) AS candidate_mae FROM p GROUP BY 1""")
def paired_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Errors of two predictions on the rows that both have."""
    y = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("actual"))
    shared_root(spark)
    y = y.checkpoint()  # summed once: sums of doubles in another order differ in their last bits, and both sides must agree on the actual value
    back = lambda k: y.select("o_custkey", (F.col("y") + k).alias("y"), F.col("actual").alias(f"v{k}"))
    one = y.join(back(1), ["o_custkey", "y"]).select("o_custkey", "y", "actual", F.col("v1").alias("p"))
    two = y.join(back(1), ["o_custkey", "y"]).join(back(2), ["o_custkey", "y"]).select("o_custkey", "y", "actual", ((F.col("v1") + F.col("v2")) / 2).alias("p"))
    mae = lambda c: F.round(F.avg(F.abs(F.col("actual") - F.col(c))), 2).alias(f"{c}_mae")
    return E.paired(two, one, ["o_custkey", "y"], "actual", "p").groupBy("y").agg(F.count("*").alias("n"), mae("baseline"), mae("candidate"))


@query("""
SELECT doc_id, (quality IS NULL)::INT AS is_stub FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels) k LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)""")
def stub_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every document of either table, and whether it is a stub without a label."""
    labels = table(spark, d, "labels", "doc_id", "quality").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    stubs = table(spark, d, "documents", "doc_id").distinct().join(labels, "doc_id", "left_anti")
    return labels.select("doc_id", F.col("quality").isNull().cast("int").alias("is_stub")).unionByName(stubs.withColumn("is_stub", F.lit(1)))


@query("SELECT count(*) AS n_both FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R') q")
def set_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Part and supplier pairs that two sources share."""
    lines = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_returnflag")
    of = lambda k: lines.where(F.col("l_returnflag") == k).select("l_partkey", "l_suppkey")
    return of("A").intersect(of("R")).agg(F.count("*").alias("n_both"))


@query("""
WITH a AS (SELECT l_partkey, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_partkey, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT count(*) FILTER (a.q IS NOT NULL AND b.q IS NOT NULL) AS n_shared, count(*) FILTER (b.q IS NULL) AS n_left_only, count(*) FILTER (a.q IS NULL) AS n_right_only, count(*) FILTER (a.q = b.q) AS n_equal, count(*) FILTER (a.q <> b.q) AS n_differing FROM a FULL JOIN b USING (l_partkey)""")
def key_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Keys that two sources share, have alone, agree on and don't."""
    lines = table(spark, d, "lineitem", "l_partkey", "l_linestatus", "l_quantity")
    of = lambda k, name: lines.where(F.col("l_linestatus") == k).groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias(name))
    a, b = F.col("a"), F.col("b")
    return of("F", "a").join(of("O", "b"), "l_partkey", "full").agg(F.count_if(a.isNotNull() & b.isNotNull()).alias("n_shared"), F.count_if(b.isNull()).alias("n_left_only"), F.count_if(a.isNull()).alias("n_right_only"), F.count_if(a == b).alias("n_equal"), F.count_if(a != b).alias("n_differing"))


@query("""
SELECT c_custkey, round((SELECT count(*) FROM customer r WHERE r.c_mktsegment = c.c_mktsegment AND r.c_acctbal <= c.c_acctbal) / count(*) OVER (PARTITION BY c_mktsegment), 6) AS at_or_below,
  round((rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1 + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1 + 2) / 2) / (count(*) OVER (PARTITION BY c_mktsegment) - 1 + 1), 6) AS mid_rank FROM customer c""")
def ecdf_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Share of the segment at or below each balance, and the mid-rank of the balance among the others."""
    below, equal, n = F.col("__below"), F.col("__same"), F.col("__all")
    c = D.ranked(table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal"), "c_acctbal", ["c_mktsegment"])
    return c.select("c_custkey", F.round((below + equal) / n, 6).alias("at_or_below"), F.round((below + (equal - 1 + 2) / 2) / n, 6).alias("mid_rank"))


@query("""
WITH c AS (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS mean_value, max(o_orderdate::DATE) AS latest FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN n >= 10 THEN round(mean_value, 4) END AS mean_value, CASE WHEN n >= 10 THEN latest END AS latest, n >= 10 AS available FROM c""")
def availability_mask(spark: SparkSession, d: str) -> DataFrame:
    """Features of customers, null as a block where there are fewer than ten orders."""
    c = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_value"), F.max(F.to_date("o_orderdate")).alias("latest"))
    return E.masked(c, ["mean_value", "latest"], F.col("n") >= 10).select("o_custkey", "mean_value", "latest", (F.col("n") >= 10).alias("available"))


@query("""
SELECT o_custkey, min(o_totalprice) FILTER (year(o_orderdate) = 1997) AS least, max(o_totalprice) FILTER (year(o_orderdate) = 1997) AS greatest, arg_min(o_totalprice, (o_orderdate, o_orderkey)) FILTER (year(o_orderdate) = 1997) AS first_value, arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (year(o_orderdate) = 1997) AS last_value,
  date_diff('day', min(o_orderdate) FILTER (year(o_orderdate) = 1997), max(o_orderdate) FILTER (year(o_orderdate) = 1997)) AS span_days FROM orders GROUP BY 1""")
def bounded_summary(spark: SparkSession, d: str) -> DataFrame:
    """First, last, least and greatest value of each customer within one year, and the days between."""
    inside = F.year("o_orderdate") == 1997
    value, order, day = F.when(inside, F.col("o_totalprice")), F.when(inside, F.struct("o_orderdate", "o_orderkey")), F.when(inside, F.to_date("o_orderdate"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min(value).alias("least"), F.max(value).alias("greatest"), F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"), F.datediff(F.max(day), F.min(day)).cast("bigint").alias("span_days"))


@query("""
SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS earlier_same FROM events""")
def cumulative_count(spark: SparkSession, d: str) -> DataFrame:
    """How many earlier events of the same type each event's user had."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, d, "events", "event_id", "user_id", "event_type", "ts").select("event_id", (F.row_number().over(w).cast("bigint") - 1).alias("earlier_same"))


@query("""
SELECT p_partkey, CASE WHEN contains(lower(p_type), 'small') THEN 'small' WHEN starts_with(lower(p_type), 'eco') THEN 'economy' WHEN regexp_matches(lower(p_type), 'large|med') THEN 'larger' ELSE 'other' END AS kind,
  CASE WHEN p_size % 3 = 0 THEN p_size * 0.5 WHEN p_size % 3 = 1 THEN p_size * 0.3 + 1 END AS role_index FROM part""")
def text_classes(spark: SparkSession, d: str) -> DataFrame:
    """Parts classed by their type's text, with an index whose weights depend on a role and which is null without one."""
    kind = F.lower("p_type")
    cls = F.when(kind.contains("small"), "small").when(kind.startswith("eco"), "economy").when(kind.rlike("large|med"), "larger").otherwise("other")
    index = F.when(F.col("p_size") % 3 == 0, F.col("p_size") * 0.5).when(F.col("p_size") % 3 == 1, F.col("p_size") * 0.3 + 1)
    return table(spark, d, "part", "p_partkey", "p_type", "p_size").select("p_partkey", cls.alias("kind"), index.alias("role_index"))


@query()
def greedy_portfolio(spark: SparkSession, d: str) -> DataFrame:
    """Up to four orders of each priority by value: no customer twice, first one of each status."""
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    return E.greedy_picks(orders, "o_orderpriority", "o_custkey", "o_orderstatus", "o_totalprice", 4)


@query("""
SELECT * FROM (SELECT o_orderkey, concat_ws('|', CASE WHEN NOT (o_totalprice > 1000) THEN 'value' END, CASE WHEN NOT (o_orderstatus IN ('F', 'O')) THEN 'status' END, CASE WHEN NOT (o_orderdate >= TIMESTAMP '1995-02-01') THEN 'date' END) AS failed FROM orders) q WHERE failed <> ''""")
def envelope_checks(spark: SparkSession, d: str) -> DataFrame:
    """Orders that break any of a list of constraints, with their names."""
    orders = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    checks = {"value": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus").isin("F", "O"), "date": F.col("o_orderdate") >= F.lit("1995-02-01").cast("timestamp_ntz")}
    return E.violations(orders, "o_orderkey", checks).select("o_orderkey", F.array_join("failed", "|").alias("failed"))


@query("""
WITH b AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) SELECT n_name, coalesce(n, 0) AS n_customers, round((coalesce(n, 0) + 1) / (SELECT sum(n) + 3 FROM b), 6) AS smoothed, CASE WHEN coalesce(n, 0) = (CASE WHEN n_regionkey = 2 THEN 60 ELSE 55 END) THEN 'complete' ELSE 'other' END AS expected FROM nation LEFT JOIN b ON k = n_nationkey""")
def expected_counts(spark: SparkSession, d: str) -> DataFrame:
    """Customers of each nation, a smoothed share and whether the count is the one expected."""
    per = table(spark, d, "customer", "c_nationkey").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    out = table(spark, d, "nation").join(per, F.col("c_nationkey") == F.col("n_nationkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = per.agg(F.sum("n").alias("all"))
    expected = F.when(F.col("n_regionkey") == 2, 60).otherwise(55)
    return out.crossJoin(F.broadcast(total)).select("n_name", F.col("n").alias("n_customers"), F.round(S.smoothed(F.col("n"), F.col("all"), 3), 6).alias("smoothed"), F.when(F.col("n") == expected, "complete").otherwise("other").alias("expected"))  # one row
