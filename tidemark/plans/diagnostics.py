"""Queries on counters, tiered matching, drift, and the stability of features and models, with their SQL."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import entities as E
from tidemark.operators import models as M
from tidemark.operators import temporal as T
from tidemark.plans import summaries
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


def r6(c):  # noqa: ANN001, ANN201
    return F.round(c, 6)


#: Each kind of event, and the conditions under which it is counted: as a column, and in SQL.
KINDS = ("view", "click", "purchase", "signup", "error")
FLAGS = {
    "n": (lambda: F.lit(True), "true"),
    "low": (lambda: F.col("value") < 10, "value < 10"),
    "high": (lambda: F.col("value") >= 50, "value >= 50"),
    "very_high": (lambda: F.col("value") >= 100, "value >= 100"),
    "morning": (lambda: F.hour("ts") < 12, "hour(ts) < 12"),
    "evening": (lambda: F.hour("ts") >= 18, "hour(ts) >= 18"),
    "weekend": (lambda: F.dayofweek("ts").isin(1, 7), "isodow(ts) IN (6, 7)"),
    "large_key": (lambda: F.get_json_object("props", "$.k").cast("int") >= 50, "(props::JSON ->> 'k')::INT >= 50"),
}


@query(
    "WITH u AS (SELECT user_id, count(DISTINCT ts::DATE) AS n_days, count(*) AS n_events, "
    + ", ".join(f"count(*) FILTER (event_type = '{k}' AND {sql}) AS {k}_{name}" for k in KINDS for name, (_, sql) in FLAGS.items())
    + ", "
    + ", ".join(f"round(coalesce(sum(value) FILTER (event_type = '{k}'), 0), 4) AS {k}_value" for k in KINDS)
    + " FROM events GROUP BY 1) SELECT u.*, round(n_days / (SELECT count(DISTINCT ts::DATE) FROM events), 6) AS share_of_days, round(purchase_n / nullif(view_n, 0), 6) AS purchases_a_view FROM u"
)
def event_rates(spark: SparkSession, d: str) -> DataFrame:
    """45 conditional counters of each user, the days with any event and their share of all days, and a rate.

    Days are summed first, so that the distinct days of a user are the rows of the second sum.
    """
    e = table(spark, d, "events", "user_id", "ts", "event_type", "value", "props").withColumn("day", F.to_date("ts"))
    counted = {f"{k}_{name}": F.count_if((F.col("event_type") == k) & c()) for k in KINDS for name, (c, _) in FLAGS.items()}
    summed = {f"{k}_value": F.sum(F.when(F.col("event_type") == k, F.col("value")).otherwise(0.0)) for k in KINDS}
    daily = e.groupBy("user_id", "day").agg(F.count("*").alias("n_events"), *[c.alias(n) for n, c in (counted | summed).items()])
    per = daily.groupBy("user_id").agg(F.count("day").alias("n_days"), F.sum("n_events").alias("n_events"), *[F.sum(n).alias(n) for n in counted], *[F.round(F.sum(n), 4).alias(n) for n in summed])
    days = e.agg(F.count_distinct("day").alias("__days"))
    wide = per.crossJoin(F.broadcast(days))  # one row
    return wide.withColumns({"share_of_days": r6(F.col("n_days") / F.col("__days")), "purchases_a_view": r6(S.safe_divide(F.col("purchase_n"), F.col("view_n")))}).drop("__days")


@query("""
WITH w AS (SELECT p_partkey, p_type, p_size, CASE WHEN p_partkey % 5 = 1 THEN p_name || 'ish' WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) ELSE upper(p_name) END AS nm FROM part),
l AS (SELECT *, regexp_replace(lower(nm), '[^a-z0-9]', '', 'g') AS k, array_to_string(list_sort(regexp_extract_all(lower(nm), '[a-z0-9]+')), '|') AS t FROM w),
r AS (SELECT p_partkey AS id, p_type, p_size, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k, array_to_string(list_sort(regexp_extract_all(lower(p_name), '[a-z0-9]+')), '|') AS t FROM part),
c AS (SELECT l.p_partkey, r.id, 1 AS tier FROM l JOIN r USING (p_type, p_size, k) UNION ALL SELECT l.p_partkey, r.id, 2 FROM l JOIN r USING (p_type, p_size, t)),
f AS (SELECT * FROM c QUALIFY tier = min(tier) OVER (PARTITION BY p_partkey)), g AS (SELECT p_partkey, tier, count(*) AS n, min(id) AS id FROM f GROUP BY 1, 2),
v AS (SELECT f.p_partkey, f.id, count(DISTINCT a.l_suppkey) AS votes FROM f JOIN lineitem a ON a.l_partkey = f.p_partkey AND a.l_returnflag = 'R' JOIN lineitem b ON b.l_partkey = f.id AND b.l_returnflag <> 'R' AND b.l_suppkey = a.l_suppkey GROUP BY 1, 2),
m AS (SELECT p_partkey, id FROM v QUALIFY votes = max(votes) OVER (PARTITION BY p_partkey) AND count(*) OVER (PARTITION BY p_partkey, votes) = 1)
SELECT l.p_partkey, coalesce(n, 0) AS n_candidates, CASE WHEN n = 1 THEN g.id ELSE m.id END AS match_key, CASE tier WHEN 1 THEN 'exact' WHEN 2 THEN 'words' END AS tier, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'accepted' WHEN m.id IS NOT NULL THEN 'resolved' ELSE 'ambiguous' END AS status
FROM l LEFT JOIN g USING (p_partkey) LEFT JOIN m ON m.p_partkey = l.p_partkey""")
def tiered_name_matches(spark: SparkSession, d: str) -> DataFrame:
    """Parts written in another way, matched within their type and size by name, then by sorted words, with shared suppliers to break ties."""
    parts, k = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_size"), F.col("p_partkey")
    words = F.split("p_name", " ")
    other = F.when(k % 5 == 1, F.concat("p_name", F.lit("ish"))).when(k % 3 == 0, F.concat_ws(" ", F.get(words, F.lit(1)), words[0])).otherwise(F.upper("p_name"))
    named = lambda c: (S.name_key(c).alias("name"), S.token_signature(c).alias("words"))
    left = parts.select("p_partkey", "p_type", "p_size", *named(other))
    right = parts.select(k.alias("match_key"), "p_type", "p_size", *named(F.col("p_name")))
    lines = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_returnflag")
    mine = lines.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").distinct()
    theirs = lines.where("l_returnflag <> 'R'").select(F.col("l_partkey").alias("match_key"), "l_suppkey").distinct()
    return E.tiered_matches(left, right, ["p_type", "p_size"], "p_partkey", "match_key", [("exact", "name", "name"), ("words", "words", "words")], mine, theirs, "l_suppkey")


@query("""
WITH a AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id, ts, max(event_id) AS id FROM events WHERE event_type = 'view' GROUP BY 1, 2), g AS (SELECT f.user_id, f.ts, f.id, e.value FROM f JOIN events e ON e.event_id = f.id)
SELECT a.event_id, CASE WHEN epoch_us(a.ts) - epoch_us(g.ts) <= 43200000000 THEN g.id END AS view_id, CASE WHEN epoch_us(a.ts) - epoch_us(g.ts) <= 43200000000 THEN round(g.value, 6) END AS view_value FROM a ASOF LEFT JOIN g ON a.user_id = g.user_id AND a.ts >= g.ts""")
def asof_max_age(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with its user's latest view up to then, unless that is more than 12 hours old."""
    e = table(spark, d, "events", "event_id", "user_id", "ts", "value", "event_type")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    found = T.asof_join(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "user_id", "ts", "view_ts", ["view_id", "view_value"], order=["view_id"])
    return T.no_older(found, "ts", "view_ts", ["view_id", "view_value"], 12 * 3600).select("event_id", "view_id", r6("view_value").alias("view_value"))


@query("WITH psi AS (" + summaries.SQL["psi_deciles"] + """),
n AS (SELECT year(o_orderdate)::INT AS year, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT year, k, n / sum(n) OVER (PARTITION BY year) AS p FROM n),
g AS (SELECT y.year, b.k, b.p AS q FROM (SELECT DISTINCT year FROM p) y, (SELECT k, p FROM p WHERE year = 1995) b),
t AS (SELECT coalesce(g.year, p.year) AS year, round(0.5 * sum(abs(coalesce(p, 0) - coalesce(q, 0))), 6) AS distance FROM g FULL JOIN p ON p.year = g.year AND p.k = g.k GROUP BY 1)
SELECT year, psi, distance, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'strong' END AS value_drift, CASE WHEN distance < 0.1 THEN 'stable' WHEN distance < 0.25 THEN 'moderate' ELSE 'strong' END AS priority_drift FROM psi JOIN t USING (year)""")
def drift_table(spark: SparkSession, d: str) -> DataFrame:
    """How far each year is from 1995: stability index of order values, total variation of priorities, and their bands."""
    counts = table(spark, d, "orders", "o_orderdate", "o_orderpriority").groupBy(F.year("o_orderdate").alias("year"), "o_orderpriority").agg(F.count("*").alias("n"))
    shares = counts.join(counts.groupBy("year").agg(F.sum("n").alias("all")), "year").select("year", "o_orderpriority", (F.col("n") / F.col("all")).alias("p"))
    base = shares.where("year = 1995").select("o_orderpriority", F.col("p").alias("q"))
    q = F.coalesce("q", F.lit(0.0))
    apart = shares.join(base, "o_orderpriority", "left").groupBy("year").agg(r6((F.sum(F.abs(F.col("p") - q)) + 1 - F.sum(q)) / 2).alias("distance"))  # 1 - sum(q): levels that the year lacks
    band = lambda c: F.when(F.col(c) < 0.1, "stable").when(F.col(c) < 0.25, "moderate").otherwise("strong")
    return summaries.psi_deciles(spark, d).join(apart, "year").select("year", "psi", "distance", band("psi").alias("value_drift"), band("distance").alias("priority_drift"))


_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS feature, '{b}' AS other, round(corr({a}, {b}), 6) AS r, coalesce(abs(corr({a}, {b})) >= 0.8, false) AS collinear FROM lineitem" for i, a in enumerate(_FEATURES) for b in _FEATURES[:i]))
def feature_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of features, and whether they tell nearly the same."""
    rows = table(spark, d, "lineitem", *_FEATURES).select(array_to_vector(F.array(*_FEATURES)).alias("features"))
    name = lambda c: F.element_at(F.array(*[F.lit(f) for f in _FEATURES]), F.col(c) + 1)
    return M.correlations(rows).select(name("i").alias("feature"), name("j").alias("other"), r6("r").alias("r"), F.coalesce(F.abs("r") >= 0.8, F.lit(False)).alias("collinear"))


_ORIGINS = """WITH m AS (SELECT year(l_shipdate)::INT AS origin, count(*) * var_pop(l_quantity) + 10 AS a, count(*) * covar_pop(l_quantity, 100 * l_discount) AS b, count(*) * var_pop(100 * l_discount) + 10 AS c, count(*) * covar_pop(l_quantity, l_extendedprice / 1000) AS u, count(*) * covar_pop(100 * l_discount, l_extendedprice / 1000) AS v FROM lineitem GROUP BY 1),
s AS (SELECT origin, 'quantity' AS feature, (c * u - b * v) / (a * c - b * b) AS coefficient FROM m UNION ALL SELECT origin, 'discount', (a * v - b * u) / (a * c - b * b) FROM m)
"""


def _by_origin(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem", "l_shipdate", "l_quantity", "l_discount", "l_extendedprice")
    rows = lines.select(F.year("l_shipdate").alias("origin"), F.col("l_quantity").alias("quantity"), (100 * F.col("l_discount")).alias("discount"), (F.col("l_extendedprice") / 1000).alias("y"))
    return M.grouped_ridge(rows, "origin", ["quantity", "discount"], "y", 10.0)


@query(_ORIGINS + "SELECT origin, feature, round(coefficient, 5) AS coefficient FROM s")
def ridge_by_origin(spark: SparkSession, d: str) -> DataFrame:
    """Ridge coefficients of the price on quantity and discount for each year, from one aggregation."""
    return _by_origin(spark, d).select("origin", "feature", F.round("coefficient", 5).alias("coefficient"))


@query(_ORIGINS + "SELECT feature, count(*) AS n_origins, round(avg(coefficient), 5) AS mean, round(min(coefficient), 5) AS least, round(max(coefficient), 5) AS greatest, round(greatest(avg((coefficient > 0)::INT), 1 - avg((coefficient > 0)::INT)), 5) AS same_sign FROM s GROUP BY 1")
def coefficient_stability(spark: SparkSession, d: str) -> DataFrame:
    """How far each coefficient varies over the years, and how often it keeps its sign."""
    return M.coefficient_stability(_by_origin(spark, d)).select("feature", "n_origins", *[F.round(c, 5).alias(c) for c in ("mean", "least", "greatest", "same_sign")])


@query("""
WITH g AS (SELECT o_orderkey, v, 1 / (1 + exp(-(o_custkey % 7 - 2) * v)) AS p FROM orders, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS v) k),
s AS (SELECT o_orderkey, p - lag(p) OVER (PARTITION BY o_orderkey ORDER BY v) AS step FROM g), b AS (SELECT o_orderkey, coalesce(max((step < -1e-12)::INT), 0) AS bad FROM s GROUP BY 1) SELECT count(*) AS n_rows, sum(bad)::BIGINT AS n_violations FROM b""")
def monotone_stress(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose score falls anywhere as their share is raised."""
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey")
    score = lambda df: df.withColumn("p", S.sigmoid((F.col("o_custkey") % 7 - 2) * F.col("share")))
    return M.monotone_violations(orders, ["o_orderkey"], "share", [0.0, 0.25, 0.5, 0.75, 1.0], score)


@query("""
WITH z AS (SELECT a.vec_id, list_filter(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: abs(z[1]) >= 0.02 AND abs(z[2]) >= 0.02) AS z FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_sum(list_transform(z, lambda x: x[1] * x[2])) / sqrt(list_sum(list_transform(z, lambda x: x[1] * x[1])) * list_sum(list_transform(z, lambda x: x[2] * x[2]))), 5) AS cosine, round(list_sum(list_transform(z, lambda x: abs(x[1] - x[2]))) / len(z), 5) AS gap FROM z""")
def masked_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each vector and the next one over the places where both are told."""
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    told = e.select("vec_id", F.transform("embedding", lambda x: F.when(F.abs(x.cast("double")) >= 0.02, x.cast("double"))).alias("a"))
    both = told.join(told.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return both.select("vec_id", F.round(S.masked_cosine(F.col("a"), F.col("b")), 5).alias("cosine"), F.round(S.masked_gap(F.col("a"), F.col("b")), 5).alias("gap"))
