"""Queries on keys, sources, distributions, text and metrics. Each stands with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as S
from tidemark.operators import distribution as D
from tidemark.operators import relational as R
from tidemark.sources.tables import semi_filter, table, to_json_rows

SQL: dict[str, str] = {}
QUERIES = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# --- joins and keys


@query("""
SELECT c_custkey, CASE WHEN count(c_acctbal) OVER w > 1 THEN round((sum(c_acctbal) OVER w - c_acctbal) / (count(c_acctbal) OVER w - 1), 6) END AS rest_mean, count(*) OVER w AS n_nation FROM customer WINDOW w AS (PARTITION BY c_nationkey)""")
def leave_one_out_nation(spark: SparkSession, d: str) -> DataFrame:
    """Mean balance of the other customers of the nation."""
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    return R.rest_means(c, "c_nationkey", "c_acctbal", "m").select("c_custkey", r6("m").alias("rest_mean"), F.col("__rows").alias("n_nation"))


@query("""
WITH late AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) = 2000), early AS (SELECT DISTINCT o_custkey FROM orders WHERE year(o_orderdate) <= 1997)
SELECT c_custkey, CASE WHEN l.o_custkey IS NOT NULL THEN 'evaluation' WHEN e.o_custkey IS NOT NULL THEN 'train' ELSE 'none' END AS split FROM customer LEFT JOIN late l ON l.o_custkey = c_custkey LEFT JOIN early e ON e.o_custkey = c_custkey""")
def semi_anti_split(spark: SparkSession, d: str) -> DataFrame:
    """A chronological split without shared customers: those of the late year evaluate, early ones that aren't among them train."""
    orders = table(spark, d, "orders", "o_custkey", "o_orderdate")
    late = orders.where(F.year("o_orderdate") == 2000).select(F.col("o_custkey").alias("c_custkey")).distinct()
    early = orders.where(F.year("o_orderdate") <= 1997).select(F.col("o_custkey").alias("c_custkey")).distinct().join(late, "c_custkey", "left_anti")
    c = table(spark, d, "customer", "c_custkey")
    train = c.join(early, "c_custkey", "left_semi").select("c_custkey", F.lit("train").alias("split"))
    held = c.join(late, "c_custkey", "left_semi").select("c_custkey", F.lit("evaluation").alias("split"))
    rest = c.join(early.unionByName(late), "c_custkey", "left_anti").select("c_custkey", F.lit("none").alias("split"))
    return train.unionByName(held).unionByName(rest)


@query("""
WITH a AS (SELECT DISTINCT c_nationkey AS nationkey, year(o_orderdate)::INT AS year FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000),
b AS (SELECT DISTINCT s_nationkey AS nationkey, year(l_shipdate)::INT AS year FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 49)
SELECT coalesce(a.nationkey, b.nationkey) AS nationkey, coalesce(a.year, b.year) AS year, CASE WHEN a.year IS NULL THEN 'right_only' WHEN b.year IS NULL THEN 'left_only' ELSE 'both' END AS coverage FROM a FULL JOIN b ON a.nationkey = b.nationkey AND a.year = b.year""")
def outer_coverage_indicator(spark: SparkSession, d: str) -> DataFrame:
    """Nation-years with large urgent orders against those with large shipments."""
    orders = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice").where("o_orderpriority = '1-URGENT' and o_totalprice > 400000")
    left = orders.join(table(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("nationkey"), F.year("o_orderdate").alias("year")).distinct()
    lines = table(spark, d, "lineitem", "l_suppkey", "l_shipdate", "l_quantity").where("l_quantity >= 49")
    right = lines.join(table(spark, d, "supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("nationkey"), F.year("l_shipdate").alias("year")).distinct()
    return R.coverage_join(left, right, ["nationkey", "year"])


@query("""
SELECT r_name, count(c_custkey) AS n_customers, round(count(c_custkey) / (SELECT count(*) FROM customer), 6) AS share FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""")
def cross_constants(spark: SparkSession, d: str) -> DataFrame:
    """Each region with its customers and their share of a one-row total."""
    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    per = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"), "left").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("r_name").agg(F.count("c_custkey").alias("n_customers"))
    return per.crossJoin(F.broadcast(c.agg(F.count("*").alias("total")))).select("r_name", "n_customers", r6(F.col("n_customers") / F.col("total")).alias("share"))  # one row


_SOURCES = "WITH s AS (SELECT l_partkey, avg(l_extendedprice / l_quantity) FILTER (l_returnflag = 'A') AS a, avg(l_extendedprice / l_quantity) FILTER (l_returnflag = 'R') AS r, avg(l_extendedprice / l_quantity) FILTER (l_returnflag = 'N') AS n FROM lineitem GROUP BY 1)"


def _part_sources(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem", "l_partkey", "l_returnflag", "l_extendedprice", "l_quantity")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return lines.groupBy("l_partkey").agg(*[F.avg(F.when(F.col("l_returnflag") == k, price)).alias(k.lower()) for k in "ARN"])


@query(_SOURCES + """
SELECT l_partkey, round(coalesce(a, r, n), 2) AS price, CASE WHEN a IS NOT NULL THEN 'A' WHEN r IS NOT NULL THEN 'R' WHEN n IS NOT NULL THEN 'N' END AS source,
  CASE (a IS NOT NULL)::INT + (r IS NOT NULL)::INT + (n IS NOT NULL)::INT WHEN 0 THEN 'missing' WHEN 1 THEN 'single' ELSE CASE WHEN round(greatest(a, r, n), 0) = round(least(a, r, n), 0) THEN 'agree' ELSE 'differ' END END AS status FROM s""")
def priority_coalesce_agreement(spark: SparkSession, d: str) -> DataFrame:
    """A part's price from the first of three sources that has one, and whether they agree to the unit."""
    out = _part_sources(spark, d)
    value, source = R.prioritised((F.col("a"), "A"), (F.col("r"), "R"), (F.col("n"), "N"))
    return out.select("l_partkey", F.round(value, 2).alias("price"), source.alias("source"), R.agreement(*[F.round(k, 0) for k in "arn"]).alias("status"))


@query("""
WITH k AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), f AS (SELECT l_orderkey, l_partkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS no, count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS nf FROM lineitem GROUP BY 1, 2)
SELECT k.l_orderkey, k.l_partkey, a AS n_a, r AS n_r, no AS n_no, nf AS n_nf FROM k JOIN f USING (l_orderkey, l_partkey)""")
def key_spine_four_sources(spark: SparkSession, d: str) -> DataFrame:
    """Keys of four sources, with the rows of each source for every one of them."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    keys = ["l_orderkey", "l_partkey"]
    rules = {"n_a": "l_returnflag = 'A'", "n_r": "l_returnflag = 'R'", "n_no": "l_returnflag = 'N' and l_linestatus = 'O'", "n_nf": "l_returnflag = 'N' and l_linestatus = 'F'"}
    return R.spine_counts({name: lines.where(rule) for name, rule in rules.items()}, keys)


@query("""
SELECT o_custkey, day, o_orderkey, n > 1 AS conflict FROM (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS day, o_orderkey, count(*) OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m')) AS n,
  row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m') ORDER BY (o_orderstatus = 'F')::INT * 2 + (o_totalprice > 100000)::INT DESC, o_totalprice DESC, o_orderkey) AS rn FROM orders) q WHERE rn = 1""")
def dedupe_selection_score(spark: SparkSession, d: str) -> DataFrame:
    """One order for each customer and month, by a score, and whether there were several."""
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice").withColumn("day", F.date_format("o_orderdate", "yyyy-MM"))
    score = (F.col("o_orderstatus") == "F").cast("int") * 2 + (F.col("o_totalprice") > 100000).cast("int")
    marked = orders.withColumn("conflict", F.count("*").over(Window.partitionBy("o_custkey", "day")) > 1)
    return R.top_per_key(marked, ["o_custkey", "day"], [score.desc(), F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "day", "o_orderkey", "conflict")


@query("SELECT sha256(text) AS text_key, count(*) AS n_copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Texts that stand more than once."""
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("text_key")).agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("first_id")).where("n_copies > 1")


@query("""
SELECT l_partkey, CASE WHEN count(DISTINCT l_tax) = 1 THEN min(l_tax) END AS tax, count(DISTINCT l_tax) > 1 AS conflict, count(DISTINCT l_suppkey) > 1 AS several_suppliers FROM lineitem GROUP BY 1""")
def consensus_resolution(spark: SparkSession, d: str) -> DataFrame:
    """A part's tax if all its lines agree, else null and a conflict."""
    value, several = R.consensus("l_tax")
    return table(spark, d, "lineitem", "l_partkey", "l_tax", "l_suppkey").groupBy("l_partkey").agg(value.alias("tax"), several.alias("conflict"), (F.count_distinct("l_suppkey") > 1).alias("several_suppliers"))


@query("""
SELECT 'lineitem_part' AS reference, count(*) AS n_rows, count(*) FILTER (l_partkey IS NULL) AS n_null, count(*) FILTER (p_partkey IS NOT NULL) AS n_matched, count(*) FILTER (l_partkey IS NOT NULL AND p_partkey IS NULL) AS n_unmatched, count(DISTINCT l_partkey) FILTER (p_partkey IS NULL) AS n_missing_keys FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'document_label', count(*), count(*) FILTER (d.doc_id IS NULL), count(*) FILTER (l.doc_id IS NOT NULL), count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NULL), count(DISTINCT d.doc_id) FILTER (l.doc_id IS NULL) FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""")
def referential_profile(spark: SparkSession, d: str) -> DataFrame:
    """How well references are kept between tables."""
    a = R.referential_profile(table(spark, d, "lineitem", "l_partkey"), table(spark, d, "part", "p_partkey"), "l_partkey", "p_partkey").withColumn("reference", F.lit("lineitem_part"))
    b = R.referential_profile(table(spark, d, "documents", "doc_id"), table(spark, d, "labels", "doc_id"), "doc_id", "doc_id").withColumn("reference", F.lit("document_label"))
    return a.unionByName(b)


@query("""
SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) OR o_orderkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def id_semi_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows of which either of two id columns is among a set of ids."""
    ids = table(spark, d, "customer", "c_custkey", "c_acctbal").where("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    return semi_filter(table(spark, d, "orders", "o_orderkey", "o_custkey"), ids, ["o_custkey", "o_orderkey"]).select("o_orderkey")


@query("""
WITH m AS (SELECT 'quality' AS mask, doc_id FROM labels WHERE quality = 1 UNION SELECT 'toxic', doc_id FROM labels WHERE toxic = 1 UNION SELECT 'long', doc_id FROM documents WHERE n_chars > 2000 UNION SELECT 'english', doc_id FROM documents WHERE lang = 'en'),
s AS (SELECT mask, count(*) AS n FROM m GROUP BY 1), j AS (SELECT a.mask AS mask_a, b.mask AS mask_b, count(*) AS n_both FROM m a JOIN m b USING (doc_id) GROUP BY 1, 2)
SELECT mask_a, mask_b, n_both, x.n + y.n - n_both AS n_either, round(n_both / (x.n + y.n - n_both), 6) AS jaccard FROM j JOIN s x ON x.mask = mask_a JOIN s y ON y.mask = mask_b""")
def overlap_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Intersections and unions of four masks over documents; a fixed number of masks, counted in one pass over the ids."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("quality"), (F.max("toxic") == 1).alias("toxic"))
    docs = table(spark, d, "documents", "doc_id", "n_chars", "lang").groupBy("doc_id").agg((F.max("n_chars") > 2000).alias("long"), (F.count_if(F.col("lang") == "en") > 0).alias("english"))
    names = ["quality", "toxic", "long", "english"]
    both = labels.join(docs, "doc_id", "full").select(*[F.coalesce(n, F.lit(False)).alias(n) for n in names])
    counts = both.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}__{b}") for a in names for b in names])
    rows = F.array(*[F.struct(F.lit(a).alias("mask_a"), F.lit(b).alias("mask_b"), F.col(f"{a}__{b}").alias("n_both"), (F.col(f"{a}__{a}") + F.col(f"{b}__{b}") - F.col(f"{a}__{b}")).alias("n_either")) for a in names for b in names])
    return counts.select(F.explode(rows).alias("r")).select("r.*").where("n_both > 0").withColumn("jaccard", r6(F.col("n_both") / F.col("n_either")))


# --- aggregates


@query("""
SELECT l_suppkey, l_returnflag AS dominant, n FROM (SELECT l_suppkey, l_returnflag, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_returnflag) AS rn FROM lineitem GROUP BY 1, 2) q WHERE rn = 1""")
def mode_deterministic(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent return flag of each supplier, of ties the first by name."""
    counts = table(spark, d, "lineitem", "l_suppkey", "l_returnflag").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return R.top_per_key(counts, ["l_suppkey"], [F.desc("n"), F.col("l_returnflag")]).select("l_suppkey", F.col("l_returnflag").alias("dominant"), "n")


@query("""
WITH c AS (SELECT l_suppkey, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT l_suppkey, string_agg(p_brand, ' | ' ORDER BY p_brand) AS brands, string_agg(p_brand, ',' ORDER BY n DESC, p_brand) AS by_count FROM c GROUP BY 1""")
def sorted_unique_list(spark: SparkSession, d: str) -> DataFrame:
    """The brands of each supplier, sorted by name and by how often they stand."""
    counts = table(spark, d, "lineitem", "l_suppkey", "l_partkey").join(table(spark, d, "part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("n"))
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "p_brand"))), lambda x: x["p_brand"])
    return counts.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), " | ").alias("brands"), F.array_join(ranked, ",").alias("by_count"))


@query("SELECT l_suppkey, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS mean_discount, round(sum(l_quantity), 2) AS weight, sum(CASE WHEN l_discount > 1 THEN l_discount END) AS none_sum FROM lineitem GROUP BY 1")
def weighted_mean_rates(spark: SparkSession, d: str) -> DataFrame:
    """Discount of each supplier weighted by quantity; a sum without any value is null."""
    lines = table(spark, d, "lineitem", "l_suppkey", "l_quantity", "l_discount")
    w = F.sum(F.when(F.col("l_discount").isNotNull(), F.col("l_quantity")))
    return lines.groupBy("l_suppkey").agg(r6(S.safe_divide(F.sum(F.col("l_quantity") * F.col("l_discount")), w)).alias("mean_discount"), F.round(w, 2).alias("weight"), F.sum(F.when(F.col("l_discount") > 1, F.col("l_discount"))).alias("none_sum"))


@query("""
WITH o AS (SELECT c_nationkey, year(o_orderdate)::INT AS year, o_totalprice AS x, row_number() OVER (PARTITION BY c_nationkey, year(o_orderdate) ORDER BY o_totalprice, o_orderkey) AS i, row_number() OVER (PARTITION BY c_nationkey, year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) AS j FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT c_nationkey, year, count(*) AS n, round(2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*), 6) AS gini, round(sum(x * x) / pow(sum(x), 2), 6) AS hhi, round(sum(CASE WHEN j <= 5 THEN x END) / sum(x), 6) AS top5_share FROM o GROUP BY 1, 2""")
def concentration_gini_hhi_topn(spark: SparkSession, d: str) -> DataFrame:
    """Concentration of order values by nation and year."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").join(table(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).withColumn("year", F.year("o_orderdate"))
    by = Window.partitionBy("c_nationkey", "year")
    o = o.withColumn("i", F.row_number().over(by.orderBy("o_totalprice", "o_orderkey"))).withColumn("j", F.row_number().over(by.orderBy(F.desc("o_totalprice"), "o_orderkey")))
    return o.groupBy("c_nationkey", "year").agg(F.count("*").alias("n"), r6(D.gini("o_totalprice", "i")).alias("gini"), r6(D.herfindahl("o_totalprice")).alias("hhi"), r6(F.sum(F.when(F.col("j") <= 5, F.col("o_totalprice"))) / F.sum("o_totalprice")).alias("top5_share"))


@query("""
WITH c AS (SELECT user_id, ts >= TIMESTAMP '2024-01-16' AS late, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3), e AS (SELECT user_id, event_type, sum(n) AS n FROM c GROUP BY 1, 2),
p AS (SELECT user_id, n / sum(n) OVER (PARTITION BY user_id) AS p FROM e), h AS (SELECT user_id, CASE WHEN count(*) < 2 THEN 0.0 ELSE -sum(p * ln(p)) / ln(count(*)) END AS entropy FROM p GROUP BY 1),
s AS (SELECT user_id, late, event_type, n / sum(n) OVER (PARTITION BY user_id, late) AS p FROM c), t AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, 0.5 * sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) AS distance FROM (SELECT * FROM s WHERE NOT late) a FULL JOIN (SELECT * FROM s WHERE late) b ON a.user_id = b.user_id AND a.event_type = b.event_type GROUP BY 1)
SELECT user_id, round(entropy, 6) AS entropy, round(distance, 6) AS distance FROM h JOIN t USING (user_id)""")
def entropy_tv_distance(spark: SparkSession, d: str) -> DataFrame:
    """Evenness of each user's event types, and how far the late half is from the early one."""
    e = table(spark, d, "events", "user_id", "ts", "event_type").groupBy("user_id", (F.col("ts") >= F.expr("timestamp_ntz'2024-01-16'")).alias("late"), "event_type").agg(F.count("*").alias("n"))
    all_ = e.groupBy("user_id", "event_type").agg(F.sum("n").alias("n"))
    half = lambda k: e.where("late" if k else "not late").select("user_id", "event_type", "n")
    out = D.normalised_entropy(all_, "user_id", "n").join(D.total_variation(half(0), half(1), "user_id", "event_type"), "user_id")
    return out.select("user_id", r6("entropy").alias("entropy"), r6("distance").alias("distance"))


@query("""
WITH e AS (SELECT quantile_cont(o_totalprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM orders WHERE year(o_orderdate) = 1995),
b AS (SELECT year(o_orderdate)::INT AS year, len(list_filter(q, lambda x: x < o_totalprice)) AS bin FROM orders, e), g AS (SELECT y.year, k.bin FROM (SELECT DISTINCT year FROM b) y, (SELECT unnest(range(10)) AS bin) k),
s AS (SELECT g.year, g.bin, greatest(count(b.bin) / sum(count(b.bin)) OVER (PARTITION BY g.year), 1e-6) AS share FROM g LEFT JOIN b ON b.year = g.year AND b.bin = g.bin GROUP BY 1, 2)
SELECT a.year, round(sum((a.share - r.share) * ln(a.share / r.share)), 6) AS psi FROM s a JOIN s r ON r.bin = a.bin AND r.year = 1995 GROUP BY 1""")
def psi_deciles(spark: SparkSession, d: str) -> DataFrame:
    """Drift of order values by year against the deciles of 1995."""
    o = table(spark, d, "orders", "o_orderdate", "o_totalprice").withColumn("year", F.year("o_orderdate"))
    edges = D.exact_quantiles(o.where("year = 1995"), "o_totalprice", [i / 10 for i in range(1, 10)])
    binned = o.crossJoin(F.broadcast(edges)).select("year", F.size(F.filter("q", lambda x: x < F.col("o_totalprice"))).alias("bin"))  # one row
    per = binned.groupBy("year").agg(F.count("*").alias("all"), *[F.count_if(F.col("bin") == i).alias(f"b{i}") for i in range(10)])
    share = per.select("year", *[F.greatest(F.col(f"b{i}") / F.col("all"), F.lit(1e-6)).alias(f"s{i}") for i in range(10)])
    base = share.where("year = 1995").select(*[F.col(f"s{i}").alias(f"r{i}") for i in range(10)])
    terms = [(F.col(f"s{i}") - F.col(f"r{i}")) * F.log(F.col(f"s{i}") / F.col(f"r{i}")) for i in range(10)]
    return share.crossJoin(F.broadcast(base)).select("year", r6(S.row_sum(terms)).alias("psi"))  # one row


@query("""
WITH j AS (SELECT p_type, l_quantity AS x, l_extendedprice AS y FROM lineitem JOIN part ON l_partkey = p_partkey), r AS (SELECT *, rank() OVER (PARTITION BY p_type ORDER BY x) + (count(*) OVER (PARTITION BY p_type, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY p_type ORDER BY y) + (count(*) OVER (PARTITION BY p_type, y) - 1) / 2 AS ry FROM j)
SELECT p_type, round(corr(x, y), 5) AS pearson, round(corr(rx, ry), 5) AS spearman FROM r GROUP BY 1""")
def spearman_pearson(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of quantity and price by part type."""
    j = table(spark, d, "lineitem", "l_partkey", "l_quantity", "l_extendedprice").join(table(spark, d, "part", "p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    return D.spearman(j, "p_type", "l_quantity", "l_extendedprice").select("p_type", F.round("pearson", 5).alias("pearson"), F.round("spearman", 5).alias("spearman"))


@query("""
WITH s AS (SELECT l_suppkey, sum(w) AS sw, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, sum(w * x * x) / sum(w) AS xx, sum(w * y * y) / sum(w) AS yy, sum(w * x * y) / sum(w) AS xy, sum(w * w) AS ww FROM (SELECT l_suppkey, l_quantity AS x, l_extendedprice / 1000 AS y, 1 - l_discount AS w FROM lineitem) q GROUP BY 1)
SELECT l_suppkey, round((xy - mx * my) / (xx - mx * mx), 5) AS slope, round((xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)), 5) AS correlation, round(sw * sw / ww, 4) AS effective_n, round((xy - mx * my) / (xx - mx * mx) * (sw * sw / ww) / (sw * sw / ww + 3), 5) AS shrunken_slope FROM s""")
def weighted_regression(spark: SparkSession, d: str) -> DataFrame:
    """Slope of price on quantity for each supplier, weighted, and shrunken by the effective number of lines."""
    lines = table(spark, d, "lineitem", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
    fit = D.weighted_regression(F.col("l_quantity"), F.col("l_extendedprice") / 1000, 1 - F.col("l_discount"))
    return lines.groupBy("l_suppkey").agg(*[F.round(c, 4 if k == "effective_n" else 5).alias(k) for k, c in fit.items()])


@query("""
WITH r AS (SELECT o_orderpriority, abs(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority)) AS x, o_orderkey FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY x, o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM r)
SELECT o_orderpriority, round(quantile_cont(x, 0.8), 3) AS q80_linear, round(min(CASE WHEN i >= ceil(0.8 * (n - 1)) + 1 THEN x END), 3) AS q80_higher, round(min(CASE WHEN i >= ceil(0.9 * (n - 1)) + 1 THEN x END), 3) AS q90_higher, round(avg((x <= 100000)::INT), 6) AS coverage FROM n GROUP BY 1""")
def exact_quantiles_higher(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of absolute residuals, interpolated and next higher, and the coverage of a fixed range."""
    o = table(spark, d, "orders", "o_orderpriority", "o_totalprice")
    x = o.join(o.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m")), "o_orderpriority").select("o_orderpriority", F.abs(F.col("o_totalprice") - F.col("m")).alias("x"))
    linear = D.exact_quantiles(x, "x", [0.8], ["o_orderpriority"]).select("o_orderpriority", F.round(F.col("q")[0], 3).alias("q80_linear"))
    higher = D.exact_quantiles(x, "x", [0.8, 0.9], ["o_orderpriority"], "higher").select("o_orderpriority", F.round(F.col("q")[0], 3).alias("q80_higher"), F.round(F.col("q")[1], 3).alias("q90_higher"))
    covered = x.groupBy("o_orderpriority").agg(r6(F.avg((F.col("x") <= 100000).cast("int"))).alias("coverage"))
    return linear.join(higher, "o_orderpriority").join(covered, "o_orderpriority")


@query("""
SELECT coalesce(l_returnflag, 'total') AS l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o, count(*) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def crosstab_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Return flag by line status, with the margins."""
    lines = table(spark, d, "lineitem", "l_returnflag", "l_linestatus")
    wide = lines.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count().select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))
    total = wide.agg(F.sum("f").alias("f"), F.sum("o").alias("o")).select(F.lit("total").alias("l_returnflag"), "f", "o")
    return wide.unionByName(total).withColumn("total", F.col("f") + F.col("o"))


@query("""
WITH s AS (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS b, count(l_orderkey) > 0 AS c, coalesce(max((l_quantity >= 45)::INT), 0) = 1 AS e, coalesce(max((l_returnflag = 'R')::INT), 0) = 1 AS r FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
n AS (SELECT count(*) AS n1, count(*) FILTER (b) AS n2, count(*) FILTER (b AND c) AS n3, count(*) FILTER (b AND c AND e) AS n4, count(*) FILTER (b AND c AND e AND r) AS n5 FROM s),
u AS (SELECT unnest([1, 2, 3, 4, 5]) AS step, unnest(['all', 'urgent', 'with_lines', 'large', 'returned']) AS stage, unnest([n1, n2, n3, n4, n5]) AS n FROM n)
SELECT step, stage, n, round(n / coalesce(lag(n) OVER (ORDER BY step), n), 6) AS kept_from_previous, round(n / first_value(n) OVER (ORDER BY step), 6) AS kept_from_start FROM u""")
def funnel_retention(spark: SparkSession, d: str) -> DataFrame:
    """Orders that pass each of a row of conditions."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_quantity", "l_returnflag").groupBy("l_orderkey").agg((F.max("l_quantity") >= 45).alias("large"), (F.count_if(F.col("l_returnflag") == "R") > 0).alias("returned"))
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return R.funnel(o, [("all", F.lit(True)), ("urgent", F.col("o_orderpriority") == "1-URGENT"), ("with_lines", F.col("l_orderkey").isNotNull()), ("large", F.col("large")), ("returned", F.col("returned"))])


@query("""
WITH u AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_linenumber']) AS column_name, unnest([l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber::DOUBLE]) AS x FROM lineitem)
SELECT column_name, count(*) AS n_rows, count(*) FILTER (x IS NULL) AS n_null, count(DISTINCT x) AS n_distinct, count(*) FILTER (x = 0) AS n_zero, count(*) FILTER (x < 0) AS n_negative, min(x) AS least, max(x) AS greatest FROM u GROUP BY 1""")
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return R.column_profile(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"])


@query("""
SELECT event_type, count(*) AS n_events, count(DISTINCT user_id) AS n_users, count(*) FILTER (value > 100) AS n_large, count(*) FILTER (hour(ts) < 12) AS n_morning, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1""")
def event_counters(spark: SparkSession, d: str) -> DataFrame:
    """Conditional counters by event type in one pass."""
    e = table(spark, d, "events", "event_type", "user_id", "ts", "value").groupBy("event_type").agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_users"), F.count_if(F.col("value") > 100).alias("n_large"), F.count_if(F.hour("ts") < 12).alias("n_morning"))
    return e.crossJoin(F.broadcast(e.agg(F.sum("n_events").alias("all")))).select("*", r6(F.col("n_events") / F.col("all")).alias("share")).drop("all")  # one row


@query("""
WITH l AS (SELECT user_id, n FROM (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 3 WHEN event_type = 'click' THEN 1 ELSE 0 END AS n FROM events) a UNION ALL SELECT e.user_id, 1 FROM events e WHERE event_type = 'signup')
SELECT user_id, sum(n)::BIGINT AS points, count(*) AS n_entries FROM l GROUP BY 1""")
def event_ledger(spark: SparkSession, d: str) -> DataFrame:
    """One event as several ledger entries, summed for each user."""
    e = table(spark, d, "events", "user_id", "event_type")
    points = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 1).otherwise(0)
    entries = F.when(F.col("event_type") == "signup", F.array(points, F.lit(1))).otherwise(F.array(points))
    return e.select("user_id", F.explode(entries).alias("n")).groupBy("user_id").agg(F.sum("n").alias("points"), F.count("*").alias("n_entries"))


@query("""
SELECT 'lang' AS dimension, d.lang AS value, count(*) AS n, round(avg(quality), 6) AS prevalence FROM documents d JOIN labels l USING (doc_id) GROUP BY 2 UNION ALL SELECT 'source', d.source, count(*), round(avg(quality), 6) FROM documents d JOIN labels l USING (doc_id) GROUP BY 2""")
def subgroup_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Prevalence by each value of several dimensions, from one pass."""
    j = table(spark, d, "documents", "doc_id", "lang", "source").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id")
    return j.unpivot(["quality"], ["lang", "source"], "dimension", "value").groupBy("dimension", "value").agg(F.count("*").alias("n"), r6(F.avg("quality")).alias("prevalence"))


# --- windows, ranks, bands


@query("""
WITH g AS (SELECT p_partkey, p_brand, p_retailprice, avg(p_retailprice) OVER w AS m, stddev_samp(p_retailprice) OVER w AS s, count(*) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand))
SELECT p_partkey, CASE WHEN n >= 20 AND s > 0 THEN round(greatest(-3, least(3, (p_retailprice - m) / s)), 5) END AS z FROM g""")
def zscore_clip_role(spark: SparkSession, d: str) -> DataFrame:
    """Price within its brand in standard deviations, cut at 3; null below 20 parts."""
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_retailprice")
    x = F.col("p_retailprice")
    fit = p.groupBy("p_brand").agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("sd"), F.count("*").alias("n"))
    z = F.when((F.col("n") >= 20) & (F.col("sd") > 0), S.clip((x - F.col("m")) / F.col("sd"), -3.0, 3.0))
    return p.join(fit, "p_brand").select("p_partkey", F.round(z, 5).alias("z"))


@query("""
SELECT c_custkey, round((rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_nationkey, c_acctbal) - 1) / 2) / count(*) OVER (PARTITION BY c_nationkey), 6) AS pct FROM customer""")
def pct_rank_average(spark: SparkSession, d: str) -> DataFrame:
    """Percent rank of the balance within the nation, ties averaged."""
    return D.pct_ranks(table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal"), "c_acctbal", ["c_nationkey"], "pct").select("c_custkey", r6("pct").alias("pct"))


@query("""
WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n, ntile(5) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS tile FROM customer)
SELECT c_custkey, CASE WHEN n > 1 THEN greatest(1, ((r - 1) * 5 + n - 2) // (n - 1))::INT END AS band, tile::INT AS tile, r - 1 AS place FROM r""")
def qcut_bands(spark: SparkSession, d: str) -> DataFrame:
    """Quintile bands of the balance within the nation, by equal quantiles and by equal counts."""
    r, n = F.col("r"), F.col("__all")
    rows = D.row_numbers(table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal"), "c_acctbal", "c_custkey", "r", ["c_nationkey"])
    return rows.select("c_custkey", F.when(n > 1, D.equal_bands(r, n, 5)).alias("band"), D.tile(r, n, 5).alias("tile"), (r - 1).alias("place"))


@query("""
WITH p AS (SELECT p_brand, p_partkey, ((p_partkey * 7919) % 1000 + 1) / 20000.0::DOUBLE AS p FROM part), r AS (SELECT *, p * count(*) OVER (PARTITION BY p_brand) / row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS raw FROM p)
SELECT p_partkey, round(least(1.0, min(raw) OVER (PARTITION BY p_brand ORDER BY p, p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_adjusted FROM r""")
def bh_adjust(spark: SparkSession, d: str) -> DataFrame:
    """p-values adjusted for the false discovery rate within a family."""
    rows = table(spark, d, "part", "p_brand", "p_partkey").withColumn("p", ((F.col("p_partkey") * 7919) % 1000 + 1) / 20000.0)
    return D.benjamini_hochberg(rows, "p_brand", "p", "p_partkey").select("p_partkey", r6("p_adjusted").alias("p_adjusted"))


@query("""
WITH x AS (SELECT o_orderkey, o_totalprice AS v, o_totalprice * ((o_orderkey * 37 % 100) / 100.0::DOUBLE) AS e FROM orders), a AS (SELECT *, row_number() OVER (ORDER BY round(e, 4) DESC, o_orderkey) AS re, row_number() OVER (ORDER BY v DESC, o_orderkey) AS rv FROM x)
SELECT o_orderkey, round(e, 4) AS exposure, rv <= 182 AS among_largest FROM a WHERE re <= 182""")
def topk_capacity(spark: SparkSession, d: str) -> DataFrame:
    """The 182 orders with the largest exposure, and whether value alone would have chosen them."""
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice").withColumn("exposure", F.round(F.col("o_totalprice") * ((F.col("o_orderkey") * 37 % 100) / 100.0), 4))
    by_value = o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(182).select(F.col("o_orderkey").alias("k"))
    top = o.orderBy(F.desc("exposure"), "o_orderkey").limit(182)
    return top.join(F.broadcast(by_value), F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", "exposure", F.col("k").isNotNull().alias("among_largest"))  # 182 rows


@query("""
WITH t AS (SELECT quantile_cont(o_totalprice, 0.8) AS q, sum(o_totalprice) AS s, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS p FROM orders), k AS (SELECT count(*) AS n_top, count(*) FILTER (o_orderstatus = 'F') AS hits, sum(o_totalprice) AS v FROM orders, t WHERE o_totalprice >= q)
SELECT n_top, hits, round(hits / p, 6) AS capture, round((hits / n_top) / (p / n), 6) AS lift, round(v / s, 6) AS value_share FROM k, t""")
def top_quintile_capture(spark: SparkSession, d: str) -> DataFrame:
    """What the orders at or above the 80th percentile of value hold of all finished ones."""
    o = table(spark, d, "orders", "o_totalprice", "o_orderstatus")
    cut = D.exact_quantiles(o, "o_totalprice", [0.8]).select(F.col("q")[0].alias("q"))
    top, hit = F.col("o_totalprice") >= F.col("q"), F.col("o_orderstatus") == "F"
    sums = o.crossJoin(F.broadcast(cut)).agg(F.count("*").alias("n"), F.count_if(hit).alias("p"), F.sum("o_totalprice").alias("s"), F.count_if(top).alias("n_top"), F.count_if(top & hit).alias("hits"), F.sum(F.when(top, F.col("o_totalprice"))).alias("v"))  # one row
    return sums.select("n_top", "hits", r6(F.col("hits") / F.col("p")).alias("capture"), r6((F.col("hits") / F.col("n_top")) / (F.col("p") / F.col("n"))).alias("lift"), r6(F.col("v") / F.col("s")).alias("value_share"))


@query("SELECT o_orderpriority, o_orderkey, rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::INT AS rn FROM orders) q WHERE rn <= 3")
def per_category_quota(spark: SparkSession, d: str) -> DataFrame:
    """The three largest orders of each priority."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders", "o_orderpriority", "o_orderkey", "o_totalprice").withColumn("place", F.row_number().over(w)).where("place <= 3").select("o_orderpriority", "o_orderkey", "place")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're') ORDER BY starts_with(lower(p_name), 're') DESC, p_name, p_partkey LIMIT 25")
def prefix_search(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 parts whose name holds a text, those that begin with it first."""
    name = F.lower("p_name")
    return table(spark, d, "part", "p_partkey", "p_name").where(name.contains("re")).orderBy(name.startswith("re").desc(), "p_name", "p_partkey").limit(25)


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR || ':7'), o_orderkey LIMIT 100")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """A repeatable sample of exactly 100 orders, by the smallest hashes."""
    return table(spark, d, "orders", "o_orderkey").orderBy(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":7"))), "o_orderkey").limit(100)


# --- text, dates, arithmetic


@query("""
WITH n AS (SELECT 'document' AS kind, doc_id AS id, text AS name FROM documents UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier)
SELECT kind, id, regexp_replace(translate(lower(name), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿðłøđıźżśćńąęčšžřůěťďňőű', 'aaaaaaceeeeiiiinooooouuuuyydlodizzscnaecszruetdnou').replace('ß', 'ss').replace('æ', 'ae').replace('œ', 'oe').replace('&', 'and'), '[^a-z0-9]+', '', 'g') AS name_key,
  array_to_string(list_sort(regexp_extract_all(lower(name), '[a-z0-9]+')), '|') AS signature FROM n""")
def normalize_names(spark: SparkSession, d: str) -> DataFrame:
    """Folded keys and token signatures of the whole text of each document and of each supplier's name."""
    texts = table(spark, d, "documents", "doc_id", "text").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("name"))
    names = texts.unionByName(table(spark, d, "supplier", "s_suppkey", "s_name").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
    return names.select("kind", "id", S.name_key(F.col("name")).alias("name_key"), S.token_signature(F.col("name")).alias("signature"))


@query("""
SELECT page_id, nullif(regexp_extract(html, 'href="([^"]*)"', 1), '') AS first_href, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS text_chars, TRY_CAST(replace(regexp_replace(regexp_extract(url, '/([0-9]+)', 1), '[^0-9,.-]', '', 'g'), ',', '') AS DOUBLE) AS number FROM pages""")
def html_money_parse(spark: SparkSession, d: str) -> DataFrame:
    """Link, title, length without tags and a number of each page."""
    title = F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(""))
    return table(spark, d, "pages").select("page_id", S.first_href(F.col("html")).alias("first_href"), title.alias("title"), F.length(F.regexp_replace("html", "<[^>]+>", "")).cast("bigint").alias("text_chars"), S.money(F.regexp_extract("url", "/([0-9]+)", 1)).alias("number"))


@query("SELECT l_orderkey, l_linenumber, sha256(l_orderkey || '|' || l_partkey || '|' || l_suppkey) AS surrogate, concat_ws(':', l_orderkey, l_partkey, l_linenumber) AS natural_key FROM lineitem")
def surrogate_keys(spark: SparkSession, d: str) -> DataFrame:
    """Hashed and readable keys of lines."""
    keys = ("l_orderkey", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem", *keys, "l_linenumber").select("l_orderkey", "l_linenumber", S.surrogate_key(*map(F.col, keys)).alias("surrogate"), S.natural_key(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")).alias("natural_key"))


@query("""
SELECT o_orderkey, (year(o_orderdate) - (month(o_orderdate) < 7)::INT)::INT AS july_season, (year(o_orderdate) - (month(o_orderdate) < 6)::INT)::INT AS june_season, (CASE WHEN o_orderdate::DATE >= make_date(year(o_orderdate), 6, 30) THEN year(o_orderdate) - 1 ELSE year(o_orderdate) - 2 END)::INT AS completed,
  lpad(((year(o_orderdate) - (month(o_orderdate) < 7)::INT) % 100)::VARCHAR, 2, '0') || '/' || lpad(((year(o_orderdate) - (month(o_orderdate) < 7)::INT + 1) % 100)::VARCHAR, 2, '0') AS label,
  CASE WHEN month(o_orderdate) BETWEEN 6 AND 10 THEN 'summer' WHEN month(o_orderdate) BETWEEN 1 AND 2 THEN 'winter' ELSE 'other' END AS market FROM orders""")
def season_rules(spark: SparkSession, d: str) -> DataFrame:
    """Season of each order by three different boundaries, its label and its window."""
    x = F.col("o_orderdate")
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", S.season_start(x).alias("july_season"), S.season_start(x, 6).alias("june_season"), S.completed_season(x).alias("completed"), S.season_label(x).alias("label"), S.market_window(x).alias("market"))


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice <= 0 THEN NULL WHEN o_totalprice <= 50000 THEN 'low' WHEN o_totalprice <= 150000 THEN 'mid' WHEN o_totalprice <= 1000000 THEN 'high' END AS right_closed, CASE WHEN o_totalprice < 0 THEN NULL WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' WHEN o_totalprice < 1000000 THEN 'high' END AS left_closed,
  round(ln(o_totalprice / 100000), 6) AS log_ratio, round(sin(2 * pi() * month(o_orderdate) / 12), 6) AS month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 6) AS month_cos, round(pow(year(o_orderdate) - 1998, 2), 6) AS curve FROM orders""")
def bins_left_right(spark: SparkSession, d: str) -> DataFrame:
    """Value bins closed on either side, a log ratio, cyclic months and a quadratic curve."""
    edges, labels = [0, 50000, 150000, 1000000], ["low", "mid", "high"]
    x, m = F.col("o_totalprice"), 2 * F.pi() * F.month("o_orderdate") / 12
    return table(spark, d, "orders", "o_orderkey", "o_orderdate", "o_totalprice").select("o_orderkey", S.bin_right(x, edges, labels).alias("right_closed"), S.bin_left(x, edges, labels).alias("left_closed"), r6(S.log_ratio(x, F.lit(100000))).alias("log_ratio"), r6(F.sin(m)).alias("month_sin"), r6(F.cos(m)).alias("month_cos"), r6(F.pow(F.year("o_orderdate") - 1998, F.lit(2))).alias("curve"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) > 50, false) AS large FROM events")
def json_props_extract(spark: SparkSession, d: str) -> DataFrame:
    """A number out of the JSON of each event."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events", "event_id", "props").select("event_id", k.alias("k"), F.coalesce(k > 50, F.lit(False)).alias("large"))


def row_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier as JSON."""
    return to_json_rows(table(spark, d, "supplier"), "s_suppkey")


QUERIES["row_payloads"] = row_payloads
SQL["row_payloads"] = """SELECT s_suppkey, '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || ',"s_acctbal":' || s_acctbal || '}' AS payload FROM supplier"""


@query("""
WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, (SELECT max(len(embedding)) FROM embeddings) + 1)) AS i) k GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(v * v)) AS len, list(v ORDER BY i) AS vs FROM m GROUP BY 1)
SELECT e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], n.vs) / (n.len * sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 5) AS cosine, round(list_sum(list_transform(list_zip(e.embedding::DOUBLE[], n.vs), lambda z: abs(z[1] - z[2]))) / len(e.embedding), 5) AS mean_gap FROM embeddings e JOIN n USING (label)""")
def vector_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's cosine with, and mean absolute distance from, the mean of its label."""
    e = table(spark, d, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("mean"))
    gaps = F.zip_with("embedding", "mean", lambda a, b: F.abs(a.cast("double") - b))
    return e.join(means, "label").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("mean")), 5).alias("cosine"), F.round(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size("embedding"), 5).alias("mean_gap"))


# --- metrics

_SCORED = "WITH s AS (SELECT l.quality AS y, round(1 / (1 + exp(-(d.n_chars - 1500) / 1000.0::DOUBLE)), 4) AS p, d.doc_id, d.lang FROM documents d JOIN labels l USING (doc_id))"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    p = F.round(S.sigmoid((F.col("n_chars") - 1500) / 1000.0), 4)
    return table(spark, d, "documents", "doc_id", "n_chars", "lang").join(table(spark, d, "labels", "doc_id", "quality"), "doc_id").select("doc_id", "lang", F.col("quality").alias("y"), p.alias("p"))


@query(_SCORED + """, k AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r, ntile(10) OVER (ORDER BY p, doc_id) AS bin FROM s),
b AS (SELECT bin, count(*) AS n, abs(avg(y) - avg(p)) AS gap FROM k GROUP BY 1), t AS (SELECT p, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1), c AS (SELECT pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS seen FROM t)
SELECT count(*) AS n, round(avg((y - p) * (y - p)), 6) AS brier, round(-avg(y * ln(q) + (1 - y) * ln(1 - q)), 6) AS log_loss, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc, (SELECT round(sum(n * gap) / sum(n), 6) FROM b) AS ece, (SELECT round(sum(pos * tp / seen) / sum(pos), 6) FROM c) AS average_precision, round(avg(p) - avg(y), 6) AS calibration_gap FROM k""")
def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Brier score, log loss, exact AUC, calibration error of equal-count bins and average precision."""
    s = _scored(spark, d)
    q = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    y, p = F.col("y"), F.col("p")
    plain = s.agg(F.count("*").alias("n"), r6(F.avg((y - p) * (y - p))).alias("brier"), r6(-F.avg(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"), r6(F.avg(p) - F.avg(y)).alias("calibration_gap"))
    auc = D.auc(s, [], "y", "p").select(r6("auc").alias("auc"))
    bins = D.row_numbers(s, "p", "doc_id", "place").withColumn("bin", D.tile(F.col("place"), F.col("__all"), 10)).groupBy("bin").agg(F.count("*").alias("k"), F.abs(F.avg(y) - F.avg(p)).alias("gap"))
    ece = bins.agg(r6(F.sum(F.col("k") * F.col("gap")) / F.sum("k")).alias("ece"))
    precision = D.average_precision(s, "y", "p").select(r6("average_precision").alias("average_precision"))
    out = plain
    for one in (auc, ece, precision):  # each is one row
        out = out.crossJoin(F.broadcast(one))
    return out


@query(_SCORED + """, r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2 AS r FROM s)
SELECT lang, CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) END AS auc FROM r GROUP BY 1""")
def subgroup_auc(spark: SparkSession, d: str) -> DataFrame:
    return D.auc(_scored(spark, d), ["lang"], "y", "p").select("lang", r6("auc").alias("auc"))


@query("""
WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), p AS (SELECT a.v AS actual, b.v AS predicted FROM y a JOIN y b ON b.o_custkey = a.o_custkey AND b.y = a.y - 1)
SELECT count(*) AS n, round(avg(abs(actual - predicted)), 2) AS mae, round(sqrt(avg(pow(actual - predicted, 2))), 2) AS rmse, round(1 - sum(pow(actual - predicted, 2)) / (var_pop(actual) * count(*)), 5) AS r2, round(corr(actual, predicted), 5) AS correlation FROM p""")
def continuous_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Errors of last year's total as a prediction of this year's."""
    y = table(spark, d, "orders", "o_custkey", "o_orderdate", "o_totalprice").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("actual"))
    last = y.select("o_custkey", (F.col("y") + 1).alias("y"), F.col("actual").alias("predicted"))
    e = F.col("actual") - F.col("predicted")
    return y.join(last, ["o_custkey", "y"]).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 2).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 2).alias("rmse"), F.round(1 - F.sum(e * e) / (F.var_pop("actual") * F.count("*")), 5).alias("r2"), F.round(F.corr("actual", "predicted"), 5).alias("correlation"))


@query("""
WITH f AS (SELECT median(o_totalprice) AS m, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) AS iqr, quantile_cont(o_totalprice, 0.01) AS p01, quantile_cont(o_totalprice, 0.99) AS p99, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE year(o_orderdate) <= 1996)
SELECT o_orderkey, round(abs(o_totalprice - m) / greatest(iqr / 1.349, 1e-8), 5) AS distance, CASE WHEN o_totalprice < lo OR o_totalprice > hi THEN 'refuse' WHEN o_totalprice < p01 OR o_totalprice > p99 THEN 'limited' ELSE 'supported' END AS status FROM orders, f WHERE year(o_orderdate) > 1996""")
def ood_support_status(spark: SparkSession, d: str) -> DataFrame:
    """How far later orders are from the profile of the base years, and whether they are supported by it."""
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate", "o_totalprice")
    x = F.col("o_totalprice")
    base = o.where(F.year("o_orderdate") <= 1996)
    fit = base.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).crossJoin(F.broadcast(D.exact_quantiles(base, "o_totalprice", [0.5, 0.25, 0.75, 0.01, 0.99])))  # one row
    status = F.when((x < F.col("lo")) | (x > F.col("hi")), "refuse").when((x < F.col("q")[3]) | (x > F.col("q")[4]), "limited").otherwise("supported")
    distance = F.abs(x - F.col("q")[0]) / F.greatest((F.col("q")[2] - F.col("q")[1]) / 1.349, F.lit(1e-8))
    return o.where(F.year("o_orderdate") > 1996).crossJoin(F.broadcast(fit)).select("o_orderkey", F.round(distance, 5).alias("distance"), status.alias("status"))  # one row


@query("""
WITH s AS (SELECT c_nationkey, avg((c_acctbal < 1000)::INT) AS a, avg((c_acctbal > 6000)::INT) AS b, avg((c_mktsegment = 'BUILDING')::INT) AS c FROM customer GROUP BY 1)
SELECT c_nationkey, round(greatest(a, (a + b) / 2, (a + b + c) / 3), 6) AS first_rate, round(least(greatest(b, (b + c) / 2), greatest((a + b) / 2, (a + b + c) / 3)), 6) AS second_rate, round(least(c, (b + c) / 2, (a + b + c) / 3), 6) AS third_rate FROM s""")
def pava_three_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Three rates of a nation, pooled to a non-increasing order."""
    rate = lambda c: F.avg(c.cast("int"))
    s = table(spark, d, "customer").groupBy("c_nationkey").agg(rate(F.col("c_acctbal") < 1000).alias("a"), rate(F.col("c_acctbal") > 6000).alias("b"), rate(F.col("c_mktsegment") == "BUILDING").alias("c"))
    x, y, z = S.pava_decreasing_3(F.col("a"), F.col("b"), F.col("c"))
    return s.select("c_nationkey", r6(x).alias("first_rate"), r6(y).alias("second_rate"), r6(z).alias("third_rate"))


@query("""
WITH c AS (SELECT o_orderkey, o_totalprice AS wage, 1 + o_orderkey % 5 AS years, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prior FROM orders)
SELECT o_orderkey, round(wage * years, 2) AS commitment, round(wage * least(years, 2), 2) AS first_24m, round(wage * greatest(years - 2, 0), 2) AS after_24m, CASE WHEN prior > 0 THEN round(wage / prior - 1, 6) END AS change, CASE WHEN prior IS NULL THEN 'unavailable' WHEN wage < prior * 0.9 THEN 'below' WHEN wage > prior * 1.1 THEN 'above' ELSE 'within' END AS range_position FROM c""")
def contract_cards(spark: SparkSession, d: str) -> DataFrame:
    """Commitment, its parts by time, the change against the prior value and the place in a range around it."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    c = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").select("o_orderkey", F.col("o_totalprice").alias("wage"), (1 + F.col("o_orderkey") % 5).alias("years"), F.lag("o_totalprice").over(w).alias("prior"))
    wage, years, prior = F.col("wage"), F.col("years"), F.col("prior")
    place = F.when(prior.isNull(), "unavailable").when(wage < prior * 0.9, "below").when(wage > prior * 1.1, "above").otherwise("within")
    return c.select("o_orderkey", F.round(wage * years, 2).alias("commitment"), F.round(wage * F.least(years, F.lit(2)), 2).alias("first_24m"), F.round(wage * F.greatest(years - 2, F.lit(0)), 2).alias("after_24m"), r6(S.safe_divide(wage, prior) - 1).alias("change"), place.alias("range_position"))


@query("""
WITH r AS (SELECT c_custkey, (rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2) / count(*) OVER (PARTITION BY c_mktsegment) AS a, (rank() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey % 97) + (count(*) OVER (PARTITION BY c_mktsegment, c_custkey % 97) - 1) / 2) / count(*) OVER (PARTITION BY c_mktsegment) AS b FROM customer)
SELECT c_custkey, round(sqrt(a * b), 6) AS geometric, round(least(a, b), 6) AS least_of_both, a >= 0.5 AND b >= 0.5 AS high_high FROM r""")
def joint_priority(spark: SparkSession, d: str) -> DataFrame:
    """Geometric mean and minimum of two percent ranks within the segment."""
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal").withColumn("other", F.col("c_custkey") % 97)
    c = D.pct_ranks(D.pct_ranks(c, "c_acctbal", ["c_mktsegment"], "a"), "other", ["c_mktsegment"], "b")
    return c.select("c_custkey", r6(F.sqrt(F.col("a") * F.col("b"))).alias("geometric"), r6(F.least("a", "b")).alias("least_of_both"), ((F.col("a") >= 0.5) & (F.col("b") >= 0.5)).alias("high_high"))


@query("""
WITH r AS (SELECT o_orderkey, CASE WHEN o_totalprice <= 0 THEN 'no_value' END AS a, CASE WHEN o_orderstatus = 'P' THEN 'pending' END AS b, CASE WHEN year(o_orderdate) < 1996 THEN 'too_early' END AS c FROM orders)
SELECT o_orderkey, concat_ws('|', a, b, c) AS refusals, a IS NULL AND b IS NULL AND c IS NULL AS eligible FROM r""")
def eligibility_gate(spark: SparkSession, d: str) -> DataFrame:
    """Refusal codes of each order, and whether there are none."""
    codes = F.array_compact(F.array(F.when(F.col("o_totalprice") <= 0, "no_value"), F.when(F.col("o_orderstatus") == "P", "pending"), F.when(F.year("o_orderdate") < 1996, "too_early")))
    return table(spark, d, "orders", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice").select("o_orderkey", F.array_join(codes, "|").alias("refusals"), (F.size(codes) == 0).alias("eligible"))


@query("""
WITH f AS (SELECT c_nationkey, median(c_acctbal) AS m, greatest(quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25), 1e-8) AS iqr, count(*) AS n FROM customer GROUP BY 1), g AS (SELECT median(c_acctbal) AS m, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS iqr FROM customer)
SELECT c_custkey, round((c_acctbal - CASE WHEN f.n >= 30 THEN f.m ELSE g.m END) / CASE WHEN f.n >= 30 THEN f.iqr ELSE g.iqr END, 5) AS robust_z FROM customer c LEFT JOIN f USING (c_nationkey), g""")
def robust_standardisation(spark: SparkSession, d: str) -> DataFrame:
    """Balances of customers by median and quartiles of their nation, or of all where it has few."""
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    shares = [0.25, 0.5, 0.75]
    fit = D.exact_quantiles(c, "c_acctbal", shares, ["c_nationkey"]).join(c.groupBy("c_nationkey").agg(F.count("*").alias("n")), "c_nationkey")
    every = D.exact_quantiles(c, "c_acctbal", shares).withColumnRenamed("q", "g")
    use = F.when(F.col("n") >= 30, F.col("q")).otherwise(F.col("g"))
    out = c.join(fit, "c_nationkey", "left").crossJoin(F.broadcast(every)).withColumn("u", use)  # one row
    return out.select("c_custkey", F.round((F.col("c_acctbal") - F.col("u")[1]) / F.greatest(F.col("u")[2] - F.col("u")[0], F.lit(1e-8)), 5).alias("robust_z"))
