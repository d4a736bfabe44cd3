"""Queries on cleaning, parsing, validation and assembly. Loosely written cells are derived from the tables in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import cleaning as C
from tidemark.functions import scalars as S
from tidemark.operators import models as M
from tidemark.operators import relational as R
from tidemark.sources.tables import sql_view, table

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


_LOOSE = """WITH l AS (SELECT o_orderkey,
  CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN ' ' || strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%b %d, %Y') WHEN 3 THEN 'unknown' WHEN 4 THEN '  ' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' ' END AS ordered_on,
  CASE o_orderkey % 4 WHEN 0 THEN o_custkey::VARCHAR WHEN 1 THEN o_custkey || '.0' WHEN 2 THEN o_custkey || '.5' ELSE 'n/a' END AS customer,
  CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '1,5' WHEN 2 THEN '7d' ELSE o_totalprice::VARCHAR END AS amount, ' ' || o_orderpriority AS priority FROM orders),
d AS (SELECT *, coalesce(try_strptime(trim(ordered_on), '%Y-%m-%d %H:%M:%S'), try_strptime(trim(ordered_on), '%Y-%m-%d'), try_strptime(trim(ordered_on), '%d/%m/%Y'), try_strptime(trim(ordered_on), '%b %d, %Y'))::DATE AS day,
  TRY_CAST(customer AS DOUBLE) AS c, CASE WHEN regexp_full_match(amount, '[0-9.]+') THEN TRY_CAST(amount AS DOUBLE) END AS a FROM l)
"""


def _loose(spark: SparkSession, d: str) -> DataFrame:
    """Orders as a careless export would write them."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    k, day = F.col("o_orderkey"), lambda f: F.date_format("o_orderdate", f)
    on = F.when(k % 6 == 0, day("yyyy-MM-dd")).when(k % 6 == 1, F.concat(F.lit(" "), day("dd/MM/yyyy"))).when(k % 6 == 2, day("MMM dd, yyyy")).when(k % 6 == 3, "unknown").when(k % 6 == 4, "  ").otherwise(F.concat(day("yyyy-MM-dd HH:mm:ss"), F.lit(" ")))
    c = F.col("o_custkey").cast("string")
    customer = F.when(k % 4 == 0, c).when(k % 4 == 1, F.concat(c, F.lit(".0"))).when(k % 4 == 2, F.concat(c, F.lit(".5"))).otherwise("n/a")
    amount = F.when(k % 5 == 1, "1,5").when(k % 5 == 2, "7d").when(k % 5 != 0, F.col("o_totalprice").cast("string"))
    return o.select(k, on.alias("ordered_on"), customer.alias("customer"), amount.alias("amount"), F.concat(F.lit(" "), F.col("o_orderpriority")).alias("priority"))


_TYPES = {"dates": ["ordered_on"], "wholes": ["customer"], "numbers": ["amount"]}


@query(_LOOSE + "SELECT o_orderkey, day AS ordered_on, CASE WHEN c = floor(c) THEN c::BIGINT END AS customer, a AS amount, trim(priority) AS priority FROM d")
def typed_cleaner(spark: SparkSession, d: str) -> DataFrame:
    """Dates in any of several forms, whole numbers and amounts from text cells; what doesn't fit is null."""
    return C.typed(_loose(spark, d), **_TYPES)


@query(_LOOSE + """SELECT 'ordered_on' AS column_name, count(*) AS n_rows, count(*) FILTER (trim(ordered_on) = '') AS n_blank, count(*) FILTER (ordered_on <> trim(ordered_on)) AS n_trimmed, count(*) FILTER (trim(ordered_on) <> '' AND day IS NULL) AS n_invalid FROM d
UNION ALL SELECT 'customer', count(*), 0, 0, count(*) FILTER (c IS NULL OR c <> floor(c)) FROM d
UNION ALL SELECT 'amount', count(*), count(*) FILTER (amount IS NULL), 0, count(*) FILTER (amount IS NOT NULL AND a IS NULL) FROM d
UNION ALL SELECT 'priority', count(*), 0, count(*), 0 FROM d""")
def typed_cleaner_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many cells of each column were blank, trimmed or didn't fit."""
    return C.cleaning_counts(_loose(spark, d), **_TYPES)


@query(_LOOSE + """, v AS (SELECT 'ordered_on' AS column_name, ordered_on AS v FROM l UNION ALL SELECT 'customer', customer FROM l UNION ALL SELECT 'amount', amount FROM l UNION ALL SELECT 'o_orderkey', o_orderkey::VARCHAR FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders
  UNION ALL SELECT 'o_order_date', strftime(o_orderdate, '%Y-%m-%d') FROM orders UNION ALL SELECT 'store_id', (o_custkey % 50)::VARCHAR FROM orders),
t AS (SELECT column_name, CASE WHEN lower(trim(v)) NOT IN ('', 'na', 'n/a', 'null', 'none', 'nan', 'nat') THEN trim(v) END AS v FROM v),
x AS (SELECT *, CASE WHEN regexp_full_match(v, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(v AS DOUBLE) END AS x, coalesce(try_strptime(v, '%Y-%m-%d %H:%M:%S'), try_strptime(v, '%Y-%m-%d'), try_strptime(v, '%d/%m/%Y'), try_strptime(v, '%b %d, %Y')) AS day FROM t),
c AS (SELECT column_name, v, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY 1, 2), m AS (SELECT column_name, v AS commonest FROM c QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v DESC) = 1),
a AS (SELECT column_name, count(*) AS n_rows, count(*) - count(v) AS n_null, count(DISTINCT v) AS n_distinct, count(x) AS n_numeric, count(*) FILTER (x = floor(x)) AS n_whole, count(day) AS n_date, count(*) FILTER (x = 0) AS n_zero, count(*) FILTER (x < 0) AS n_negative, min(x) AS least, max(x) AS greatest, min(length(v)) AS shortest, max(length(v)) AS longest FROM x GROUP BY 1)
SELECT a.*, commonest, CASE WHEN n_rows = n_null THEN 'empty' WHEN column_name = 'o_order_date' AND n_date >= 0.98 * (n_rows - n_null) THEN 'date/datetime' WHEN n_numeric >= 0.995 * (n_rows - n_null) THEN CASE WHEN column_name = 'store_id' THEN 'identifier (numeric-coded)' WHEN n_whole >= 0.995 * (n_rows - n_null) THEN 'integer' ELSE 'decimal' END WHEN column_name = 'store_id' THEN 'identifier (text)' ELSE 'text/categorical' END AS inferred_type FROM a LEFT JOIN m USING (column_name)""")
def text_column_profile(spark: SparkSession, d: str) -> DataFrame:
    """Parse rates, lengths, extremes, commonest values and inferred types of loosely written columns."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    more = o.select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_order_date"), (F.col("o_custkey") % 50).alias("store_id"))
    both = _loose(spark, d).select("o_orderkey", "ordered_on", "customer", "amount")
    return C.text_profile(both, ["ordered_on", "customer", "amount"]).unionByName(C.text_profile(more, more.columns))


@query("""
WITH l AS (SELECT o_orderkey, ' ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.0' ELSE '' END AS raw, CASE o_orderkey % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' yes' WHEN 2 THEN '1' WHEN 3 THEN 'no' END AS flag, CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE o_orderpriority END AS a, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS b FROM orders)
SELECT o_orderkey, regexp_replace(trim(raw), '\\.0$', '') AS id, coalesce(lower(trim(flag)) IN ('true', '1', 'yes'), false) AS flag, lower(trim(flag)) IN ('true', '1', 'yes') AS flag_or_null, CASE WHEN trim(a) <> '' THEN a ELSE b END AS chosen, trim(a) <> '' AND b IS NOT NULL AND a <> coalesce(b, '') AS differs FROM l""")
def identifier_cleaning(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers without a closing '.0', flags, the first cell that isn't blank, and whether two cells differ."""
    k = F.col("o_orderkey")
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    raw = F.concat(F.lit(" "), k.cast("string"), F.when(k % 2 == 0, ".0").otherwise(""))
    flag = F.when(k % 5 == 0, "TRUE").when(k % 5 == 1, " yes").when(k % 5 == 2, "1").when(k % 5 == 3, "no")
    a, b = F.when(k % 3 == 0, "  ").otherwise(F.col("o_orderpriority")), F.when(k % 7 != 0, F.col("o_orderstatus"))
    return o.select(k, S.clean_id(raw).alias("id"), S.to_bool(flag).alias("flag"), S.to_bool_or_null(flag).alias("flag_or_null"), S.non_blank(a, b).alias("chosen"), S.conflict(a, b).alias("differs"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_discount END AS a, CASE WHEN l_tax > 0 THEN l_tax END AS b, l_quantity / 100 AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + 1 >= 2 THEN round((coalesce(a, 0) + coalesce(b, 0) + c) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + 1), 6) END AS mean, abs(a - b) <= 1e-8 + 1e-5 * abs(b) AS same FROM l""")
def row_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean of three cells where at least two are there, and whether two of them are close."""
    a, b = F.when(F.col("l_discount") > 0, F.col("l_discount")), F.when(F.col("l_tax") > 0, F.col("l_tax"))
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity")
    return rows.select("l_orderkey", "l_linenumber", r6(S.row_mean([a, b, F.col("l_quantity") / 100], least=2)).alias("mean"), S.close_to(a, b).alias("same"))


@query("""
WITH e AS (SELECT event_id, 1950 + user_id % 90 AS y, lpad((event_id % 60)::VARCHAR, 2, '0') AS s, lpad((user_id % 60)::VARCHAR, 2, '0') AS m FROM events)
SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 1 THEN CASE WHEN y % 100 <= 40 THEN 2000 + y % 100 ELSE 1900 + y % 100 END ELSE y END::INT AS first_year, CASE event_id % 3 WHEN 0 THEN round(m::INT + s::INT / 60, 6) WHEN 1 THEN round(60 + m::INT + s::INT / 60, 6) END AS minutes, CASE WHEN event_id % 2 = 0 THEN '4-' || (event_id % 5) || '-3' END AS shape FROM e""")
def season_and_clock(spark: SparkSession, d: str) -> DataFrame:
    """First years of seasons, minutes of clocks and shapes, each written in several ways."""
    e, k = table(spark, d, "events", "event_id", "user_id"), F.col("event_id")
    y = 1950 + F.col("user_id") % 90
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    season = F.when(k % 4 == 0, F.concat_ws("/", y, two((y + 1) % 100))).when(k % 4 == 1, F.concat_ws("/", two(y % 100), two((y + 1) % 100))).when(k % 4 == 2, F.concat_ws("-", y, y + 1)).otherwise("n/a")
    m, s = two(F.col("user_id") % 60), two(k % 60)
    clock = F.when(k % 3 == 0, F.concat_ws(":", m, s)).when(k % 3 == 1, F.concat_ws(":", F.lit("01"), m, s)).otherwise("late")
    shape = F.when(k % 2 == 0, F.concat(F.lit("4-"), (k % 5).cast("string"), F.lit("-3 wide"))).otherwise("none")
    return e.select(k, S.season_years(season).alias("first_year"), r6(S.clock_minutes(clock)).alias("minutes"), S.shape_of(shape).alias("shape"))


@query("""
WITH p AS (SELECT l_orderkey, l_quantity AS x, l_extendedprice / 1000 AS y, lead(l_quantity) OVER w AS nx, lead(l_extendedprice / 1000) OVER w AS ny, first_value(l_quantity) OVER w AS fx, first_value(l_extendedprice / 1000) OVER w AS fy FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice))
SELECT l_orderkey, round(abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2, 6) AS area FROM p GROUP BY 1""")
def polygon_areas(spark: SparkSession, d: str) -> DataFrame:
    """Area of the polygon of each order's lines (a few a key)."""
    points = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice"))).alias("p"))
    return points.select("l_orderkey", F.round(S.polygon_area(F.transform("p", lambda p: p["l_quantity"]), F.transform("p", lambda p: p["l_extendedprice"] / 1000)), 6).alias("area"))


@query("""
WITH c AS (SELECT user_id, value % 120 AS x, (event_id * 37) % 80 AS y, lead(value % 120) OVER w AS ex, lead((event_id * 37) % 80) OVER w AS ey FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS n_moves, round(sum(sqrt(power(ex - x, 2) + power(ey - y, 2))), 4) AS distance, round(sum(greatest(ex - x, 0)), 4) AS forward, count(*) FILTER (ex - x >= 10) AS progressive, count(*) FILTER (x < 80 AND ex >= 80) AS into_final_third, count(*) FILTER (x < 102 AND ex >= 102 AND ey BETWEEN 18 AND 62) AS into_box FROM c WHERE ex IS NOT NULL GROUP BY 1""")
def carry_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Length, gain and zones of the moves from each event to the next one of its user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events", "event_id", "user_id", "ts", "value").select("user_id", "ts", "event_id", (F.col("value") % 120).alias("x"), ((F.col("event_id") * 37) % 80).alias("y"))
    x, y, ex, ey = (F.col(c) for c in ("x", "y", "ex", "ey"))
    moves = e.select("user_id", "x", "y", F.lead("x").over(w).alias("ex"), F.lead("y").over(w).alias("ey")).where("ex is not null")
    return moves.groupBy("user_id").agg(F.count("*").alias("n_moves"), F.round(F.sum(C.distance(x, y, ex, ey)), 4).alias("distance"), F.round(F.sum(F.greatest(ex - x, F.lit(0.0))), 4).alias("forward"), F.count_if(ex - x >= 10).alias("progressive"), F.count_if(C.enters(x, ex, 80)).alias("into_final_third"), F.count_if(C.enters(x, ex, 102) & ey.between(18, 62)).alias("into_box"))


@query("SELECT event_id, CASE WHEN value - 50 > 0 THEN round(value - 50, 6) END AS positive, CASE WHEN value / 100 BETWEEN 0 AND 1 THEN round(value / 100, 6) END AS p, round(100 * exp(-(abs(value - 50) / 100 + abs(value - 80) / 100) / 2), 5) AS familiarity FROM events")
def strict_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Finite positive numbers, probabilities, and scores that fall with the distance."""
    v = F.col("value")
    return table(spark, d, "events", "event_id", "value").select("event_id", r6(C.finite_positive(v - 50)).alias("positive"), r6(C.probability(v / 100)).alias("p"), F.round(C.familiarity((v - 50) / 100, (v - 80) / 100), 5).alias("familiarity"))


@query("SELECT lang, count(*) AS n_texts, count(*) FILTER (lower(trim(text)) IN ('', 'na', 'n/a', 'nan', 'null', 'none', '-')) AS n_missing, count(*) FILTER (regexp_matches(text, '[ÂÃ][\u0080-¿]|â€|�')) AS n_mojibake FROM documents GROUP BY 1")
def mojibake_report(spark: SparkSession, d: str) -> DataFrame:
    """Texts of each language that stand for nothing or show a wrong decoding."""
    return table(spark, d, "documents", "lang", "text").groupBy("lang").agg(F.count("*").alias("n_texts"), F.count_if(S.null_token(F.col("text"))).alias("n_missing"), F.count_if(C.is_mojibake(F.col("text"))).alias("n_mojibake"))


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) <= 1997 THEN 'train' WHEN year(o_orderdate) <= 1999 THEN 'validation' ELSE 'test' END AS split FROM orders")
def temporal_labels(spark: SparkSession, d: str) -> DataFrame:
    y = F.year("o_orderdate")
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", F.when(y <= 1997, "train").when(y <= 1999, "validation").otherwise("test").alias("split"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, o_custkey, o_orderstatus FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def asserted_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their order, whose key is asserted to be unique."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus").withColumnRenamed("o_orderkey", "l_orderkey")
    return R.many_to_one(table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity"), o, ["l_orderkey"])


@query("""
WITH a AS (SELECT o_custkey, count(*) AS n_orders, max(o_orderdate)::DATE AS latest FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment ELSE n_name END AS label, CASE WHEN c_custkey % 4 <> 0 THEN 'segment' ELSE 'nation' END AS label_source, r_name AS region, coalesce(n_orders, 0) AS n_orders, latest, n_orders IS NOT NULL AS has_orders
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN a ON o_custkey = c_custkey""")
def dimension_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their nation, region and aggregated orders; the label is the first that isn't blank, with its source."""
    nation = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey").join(table(spark, d, "region", "r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    totals = table(spark, d, "orders", "o_custkey", "o_orderdate").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.to_date(F.max("o_orderdate")).alias("latest"))
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    segment = F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_mktsegment"))
    value, source = R.prioritised((S.non_blank(segment), "segment"), (F.col("n_name"), "nation"))
    out = R.flagged_join(c, totals, ["c_custkey"], "has_orders")
    return out.select("c_custkey", value.alias("label"), source.alias("label_source"), F.col("r_name").alias("region"), F.coalesce("n", F.lit(0)).alias("n_orders"), "latest", "has_orders")


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def sql_view_scan(spark: SparkSession, d: str) -> DataFrame:
    """An SQL statement over a table as a view."""
    return sql_view(table(spark, d, "orders"), "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_value FROM {rows} WHERE o_orderstatus = 'F' GROUP BY 1")


@query()
def calibration_line(spark: SparkSession, d: str) -> DataFrame:
    """Intercept and slope of large orders on the logit of a probability from their priority and customer, with the mean gap."""
    o = table(spark, d, "orders", "o_custkey", "o_orderpriority", "o_totalprice")
    rows = o.select((F.col("o_totalprice") > 250000).cast("double").alias("y"), S.sigmoid(F.substring("o_orderpriority", 1, 1).cast("int") / 5 - F.col("o_custkey") % 7 / 7).alias("p"))
    intercept, slope = M.calibration_line(rows, "p", "y")
    return rows.agg(F.count("*").alias("n"), (F.avg("p") - F.avg("y")).alias("gap")).select("n", F.lit(intercept).alias("intercept"), F.lit(slope).alias("slope"), "gap")
