"""Queries through files, saved models and streams: what is written and read back, or streamed, against the same from the tables."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import models as M
from tidemark.sources import models as saved
from tidemark.sources import tables as S
from tidemark.sources.keyed import KeyedTable
from tidemark.sources.scratch import new_folder
from tidemark.sources.tables import table
from tidemark.streaming import events as E

SQL: dict[str, str] = {}


def text_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Customers written as CSV and read back as text, some columns of it; a null comes back as an empty text."""
    at = new_folder(spark)
    rows = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")))
    S.write_csv(rows, at)
    return S.read_text_csv(spark, at, rows.columns, ["c_custkey", "c_name", "c_mktsegment"])


SQL["text_csv_round_trip"] = "SELECT c_custkey::VARCHAR AS c_custkey, c_name, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment ELSE '' END AS c_mktsegment FROM customer"


def marked_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers in CSV files that begin with a byte-order mark, read back with their first column under its own name."""
    at = new_folder(spark)
    s = table(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey")
    lines = s.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.concat_ws(",", "s_suppkey", "s_name", "s_nationkey"))).alias("lines"))  # a nation's suppliers are one file
    text = F.concat(F.lit("﻿s_suppkey,s_name,s_nationkey\n"), F.array_join("lines", "\n"))
    lines.select(text.alias("value"), "s_nationkey").write.partitionBy("s_nationkey").text(at)
    back = S.read_text_csv(spark, f"{at}/s_nationkey=*", s.columns)
    return back.select(F.col("s_suppkey").try_cast("bigint").alias("s_suppkey"), "s_name", F.col("s_nationkey").try_cast("int").alias("s_nationkey")).where("s_suppkey is not null")


SQL["marked_csv_round_trip"] = "SELECT s_suppkey, s_name, s_nationkey FROM supplier"


def typed_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Lines written as CSV with some broken cells, read with a stated schema: cells that don't fit are null, their rows stay."""
    at = new_folder(spark)
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    S.write_csv(rows.withColumn("l_quantity", F.when(F.col("l_orderkey") % 50 == 0, "many").otherwise(F.col("l_quantity").cast("string"))), at)
    back = S.read_typed_csv(spark, at, "l_orderkey bigint, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz")
    return back.groupBy(F.year("l_shipdate").alias("year"), "l_linenumber").agg(F.count("*").alias("n"), F.count("l_quantity").alias("n_quantity"), F.sum("l_quantity").alias("quantity"), F.max("l_shipdate").alias("last"))


SQL["typed_csv_round_trip"] = """
SELECT year(l_shipdate)::INTEGER AS year, l_linenumber, count(*) AS n, count(CASE WHEN l_orderkey % 50 <> 0 THEN 1 END) AS n_quantity, sum(CASE WHEN l_orderkey % 50 <> 0 THEN l_quantity END) AS quantity, max(l_shipdate) AS last FROM lineitem GROUP BY 1, 2"""


def season_file_totals(spark: SparkSession, d: str) -> DataFrame:
    """Orders in a file for each status and season: the season from the file's name, the status's facts joined from a table of files."""
    at = new_folder(spark)
    orders = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice")
    first = F.year("o_orderdate") - (F.month("o_orderdate") < 7).cast("int") + 10  # so that all years are of this century
    season = F.concat_ws("_", first, first + 1)
    orders.where(first.between(2000, 2098)).withColumns({"league": F.col("o_orderstatus"), "season": season}).select("o_orderkey", "o_totalprice", "league", "season").write.partitionBy("league", "season").option("header", True).csv(at)
    leagues = spark.createDataFrame([("F", "final", "A"), ("O", "open", "B"), ("P", "pending", "B")], "league string, title string, tier string")
    files = S.read_season_files(spark, f"{at}/*/*/*.csv", ["o_orderkey", "o_totalprice"])
    told = S.with_file_facts(files, r"league=([^/]+)/", leagues, "league")
    return told.groupBy("title", "tier", "season_start").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").try_cast("double")), 2).alias("total"))


SQL["season_file_totals"] = """
WITH o AS (SELECT *, year(o_orderdate) - CASE WHEN month(o_orderdate) < 7 THEN 1 ELSE 0 END + 10 AS s FROM orders)
SELECT CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'pending' END AS title, CASE o_orderstatus WHEN 'F' THEN 'A' ELSE 'B' END AS tier, s::INTEGER AS season_start, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM o WHERE s BETWEEN 2000 AND 2098 GROUP BY ALL"""


def nested_json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Customers with their orders as nested JSON, one array of records a nation; read with a schema and flattened by path."""
    at = new_folder(spark)
    orders = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderkey").alias("last"))
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    record = F.struct(F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.struct("n", "total", "last").alias("orders")).alias("who"))
    texts = c.select(F.col("c_nationkey").alias("nation"), F.pmod("c_custkey", F.lit(16)).alias("part"), F.to_json(record).alias("j")).groupBy("nation", "part").agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value"))
    texts.write.partitionBy("nation", "part").text(at)
    back = S.read_nested_json(spark, f"{at}/*/*", "id bigint, who struct<name: string, orders: struct<n: bigint, total: double, last: bigint>>")
    return S.flattened(back.drop("source_file"))


SQL["nested_json_round_trip"] = """
WITH o AS (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS last FROM orders GROUP BY 1)
SELECT c_custkey AS id, c_name AS who_name, n AS who_orders_n, total AS who_orders_total, last AS who_orders_last FROM customer LEFT JOIN o ON o_custkey = c_custkey"""


def three_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Large, urgent and open orders as three outputs of one pass, read back and counted; an order may be in several."""
    at = new_folder(spark)
    orders = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    S.write_parts(orders, at, {"large": F.col("o_totalprice") > 250000, "urgent": F.col("o_orderpriority").startswith("1"), "open": F.col("o_orderstatus") == "O"})
    return spark.read.parquet(at).groupBy("output").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 2).alias("total"))


SQL["three_outputs"] = """
WITH a AS (SELECT 'large' AS output, * FROM orders WHERE o_totalprice > 250000 UNION ALL SELECT 'urgent', * FROM orders WHERE starts_with(o_orderpriority, '1') UNION ALL SELECT 'open', * FROM orders WHERE o_orderstatus = 'O')
SELECT output, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS total FROM a GROUP BY 1"""


def manifest_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Texts of part brands, one file each, with the bytes and SHA-256 that a manifest gives them."""
    at = new_folder(spark)
    names = table(spark, d, "part", "p_brand", "p_partkey").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("p_partkey")), ",").alias("value"))  # a brand is one file
    names.withColumn("brand", F.col("p_brand")).select("value", "brand").write.partitionBy("brand").text(at)
    files = S.file_manifest(spark, f"{at}/*/*.txt")
    return files.select(F.url_decode(F.regexp_extract("path", "brand=([^/]*)/", 1)).alias("brand"), "bytes", "sha256")


SQL["manifest_of_files"] = """
WITH t AS (SELECT p_brand AS brand, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) || chr(10) AS v FROM part GROUP BY 1) SELECT brand, length(v)::BIGINT AS bytes, sha256(v) AS sha256 FROM t"""


def saved_model_scores(spark: SparkSession, d: str) -> DataFrame:
    """A line of the price by the quantity, fitted, saved with its preprocessor, loaded and applied: mean prediction and error by flag."""
    at = new_folder(spark)
    lines = table(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice")
    pre = M.fit_preprocessor(lines, ["l_quantity"], [])
    saved.save_model(spark, M.ridge(pre.transform(lines), "l_extendedprice", 0.0), pre, at, {"rows": "all"})
    model, pre, _ = saved.load_model(spark, LinearRegressionModel, at)
    out = model.transform(pre.transform(lines))
    return out.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("prediction"), 3).alias("predicted"), F.round(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("l_extendedprice"), F.lit(2)))), 3).alias("rmse"))


SQL["saved_model_scores"] = """
WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(avg(a + b * l_quantity), 3) AS predicted, round(sqrt(avg((a + b * l_quantity - l_extendedprice) ** 2)), 3) AS rmse FROM lineitem, m GROUP BY 1"""


def preprocessed_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as the preprocessor gives them: medians for what is missing, flags, levels, all scaled."""
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus").withColumn("price", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    pre = M.fit_preprocessor(o, ["price"], ["o_orderstatus"])
    return o.select("o_orderkey", *[F.round(x, 6).alias(n.lower()) for n, x in zip(pre.names(), pre.expressions(), strict=True)])


SQL["preprocessed_orders"] = """
WITH o AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS p FROM orders), m AS (SELECT quantile_cont(p, 0.5) AS m FROM o),
x AS (SELECT o_orderkey, coalesce(p, m) AS price, (p IS NULL)::INT::DOUBLE AS missing, (o_orderstatus = 'F')::INT::DOUBLE AS f, (o_orderstatus = 'O')::INT::DOUBLE AS o, (o_orderstatus = 'P')::INT::DOUBLE AS q FROM o, m),
s AS (SELECT avg(price) AS a1, stddev_pop(price) AS s1, avg(missing) AS a2, stddev_pop(missing) AS s2, avg(f) AS a3, stddev_pop(f) AS s3, avg(o) AS a4, stddev_pop(o) AS s4, avg(q) AS a5, stddev_pop(q) AS s5 FROM x)
SELECT o_orderkey, round((price - a1) / s1, 6) AS price, round((missing - a2) / s2, 6) AS price__missing, round((f - a3) / s3, 6) AS o_orderstatus__f, round((o - a4) / s4, 6) AS o_orderstatus__o, round((q - a5) / s5, 6) AS o_orderstatus__p FROM x, s"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return E.read_events(spark, f"{d}/events.parquet*")


def _run(stream, at: str) -> None:  # noqa: ANN001
    stream.option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()


def streamed_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of events by day and type as a stream, each batch upserted into a keyed table by window; the table as it stands at the end."""
    at = new_folder(spark)
    held = KeyedTable(spark, f"{at}/table", "start timestamp, event_type string, n_events long, total double", ["start", "event_type"], ["n_events"], buckets=8)
    _run(E.tumbling(_events(spark, d)).writeStream.outputMode("update").foreachBatch(held.sink("counts")), at)
    return held.read().select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n_events", F.round("total", 4).alias("total"))


SQL["streamed_daily_counts"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def streamed_spells(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal event types of a user, in event time and ended by pauses of half an hour, that a stream has closed once the watermark stands an hour before the last event."""
    at = new_folder(spark)
    _run(E.ordered_spells(_events(spark, d).select("event_id", "ts", "user_id", "event_type")).writeStream.format("parquet").option("path", f"{at}/spells"), at)
    return spark.read.schema(E.SPELLS).parquet(f"{at}/spells")


SQL["streamed_spells"] = """
WITH m AS (SELECT (epoch_ms(max(ts)) - 3600000) * 1000 AS mark FROM events), e AS (SELECT events.*, mark FROM events, m WHERE epoch_us(ts) <= mark),
c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
r AS (SELECT user_id, run, min(event_type) AS event_type, count(*) AS n_events, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id, max(epoch_us(ts)) AS last, any_value(mark) AS mark, max(run) OVER (PARTITION BY user_id) AS final FROM i GROUP BY 1, 2)
SELECT user_id, event_type, n_events, first_id, last_id FROM r WHERE run < final OR mark - last > 1800000000"""


def streamed_view_joins(spark: SparkSession, d: str) -> DataFrame:
    """Purchases joined in a stream with the user's views in the hour before."""
    at = new_folder(spark)
    kind = lambda k: _events(spark, d).where(F.col("event_type") == k)
    _run(E.paired(kind("purchase"), kind("view")).writeStream.format("parquet").option("path", f"{at}/pairs"), at)
    return spark.read.parquet(f"{at}/pairs").select("left_id", "right_id")


SQL["streamed_view_joins"] = """
SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'view' AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 1 HOUR WHERE a.event_type = 'purchase'"""


def pushed_id_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lines of small red parts, or of suppliers with their numbers, with the ids in the scan's own filter."""
    parts = table(spark, d, "part", "p_partkey", "p_size", "p_name").where("p_size = 1 and p_name like 'red%'").select(F.col("p_partkey").alias("id"))
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return S.scan_filter(lines, parts, ["l_partkey", "l_suppkey"])


SQL["pushed_id_filter"] = """
WITH i AS (SELECT p_partkey AS id FROM part WHERE p_size = 1 AND p_name LIKE 'red%') SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_partkey IN (SELECT id FROM i) OR l_suppkey IN (SELECT id FROM i)"""


def field_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Each column of the joined order table with its role and whether it may be a feature, and how many values it has."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    later = o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("next_order_date"))
    joined = o.join(later, "o_custkey").select("o_orderkey", "o_custkey", "o_orderdate", "next_order_date", F.col("o_totalprice").alias("target_price"))
    told = S.field_dictionary(joined, {"o_orderkey": "key", "o_custkey": "key", "target_price": "target"})
    counts = joined.agg(*[F.count_distinct(c).alias(c) for c in joined.columns]).unpivot([], joined.columns, "column_name", "n_values")
    return told.join(counts, "column_name").select("column_name", "role", "leakage", "n_values")


SQL["field_leakage"] = """
WITH l AS (SELECT o_custkey, max(o_orderdate) AS m FROM orders GROUP BY 1), j AS (SELECT * FROM orders JOIN l USING (o_custkey))
SELECT 'o_orderkey' AS column_name, 'key' AS role, 'names the row' AS leakage, count(DISTINCT o_orderkey) AS n_values FROM j UNION ALL SELECT 'o_custkey', 'key', 'names the row', count(DISTINCT o_custkey) FROM j
UNION ALL SELECT 'o_orderdate', 'value', 'known before the anchor', count(DISTINCT o_orderdate) FROM j UNION ALL SELECT 'next_order_date', 'value', 'known only afterwards', count(DISTINCT m) FROM j UNION ALL SELECT 'target_price', 'target', 'known only afterwards', count(DISTINCT o_totalprice) FROM j"""


QUERIES = {
    f.__name__: f
    for f in (text_csv_round_trip, marked_csv_round_trip, typed_csv_round_trip, season_file_totals, nested_json_round_trip, three_outputs, manifest_of_files, saved_model_scores, preprocessed_orders, streamed_daily_counts, streamed_spells, streamed_view_joins, pushed_id_filter, field_leakage)
}
