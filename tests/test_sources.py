"""Keyed upserts and nested events."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.functions.cleaning import snake_case
from tidemark.sources import nested, tables
from tidemark.sources.keyed import KeyedTable

SCHEMA = "k int, v string, t int"


def held(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def files(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_upsert_rewrites_what_changed(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, SCHEMA, ["k"], ["t"], buckets=16)
    assert held(table) == []
    assert table.upsert(spark.range(2000).select(F.col("id").cast("int").alias("k"), F.lit("a" * 50).alias("v"), F.lit(1).alias("t")), 0, "w")
    first = files(path)
    batch = spark.createDataFrame([(3, "new", 2), (3, "newer", 3), (4, "old", 0), (5000, "more", 1), (None, "null", 1), (7, "tie", 1)], SCHEMA)
    assert table.upsert(batch, 1, "w") and not table.upsert(batch, 1, "w") and not table.upsert(batch, 0, "w")
    told = {r.k: r.v for r in table.read().collect()}
    assert (told[3], told[4], told[5000], told[None], told[7], len(told)) == ("newer", "a" * 50, "more", "null", "tie", 2002)
    added = sum(n for f, n in files(path).items() if f not in first)
    assert 0 < added < 0.6 * sum(first.values())  # five of sixteen buckets at most
    assert table.vacuum() > 0 and len(held(table)) == 2002
    assert {r.k: r.v for r in KeyedTable(spark, path, SCHEMA, ["k"], ["t"], buckets=16).read().collect()} == told
    with pytest.raises(ValueError):
        KeyedTable(spark, path, SCHEMA, ["k"], ["t"], buckets=8).read()


def test_failed_upsert_changes_nothing(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], ["t"], buckets=4)
    table.upsert(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], SCHEMA), 0)
    before = held(table)
    monkeypatch.setattr(table, "_publish", lambda state: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.upsert(spark.createDataFrame([(1, "c", 2)], SCHEMA), 1)
    assert held(table) == before
    monkeypatch.undo()
    assert table.upsert(spark.createDataFrame([(1, "c", 2)], SCHEMA), 1) and held(table) == [(1, "c", 2), (2, "b", 1)]
    behind = table.manifest()
    with pytest.raises(RuntimeError):
        table._publish(behind)  # another writer of the same version
    assert table.upsert(spark.createDataFrame([], SCHEMA), 2) and len(held(table)) == 2


def test_stream_into_keyed_table(spark, tmp_path):
    """Two runs of a stream, the second from the same checkpoint, hold each key's latest row once."""
    source, table = str(tmp_path / "in"), KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"], ["t"], buckets=4)
    for rows in ([(1, "a", 1), (2, "b", 1)], [(1, "c", 5), (3, "d", 2)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        q = spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(table.sink("s")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert held(table) == [(1, "c", 5), (2, "b", 1), (3, "d", 2)]


def test_nested_events(spark):
    texts = [(1, '{"events":[{"id":7,"type":"pass","end":[3.5,4]},{"id":8,"type":"shot","key":7,"end":"none"}]}'), (2, '{"events":[]}'), (3, "not json"), (4, None), (5, '{"events":3}')]
    docs = nested.parsed(spark.createDataFrame(texts, "m int, text string"), "text")
    items = nested.picked(nested.exploded(docs, "doc", "$.events", ["m"]), "item", {"id": ("$.id", "int"), "type": ("$.type", "string"), "x": ("$.end[0]", "double"), "of": ("$.key", "int")})
    got = nested.looked_up(items.drop("item"), "id", "of", ["type", "x"])
    assert sorted(map(tuple, got.select("m", "pos", "id", "type", "x", "of", "ref_type", "ref_x").collect())) == [(1, 0, 7, "pass", 3.5, None, None, None), (1, 1, 8, "shot", None, 7, "pass", 3.5)]
    twice = spark.createDataFrame([(1, 2, "a"), (2, None, "b"), (2, None, "c")], "id int, of int, type string")
    assert [r.ref_type for r in nested.looked_up(twice, "id", "of", ["type"]).orderBy("type").collect()] == [None, None, None]
    assert "type" in nested.field_paths(docs.where("m < 3"), "doc").first().schema


@pytest.mark.parametrize("most", [5000, 2])
def test_scan_filter_both_ways(spark, tmp_path, most):
    path = str(tmp_path / "t")
    rows = spark.range(10_000).select("id", (F.col("id") * 7 % 1000).alias("b"))
    rows.coalesce(1).sortWithinPartitions("id").write.option("parquet.block.size", 16_384).parquet(path)
    ids = spark.createDataFrame([(5,), (6,), (6,), (9000,), (None,)], "id long")
    found = tables.scan_filter(spark.read.parquet(path), ids, ["id", "b"], most)
    assert sorted(r.id for r in found.collect()) == [r.id for r in rows.where("id in (5, 6, 9000) or b in (5, 6)").orderBy("id").collect()]
    assert ("PushedFilters: [Or(In" in found._jdf.queryExecution().toString()) == (most > 2)
    assert tables.scan_filter(rows, ids.limit(0), ["id"], most).count() == 0


def test_scan_filter_reaches_csv(spark, tmp_path):
    path = str(tmp_path / "c")
    tables.write_csv(spark.range(1000), path)
    found = tables.scan_filter(tables.read_typed_csv(spark, path, "id long"), spark.createDataFrame([(7,), (70,)], "id long"), ["id"])
    assert sorted(r.id for r in found.collect()) == [7, 70] and "PushedFilters: [In(id" in found._jdf.queryExecution().toString()


def test_names_of_columns_and_what_may_be_a_feature(spark):
    assert [snake_case(x) for x in ("Goals/90 %", "xG P 90", "xG p90", "A & B", " P 91", "%%")] == ["goals_per_90_pct", "xg_per90", "xg_per90", "a_and_b", "p_91", "pct_pct"]
    told = tables.field_dictionary(spark.createDataFrame([(1, 2, 3, 4)], "k int, age int, next_club int, y int"), {"k": "key", "y": "target"})
    assert [r.leakage for r in told.orderBy("position").collect()] == ["names the row", "known before the anchor", "known only afterwards", "known only afterwards"]
