"""Streams over the events table against their batch twins."""

import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.plans import point_in_time as P
from tidemark.streaming import events as E

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("events")
    shutil.copy(f"{FOLDER}/events.parquet", out / "events.parquet")
    return str(out)


def test_tumbling_matches_batch(spark, folder):
    got = E.drained(E.tumbling(E.read_events(spark, folder)), "tumbled", "complete")
    want = P.window_batch_counts(spark, FOLDER)
    key = lambda df, day: sorted((r[0], r[1], r[2]) for r in df.select(day, "event_type", "n_events").collect())
    assert key(got, F.date_format("start", "yyyy-MM-dd")) == key(want, F.col("day"))


def test_sessions_and_sliding(spark, folder):
    per = E.drained(E.sessions(E.read_events(spark, folder)), "sessions", "complete").groupBy("user_id").agg(F.count("*").alias("n"))
    assert {r.user_id: r.n for r in per.collect()} == {r.user_id: r.n_sessions for r in P.session_counts(spark, FOLDER).collect()}
    slid = E.drained(E.sliding(E.read_events(spark, folder)), "slid", "complete")
    assert slid.agg(F.sum("n_events")).first()[0] == 7 * 1000


def test_spells_are_emitted_when_closed(spark, folder):
    got = {(r.user_id, r.first_id): r.n_events for r in E.drained(E.spells(E.read_events(spark, folder)), "spells").collect()}
    runs = P.spell_islands(spark, FOLDER)
    last = runs.groupBy("user_id").agg(F.max("island").alias("island"))
    want = {(r.user_id, r.first_id): r.n_events for r in runs.join(last, ["user_id", "island"], "left_anti").collect()}
    assert got == want


def test_upsert_sink(spark, tmp_path):
    sink = E.upsert_sink(str(tmp_path), ["k"], ["o"])
    sink(spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k int, o int, v string"), 0)
    for _ in range(2):  # a repeated batch changes nothing
        sink(spark.createDataFrame([(1, 2, "c"), (2, 0, "d"), (3, 1, "e")], "k int, o int, v string"), 1)
    assert {r.k: r.v for r in spark.read.parquet(f"{tmp_path}/version=1").collect()} == {1: "c", 2: "b", 3: "e"}


def test_static_enrichment(spark, folder):
    users = spark.createDataFrame([(1, "x")], "user_id long, tag string")
    assert E.drained(E.enrich(E.read_events(spark, folder), users, "user_id"), "enriched").count() == 1000


def test_two_streams_match_the_batch_join(spark, folder):
    of = lambda kind: E.read_events(spark, folder).where(F.col("event_type") == kind)
    got = sorted(tuple(r) for r in E.drained(E.paired(of("purchase"), of("view"), "12 hours"), "paired").select("left_id", "right_id").collect())
    e = spark.read.parquet(f"{folder}/events.parquet")
    a, b = e.where("event_type = 'purchase'").alias("a"), e.where("event_type = 'view'").alias("b")
    near = F.expr("a.user_id = b.user_id and b.ts <= a.ts and b.ts >= a.ts - interval 12 hours")
    assert got and got == sorted(tuple(r) for r in a.join(b, near).select("a.event_id", "b.event_id").collect())


def test_ordered_spells_equal_batch_under_shuffled_arrival(spark, tmp_path):
    """Events that arrive out of order within the lateness give the runs of the batch, and the last run of each user ends."""
    import random
    from datetime import datetime, timedelta


    from tidemark.streaming import events as E

    g, start = random.Random(7), datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=40 * i + g.randrange(30)), g.choice([1, 1, 2, 3]), g.choice(["a", "a", "b"])) for i in range(240)]
    rows += [(900, start + timedelta(hours=9), 1, "a")]  # a pause, then a run of its own
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    arrival = sorted(rows, key=lambda r: (r[1] + timedelta(minutes=g.randrange(45))))
    end = [(999, start + timedelta(days=3), 77, "z")]  # moves the watermark past everything
    source = str(tmp_path / "in")
    for k, part in enumerate([*[arrival[i : i + 61] for i in range(0, len(arrival), 61)], end]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{source}/part={k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    got = sorted(map(tuple, E.drained(E.ordered_spells(stream.select("event_id", "ts", "user_id", "event_type")), "ordered").collect()))
    want = []
    for user in (1, 2, 3):
        run = []
        for r in sorted(x for x in [(r[1], r[0], r[3]) for r in rows if r[2] == user]):
            if run and (r[2] != run[-1][2] or (r[0] - run[-1][0]).total_seconds() > 1800):
                want.append((user, run[0][2], len(run), run[0][1], run[-1][1]))
                run = []
            run.append(r)
        want.append((user, run[0][2], len(run), run[0][1], run[-1][1]))
    assert got == sorted(want)
