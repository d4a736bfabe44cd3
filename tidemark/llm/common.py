"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of whole texts that a Python task holds at a time.
TEXT_BATCH_ROWS = 1000
#: Most rows of (id, small payload) that are broadcast; larger sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Most edges (two longs each) whose components are found in one task; more are dealt out by shuffles.
EDGES_IN_ONE = 200_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds: texts may be long, so batches are short."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_BATCH_ROWS))


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text, a null text as an empty one; other columns go."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def map_texts(docs: DataFrame, per_text: Callable[[str], tuple], fields: str) -> DataFrame:
    """One row for each document: doc_id and what per_text returns for its text."""
    schema = T._parse_datatype_string(f"doc_id long, {fields}")
    arrow = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [per_text(t) for t in b.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in arrow.names[1:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(arrow)[1:], strict=True))], schema=arrow)

    return id_text(docs).mapInArrow(run, schema)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def arrow_batches(columns: Iterable[tuple[str, object, pa.DataType]], rows: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded length from whole columns."""
    cols = list(columns)
    n = len(cols[0][1])
    for i in range(0, n, rows):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + rows], t) for _, c, t in cols], names=[k for k, _, _ in cols])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it is unset, one of our own on a local master, as in tests.

    On a cluster an unset folder raises ValueError, as executors don't share a temporary folder of the driver.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir() or ""
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-shared-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir() or named
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder; Spark removes the files when nothing refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written to the shared folder, and dropped by name once the next step no longer reads them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            self._delete(self.paths.pop(id(df)))

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """df, marked for broadcast if it has no more than so many rows, and its row count. Larger ones are shuffled."""
    n = df.count()
    return (F.broadcast(df) if n <= rows else df), n


def told_apart(docs: DataFrame) -> DataFrame:
    """docs with twin: 0 where the doc_id stands once, else a hash of the text, so that (doc_id, twin) tells rows with other texts apart.

    Rows without a doc_id all have one. Rows equal in doc_id and text stay alike: they are one document.
    """
    own = F.col("doc_id").cast("long")
    again, _ = bounded(docs.select(own.alias("__tm_again")).where("__tm_again is not null").groupBy("__tm_again").count().where("count > 1").select("__tm_again"))
    keyed = docs.join(again, own == F.col("__tm_again"), "left")
    alone = F.col("doc_id").isNotNull() & F.col("__tm_again").isNull()
    return keyed.withColumn("twin", F.when(alone, F.lit(0)).otherwise(F.xxhash64(F.coalesce("text", F.lit(""))))).drop("__tm_again")


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the edges (a, b): the smallest node that it reaches.

    Alternating large-star and small-star rounds, each written to the shared folder; a node's neighbours are
    pre-aggregated to their minimum and joined back, never gathered in one task. A round of up to EDGES_IN_ONE counted edges
    stays in one partition and needs no shuffle. Loops and nulls are ignored. An empty edge table gives no rows.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a != b")
    pairs = scratch.keep(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    near = pairs.count() <= EDGES_IN_ONE  # rounds never add edges
    dealt = lambda df: df.coalesce(1) if near else df
    seen = None
    for _ in range(most_rounds):
        both = dealt(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        after = scratch.keep(dealt(small.unionByName(low.select("a", F.col("m").alias("b")))).distinct())
        scratch.drop(pairs)
        pairs = after
        now = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    roots = dealt(pairs).select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
