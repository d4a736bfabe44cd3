"""A keyed table in files: an upsert rewrites only the buckets that its batch touches, is seen whole or not at all, and may be repeated.

Rows are dealt into a fixed number of buckets by a hash of the key. A bucket's rows are the Parquet files of one folder, and a manifest names
the folder of each bucket. An upsert reads and rewrites the buckets of its keys into new folders and then writes the next
manifest under a name that must not exist yet, so readers see the state before or after, and of two writers one fails. The
manifest keeps the number of the last batch of each writer; a batch that was applied is skipped, so a stream may send it again.
Folders that no manifest names, left by a failed upsert or replaced by a later one, are dropped by vacuum().
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: list[str], order: list[str], buckets: int = 64) -> None:
        """order: of several rows of a key the last in this order stays; of equal ones that of the later batch."""
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self) -> dict:
        """version, buckets (bucket: folder) and batches (writer: last batch)."""
        versions = self._manifests()
        if not versions:
            return {"version": 0, "buckets": {}, "batches": {}, "n": self.buckets}
        stream = self._fs.open(self._path(f"{self.path}/manifests/{versions[-1]:012d}.json"))
        try:
            told = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        if told["n"] != self.buckets:
            raise ValueError(f"the table has {told['n']} buckets, not {self.buckets}")
        return told

    def read(self) -> DataFrame:
        return self._read(list(self.manifest()["buckets"].values()))

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def upsert(self, batch: DataFrame, batch_id: int | None = None, writer: str = "") -> bool:
        """Rows of the batch in place of, or beside, those of their keys; False if this batch of the writer was applied before.

        Keys may be null, and equal nulls are one key. Rows older than what stands under their key don't count.
        """
        state = self.manifest()
        if batch_id is not None and state["batches"].get(writer, -1) >= batch_id:
            return False
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        names = self.schema.fieldNames()
        fresh = batch.select(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in names]).persist()
        try:
            touched = [str(r.b) for r in fresh.select(bucket.alias("b")).distinct().collect()]  # at most the number of buckets
            old = self._read([f for b, f in state["buckets"].items() if b in touched])
            both = old.withColumn("__turn", F.lit(0)).unionByName(fresh.withColumn("__turn", F.lit(1)))
            best = Window.partitionBy(*self.key).orderBy(*[F.desc_nulls_last(o) for o in self.order], F.desc("__turn"), F.xxhash64(*names))
            rows = both.withColumn("__at", F.row_number().over(best)).where("__at = 1").drop("__at", "__turn").withColumn("__bucket", bucket)
            folder = f"data/{state['version'] + 1:012d}-{uuid.uuid4().hex}"
            if touched:
                rows.repartition(min(len(touched), self.buckets), "__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        finally:
            fresh.unpersist()
        after = {"version": state["version"] + 1, "n": self.buckets, "buckets": state["buckets"] | {b: f"{folder}/__bucket={b}" for b in touched}, "batches": dict(state["batches"])}
        if batch_id is not None:
            after["batches"][writer] = batch_id
        self._publish(after)
        return True

    def _publish(self, state: dict) -> None:
        """The manifest appears whole, under a name that nobody has taken."""
        name = f"{self.path}/manifests/{state['version']:012d}.json"
        draft = self._path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        finally:
            out.close()
        self._fs.mkdirs(self._path(f"{self.path}/manifests"))
        if self._fs.exists(self._path(name)) or not self._fs.rename(draft, self._path(name)):
            raise RuntimeError(f"another writer has made version {state['version']}")

    def vacuum(self) -> int:
        """Drops what the latest manifest doesn't name; no reader or writer may be under way. Returns how many folders went."""
        state = self.manifest()
        named = set(state["buckets"].values())
        gone = 0
        data = self._path(f"{self.path}/data")
        for version in self._fs.listStatus(data) if self._fs.exists(data) else []:
            left = 0
            for bucket in self._fs.listStatus(version.getPath()):
                folder = f"data/{version.getPath().getName()}/{bucket.getPath().getName()}"
                if folder in named:
                    left += 1
                elif bucket.isDirectory():
                    gone += bool(self._fs.delete(bucket.getPath(), True))
            if not left:
                self._fs.delete(version.getPath(), True)
        for v in self._manifests()[:-1]:
            self._fs.delete(self._path(f"{self.path}/manifests/{v:012d}.json"), False)
        return gone

    def sink(self, writer: str):  # noqa: ANN201
        """What foreachBatch calls: each batch once, however often it is sent."""
        return lambda batch, batch_id: self.upsert(batch, batch_id, writer) and None
