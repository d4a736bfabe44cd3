"""Fitted models kept with their preprocessor and a manifest of every file's size and SHA-256."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.models import Preprocessor
from tidemark.sources.tables import file_manifest


def _files(spark: SparkSession, path: str) -> DataFrame:
    """name (below the folder), bytes and sha256 of each file of the model and its preprocessor."""
    parts = [file_manifest(spark, f"{path}/{x}") for x in ("model/metadata", "model/data", "preprocessor")]
    files = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return files.select(F.regexp_extract("path", r"/((?:model/metadata|model/data|preprocessor)/[^/]*)$", 1).alias("name"), "bytes", "sha256")


def save_model(spark: SparkSession, model, pre: Preprocessor, path: str, facts: dict[str, str] | None = None) -> None:  # noqa: ANN001
    """The model in Spark's own format, the preprocessor as JSON, and a manifest with facts such as the cutoff of the training rows."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(asdict(pre)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/preprocessor")
    pairs = [x for k, v in (facts or {}).items() for x in (F.lit(k), F.lit(v))]
    note = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    _files(spark, path).withColumn("facts", note).write.mode("overwrite").json(f"{path}/manifest")


def load_model(spark: SparkSession, kind: type, path: str) -> tuple[object, Preprocessor, dict[str, str]]:
    """Model, preprocessor and facts; raises if any file isn't what the manifest says."""
    said = spark.read.schema("name string, bytes long, sha256 string, facts map<string,string>").json(f"{path}/manifest")
    other = _files(spark, path).join(said.select("name", F.col("sha256").alias("said")), "name", "full").where(~F.col("sha256").eqNullSafe(F.col("said"))).first()
    if other is not None:
        raise ValueError(f"{path}: {other.name} isn't the file that was saved")
    d = json.loads(spark.read.text(f"{path}/preprocessor").first().value)
    pre = Preprocessor(tuple(tuple(c) for c in d["columns"]), d["medians"], {k: tuple(v) for k, v in d["levels"].items()})
    return kind.load(f"{path}/model"), pre, said.first().facts or {}
