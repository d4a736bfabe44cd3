"""Folders for what a query writes and reads again: in the folder that the cluster names, never a machine's own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, as in tests, one of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir() or ""
    if not named:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-shared-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/tidemark-{uuid.uuid4().hex}"
