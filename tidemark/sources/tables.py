"""Readers and sinks: explicit schemas, no inference, and manifests that Spark derives from the files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table, only the named columns of it."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def sql_view(rows: DataFrame, statement: str) -> DataFrame:
    """An SQL statement over a frame, which stands in it as {rows}."""
    return rows.sparkSession.sql(statement, rows=rows)


def require_verified(spark: SparkSession, path: str, field: str = "verified") -> None:
    """Raises unless a JSON sidecar says that its data were verified."""
    first = spark.read.option("multiLine", True).json(path).first()
    if first is None or field not in first or first[field] is not True:
        raise ValueError(f"{path} isn't marked {field}")


def read_text_csv(spark: SparkSession, path: str, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """CSV with every column as text; an empty cell is '' and no null. A byte-order mark before the header is ignored."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").option("enforceSchema", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in keep or columns])


def read_typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a stated schema; cells that don't fit are null, and the row stays."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_season_files(spark: SparkSession, glob: str, columns: list[str]) -> DataFrame:
    """CSV files of many seasons, with the file's path and the first year named in it."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).csv(glob)
    path = F.col("_metadata.file_path")
    return df.select("*", path.alias("source_file"), F.regexp_extract(path, r"(20\d{2})_(20\d{2})", 1).try_cast("int").alias("season_start"))


def with_file_facts(files: DataFrame, pattern: str, facts: DataFrame, key: str) -> DataFrame:
    """files with the facts of the source (its league, currency and the like) that the pattern's first group finds in source_file.

    facts: one row for each key, a table of sources; a file of an unknown source gets nulls.
    """
    named = files.withColumn(key, F.regexp_extract("source_file", pattern, 1))
    return named.join(F.broadcast(facts), key, "left")  # a row for each source, not each file


def semi_filter(df: DataFrame, ids: DataFrame, id_columns: list[str]) -> DataFrame:
    """Rows of which any of the id columns is among the ids (column id). A union of semi-joins without repeats."""
    keys = ids.select(F.col("id").alias("__id")).distinct()
    out = df
    for i, c in enumerate(id_columns):
        out = out.join(keys.select(F.col("__id").alias(f"__id{i}")), F.col(c) == F.col(f"__id{i}"), "left")
    found = F.coalesce(*[F.col(f"__id{i}") for i in range(len(id_columns))]).isNotNull()
    return out.where(found).select(*df.columns)


def scan_filter(df: DataFrame, ids: DataFrame, id_columns: list[str], most: int = 5_000) -> DataFrame:
    """What semi_filter gives, with the ids in the scan's own filter where there are at most `most` different ones.

    The reader then drops rows before it makes them: Parquet skips row groups by their ranges, CSV stops parsing a line. More
    ids than that would not fit into a plan, and are joined. ids: column id.
    """
    kept = [r.id for r in ids.select("id").where("id is not null").distinct().limit(most + 1).collect()]  # at most a few thousand
    if len(kept) > most:
        return semi_filter(df, ids, id_columns)
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isin(kept) for c in id_columns])) if kept else df.where(F.lit(False))


LEAKAGE = ("known before the anchor", "known only afterwards", "names the row")


def leakage_rule(name: str, role: str, later: tuple[str, ...] = ("next_", "future_", "outcome", "target", "label")) -> str:
    """Whether a column may be a feature: names and targets may not, and what is measured after the anchor may not."""
    if role == "key":
        return LEAKAGE[2]
    return LEAKAGE[1] if role == "target" or any(x in name.lower() for x in later) else LEAKAGE[0]


def read_nested_json(spark: SparkSession, path: str, schema: str, file_column: str = "source_file") -> DataFrame:
    """One JSON array of records in each file; the file's name without its ending tells the records apart."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias(file_column))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_parts(df: DataFrame, path: str, parts: dict[str, Column]) -> None:
    """Several outputs from one pass: the rows that each condition holds for, in a folder output=<name>; a row may be in many."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in parts.items()]))
    df.withColumn("output", F.explode(names)).write.mode("overwrite").partitionBy("output").parquet(path)


def flattened(df: DataFrame, by: str = "_") -> DataFrame:
    """df with the fields of nested records as columns of their own, named by their path; arrays stay."""

    def leaves(c: Column, kind: T.DataType, name: str) -> list[Column]:
        if not isinstance(kind, T.StructType):
            return [c.alias(name)]
        return [x for f in kind.fields for x in leaves(c.getField(f.name), f.dataType, f"{name}{by}{f.name}")]

    return df.select(*[x for f in df.schema.fields for x in leaves(F.col(f"`{f.name}`"), f.dataType, f.name)])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def file_manifest(spark: SparkSession, glob: str) -> DataFrame:
    """path, bytes and SHA-256 of each file."""
    files = spark.read.format("binaryFile").load(glob)
    return files.select(F.col("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def field_dictionary(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """column_name, data_type, nullable, role and leakage rule of each column, from the schema and its metadata."""
    roles = roles or {}
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable, roles.get(f.name, f.metadata.get("role", "value"))) for i, f in enumerate(df.schema.fields)]
    rows = [(*r, leakage_rule(r[1], r[4])) for r in rows]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, data_type string, nullable boolean, role string, leakage string")


def to_json_rows(df: DataFrame, key: str) -> DataFrame:
    """key and the row as JSON, what isn't a finite number as null."""
    safe = [F.when(~F.isnan(f.name) & (F.abs(F.col(f.name)) != float("inf")), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields]
    return df.select(key, F.to_json(F.struct(*safe)).alias("payload"))
