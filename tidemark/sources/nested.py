"""Nested events as variants: parsed once, read by path, arrays exploded with their places, and what they refer to looked up.

A variant keeps whatever a document holds, so events of different kinds need no common schema; a field that is absent, or of
another kind than asked for, is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, text: str, name: str = "doc") -> DataFrame:
    """df with the JSON text as a variant; null where it isn't JSON."""
    return df.withColumn(name, F.try_parse_json(F.col(text)))


def picked(df: DataFrame, doc: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """df with a column for each name: (path, type), such as ('$.shot.end[0]', 'double')."""
    return df.withColumns({name: F.try_variant_get(F.col(doc), path, kind) for name, (path, kind) in fields.items()})


def exploded(df: DataFrame, doc: str, path: str, keep: list[str], name: str = "item") -> DataFrame:
    """keep, pos and item (a variant) of each element of the array at the path; documents without it have no rows."""
    rows = df.select(*keep, F.try_variant_get(F.col(doc), path, "variant").alias("__v")).where("__v is not null")
    names = ", ".join(f"`{k}`" for k in keep)
    return df.sparkSession.sql(f"SELECT {names}, e.pos AS pos, e.value AS `{name}` FROM {{rows}}, LATERAL variant_explode(__v) AS e", rows=rows)


def field_paths(df: DataFrame, doc: str) -> DataFrame:
    """One row: schema, the merged schema of all documents, as text."""
    return df.agg(F.schema_of_variant_agg(F.col(doc)).alias("schema"))


def looked_up(events: DataFrame, key: str, reference: str, values: list[str], prefix: str = "ref_") -> DataFrame:
    """events with the values of the event that each refers to by its key, null without one. Keys that repeat match nothing: they name no single event."""
    once = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"), *[F.first(v).alias(f"{prefix}{v}") for v in values]).where("__n = 1")
    side = once.select(F.col(key).alias("__key"), *[f"{prefix}{v}" for v in values])
    return events.join(side, F.col(reference) == F.col("__key"), "left").drop("__key")
