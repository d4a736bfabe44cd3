"""Cleaning of text tables: dates, numbers and identifiers from loosely written cells, counts of what didn't fit, profiles, names."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S

#: The ways in which a date may be written.
DATE_FORMATS = ("yyyy-M-d HH:mm:ss", "yyyy-M-d", "yyyy/M/d", "d/M/yyyy", "MMM d, yyyy", "d MMM yyyy")
#: Words that stand for a missing value in a profile.
MISSING_WORDS = ("", "na", "n/a", "null", "none", "nan", "nat")
#: Names of columns that hold dates and identifiers.
DATE_NAME, ID_NAME = r"(?i)(^date$|_date$|date_|birth|expiration)", r"(?i)(^|_)id$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: Letters that UTF-8 text shows when it was read as a one-byte code.
MOJIBAKE = "[ÂÃ][\u0080-¿]|â€|�"


def parse_date(c: Column) -> Column:
    """The date of a text in the first of the formats that fits; null if none does."""
    t = F.trim(c)
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in DATE_FORMATS]).cast("date")


def parse_number(c: Column) -> Column:
    """Double of a text that is a decimal number and nothing else."""
    t = F.trim(c)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def parse_whole(c: Column) -> Column:
    """A whole number, also written '7.0'; fractions become null, not rounded."""
    x = parse_number(c)
    return F.when((x == F.floor(x)) & (F.abs(x) < float(2**63)), x.cast("bigint"))


def _present(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def typed(df: DataFrame, dates: list[str] = [], wholes: list[str] = [], numbers: list[str] = []) -> DataFrame:  # noqa: B006
    """df with text columns trimmed, blank ones null, and the named ones typed; what doesn't fit is null."""
    how = {**dict.fromkeys(dates, parse_date), **dict.fromkeys(wholes, parse_whole), **dict.fromkeys(numbers, parse_number)}
    texts = {c for c, t in df.dtypes if t == "string"}
    return df.select([(how[c](_present(F.col(c))) if c in how else _present(F.col(c)) if c in texts else F.col(c)).alias(c) for c in df.columns])


def cleaning_counts(df: DataFrame, dates: list[str] = [], wholes: list[str] = [], numbers: list[str] = []) -> DataFrame:  # noqa: B006
    """column_name, n_rows, n_blank, n_trimmed and n_invalid of each text column; one pass, one row of counts a task."""
    how = {**dict.fromkeys(dates, parse_date), **dict.fromkeys(wholes, parse_whole), **dict.fromkeys(numbers, parse_number)}
    texts = [c for c, t in df.dtypes if t == "string"]
    there = {c: _present(F.col(c)) for c in texts}
    aggs = []
    for c in texts:
        bad = F.count_if(there[c].isNotNull() & how[c](there[c]).isNull()) if c in how else F.lit(0).cast("bigint")
        aggs.append(F.struct(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_rows"), F.count_if(there[c].isNull()).alias("n_blank"), F.count_if(F.col(c) != F.trim(F.col(c))).alias("n_trimmed"), bad.alias("n_invalid")))
    return df.agg(F.array(*aggs).alias("all")).select(F.explode("all").alias("r")).select("r.*")


def text_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: rows, missing words, parse rates, different values, zeros, negatives, extremes, lengths, the
    commonest value (of equally common ones the greatest) and the inferred type.

    Values are counted first, partly before the shuffle, so each different value is parsed once.
    """
    long = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "v")
    v = F.trim(F.col("v"))
    seen = long.select("column_name", F.when(~F.lower(v).isin(*MISSING_WORDS), v).alias("v")).groupBy("column_name", "v").agg(F.count("*").alias("n"))
    x, n = parse_number(F.col("v")), F.col("n")
    parsed = seen.select("*", x.alias("x"), (x == F.floor(x)).alias("whole"), parse_date(F.col("v")).isNotNull().alias("dated"))
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("bigint")
    there = F.col("v").isNotNull()
    out = parsed.groupBy("column_name").agg(
        F.sum(n).alias("n_rows"), total(~there).alias("n_null"), F.count("v").alias("n_distinct"), total(F.col("x").isNotNull()).alias("n_numeric"), total(F.col("whole")).alias("n_whole"), total(F.col("dated")).alias("n_date"),
        total(F.col("x") == 0).alias("n_zero"), total(F.col("x") < 0).alias("n_negative"), F.min("x").alias("least"), F.max("x").alias("greatest"), F.min(F.length("v")).alias("shortest"), F.max(F.length("v")).alias("longest"),
        F.max(F.when(there, F.struct("n", "v")))["v"].alias("commonest"),
    )
    # fixed values: the names of the types and the shares of values that they need
    k, identifier = F.col("n_rows") - F.col("n_null"), F.col("column_name").rlike(ID_NAME)
    numeric = F.when(identifier, "identifier (numeric-coded)").when(F.col("n_whole") >= 0.995 * k, "integer").otherwise("decimal")
    kind = F.when(k == 0, "empty").when(F.col("column_name").rlike(DATE_NAME) & (F.col("n_date") >= 0.98 * k), "date/datetime").when(F.col("n_numeric") >= 0.995 * k, numeric).when(identifier, "identifier (text)").otherwise("text/categorical")
    return out.withColumn("inferred_type", kind)


def is_mojibake(c: Column) -> Column:
    """Whether a text shows the marks of a wrong decoding."""
    return c.rlike(MOJIBAKE)


#: The words that signs in column names become.
SIGNS = {"%": "pct", "&": "and", "/": "per"}


def snake_case(name: str) -> str:
    """'Goals/90 %' as 'goals_per_90_pct', 'xG P 90' as 'xg_per90': letters and digits as they are, three signs as words, and a rate by 90 as one word."""
    words: list[str] = []
    for token in re.findall("[%&/]|[a-z0-9]+", name.lower()):
        if words[-1:] == ["p"] and token == "90":
            words.pop()
            token = "p90"
        words.append("per90" if token == "p90" else SIGNS.get(token, token))
    return "_".join(words)


def snake_columns(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """df with snake-case column names, those in names as given; a name that repeats gets the number of its place."""
    out, seen = [], set()
    for i, c in enumerate(df.columns):
        name = (names or {}).get(c, snake_case(c))
        name = f"{name}_{i + 1}" if name in seen else name
        seen.add(name)
        out.append(name)
    return df.toDF(*out)


# --- validation, geometry, closeness


def finite_positive(c: Column) -> Column:
    """The number if it is finite and above 0, else null."""
    x = S.finite(c.cast("double"))
    return F.when(x > 0, x)


def probability(c: Column) -> Column:
    """The number if it is from 0 to 1, else null."""
    x = S.finite(c.cast("double"))
    return F.when(x.between(0, 1), x)


def distance(x: Column, y: Column, end_x: Column, end_y: Column) -> Column:
    return F.hypot(end_x - x, end_y - y)


def enters(a: Column, b: Column, line: float) -> Column:
    """Whether a move from a to b crosses a line upwards."""
    return (a < line) & (b >= line)


def familiarity(*gaps: Column) -> Column:
    """100 for no gap, falling with the exponential of the mean absolute gap; null if any gap is."""
    return 100 * F.exp(-reduce(lambda a, b: a + b, [F.abs(g) for g in gaps]) / len(gaps))
