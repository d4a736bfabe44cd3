"""Line dedup: exact copies, and lines one edit apart by a deletion-neighbourhood join.

A line is told by its text without outer white space. It goes if an earlier line of the corpus, by doc_id and then by
place, is the same or is within one edit (a character put in, left out or changed). "Earlier" is judged on the input,
whether or not that line stays itself.

The neighbourhood of a line is the line itself and all lines with one character left out, each as a 64-bit hash. Equal
lengths: both lines leave out the same place and are equal then. Lengths that differ by one: one line as it is equals the
other without a character. Either key holds lines whose earliest member decides for all, so a group is reduced to its
minimum before and after the shuffle and never gathered. Lines that share no half with another line can't be one edit
from one, so only the others emit their neighbourhoods. Each match is verified by the edit distance of the two texts.

Defined cases: blank lines and lines shorter than `min_chars` always stay; those shorter than `near_chars` only go as exact
copies. A null text stays null, an empty one empty. A document that loses all its lines that aren't blank goes as a whole.
Rows with a null doc_id come last. Rows of one doc_id, or of none, are told apart by a hash of their texts, in its order;
rows equal in both are one document listed twice and get equal results. Lines are told by 64-bit hashes. Very long texts are
split like others. An empty table gives no rows. Other columns stay, whatever their names; n_chars, if there is one, follows
the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, Scratch, checkpointed, told_apart


#: Outer white space of a line.
WHITE = " \t\x0b\f\r"


@dataclass(frozen=True)
class Lines:
    #: Characters of the shortest line of which exact copies go.
    min_chars: int = 1
    #: Characters of the shortest line that goes for an earlier one within an edit.
    near_chars: int = 20


def lines_of(docs: DataFrame, rule: Lines) -> DataFrame:
    """place (doc_id, twin and number of the line) and line, without outer white space, for each line of min_chars or more. docs: with twin."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "twin", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    place = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "twin", "at")
    return rows.select(place.alias("place"), F.trim("line", F.lit(WHITE)).alias("line")).where(F.length("line") >= rule.min_chars)


def half_keys(line: Column) -> Column:
    """Four hashes: either half, cut as for the line's own length and as for one less."""
    n = F.length(line)
    keys = []
    for less in (0, 1):
        tag, pre = n - less, F.floor((n - less) / 2).cast("int")
        keys.append(F.xxhash64(tag, F.lit("p"), F.substring(line, F.lit(1), pre)))
        keys.append(F.xxhash64(tag, F.lit("s"), F.substring(line, n - (tag - pre) + 1, tag - pre)))
    return F.array(*keys)


_B = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def neighbourhood(line: str) -> tuple[int, np.ndarray, np.ndarray]:
    """The hash of the line, the hashes without each one character, and the latter with the place left out."""
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(code)
    power = np.cumprod(np.full(n + 1, _B, dtype=np.uint64))
    term = _mixed(code) * power[:n]
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
    # what stands behind the gap moves one place to the left: the same sum with the terms one power lower
    lower = _mixed(code[1:]) * power[: n - 1]
    behind = np.concatenate([np.cumsum(lower[::-1], dtype=np.uint64)[::-1], np.zeros(1, np.uint64)])
    gone = _mixed(before[:n] + behind)
    return int(_mixed(before[n : n + 1])[0]), gone, _mixed(gone + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def neighbour_rows(lines: DataFrame) -> DataFrame:
    """(key, role, line_key) for lines (line_key, line): role 0 with the place left out, 1 without it, 2 the line as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                whole, gone, placed = neighbourhood(line)
                keys = np.concatenate([placed, np.unique(gone), np.array([whole], np.uint64)]).view(np.int64)
                roles = np.concatenate([np.zeros(len(placed), np.int8), np.ones(len(keys) - len(placed) - 1, np.int8), np.full(1, 2, np.int8)])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(roles), pa.array(np.full(len(keys), key, np.int64))], names=["key", "role", "line_key"])

    return lines.select("line_key", "line").mapInArrow(run, "key long, role byte, line_key long")


def first_lines(lines: DataFrame) -> DataFrame:
    """(line_key, first, n): each different line's earliest place and how often it stands, pre-aggregated before the shuffle."""
    return lines.groupBy(F.xxhash64("line").alias("line_key")).agg(F.min("place").alias("first"), F.count("*").alias("n"))


def near_lines(lines: DataFrame, firsts: DataFrame, scratch: Scratch) -> DataFrame:
    """line_key of each line that has a different, earlier line within one edit."""
    halves = lines.select(F.xxhash64("line").alias("line_key"), F.explode(half_keys(F.col("line"))).alias("half"))
    shared = halves.groupBy("half").agg(F.min("line_key").alias("low"), F.max("line_key").alias("high")).where("low != high").select("half")
    some = halves.join(shared, "half", "left_semi").select("line_key").distinct()
    texts = lines.select(F.xxhash64("line").alias("line_key"), "line").join(some, "line_key", "left_semi").groupBy("line_key").agg(F.min("line").alias("line"))
    told = scratch.keep(texts.join(firsts.select("line_key", "first"), "line_key"))
    rows = neighbour_rows(told.repartition("line_key")).join(told.select("line_key", "first"), "line_key")
    rows = scratch.keep(rows.select("key", "role", F.struct("first", "line_key").alias("who")))
    # same place left out: all of a key are one edit apart, and the earliest decides
    same = rows.where("role = 0")
    low = same.groupBy("key").agg(F.min("who").alias("earliest"))
    pairs = same.join(low, "key").where("who.line_key != earliest.line_key").select("who", "earliest")
    # a whole line against those that are one character longer; two lines never share the hash of a whole line
    whole, longer = rows.where("role = 2"), rows.where("role = 1")
    met = longer.join(whole.select("key", F.col("who").alias("whole")), "key")
    pairs = pairs.unionByName(met.where("whole.first < who.first").select("who", F.col("whole").alias("earliest")))
    back = met.groupBy("whole").agg(F.min("who").alias("earliest")).where("earliest.first < whole.first").select(F.col("whole").alias("who"), "earliest")
    pairs = pairs.unionByName(back).groupBy(F.col("who.line_key").alias("line_key"), F.col("earliest.line_key").alias("other")).count()
    pairs = pairs.join(told.select("line_key", "line"), "line_key").join(told.select(F.col("line_key").alias("other"), F.col("line").alias("other_line")), "other")
    return pairs.where((F.levenshtein("line", "other_line") == 1)).select("line_key").distinct()


def dropped_lines(docs: DataFrame, scratch: Scratch, rule: Lines = Lines()) -> DataFrame:
    """(doc_id, twin, at, near) for each line that goes; near: it is no exact copy of an earlier one. docs: with twin."""
    lines = lines_of(docs, rule)
    firsts = scratch.keep(first_lines(lines))
    near = scratch.keep(near_lines(lines.where(F.length("line") >= rule.near_chars), firsts, scratch))
    marks = near.select("line_key", F.lit(True).alias("near")) if near.count() > BROADCAST_ROWS else F.broadcast(near.select("line_key", F.lit(True).alias("near")))
    told = firsts.join(marks, "line_key", "left").where("n > 1 or near")
    # only lines with copies or near ones are joined back, so that a line without any isn't shuffled for long
    keyed = lines.select("place", F.xxhash64("line").alias("line_key"))
    out = keyed.join(told.select("line_key", "first", "near"), "line_key").where("near or place != first")
    return out.select("place.*", (F.col("place") == F.col("first")).alias("near")).distinct()


def line_report(docs: DataFrame, rule: Lines = Lines()) -> DataFrame:
    """doc_id, n_lines, n_exact, n_near (lines that go, by reason) and n_kept_chars for each row of docs."""
    kept = _with_marks(docs, rule)
    at = F.col("__tm_gone")
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    stays = F.filter(split, lambda x, i: ~F.coalesce(F.array_contains(at, i), F.lit(False)))
    return kept.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.size(split).cast("long").alias("n_lines"),
        (F.coalesce(F.size(at), F.lit(0)) - F.coalesce(F.col("__tm_near"), F.lit(0))).cast("long").alias("n_exact"),
        F.coalesce(F.col("__tm_near"), F.lit(0)).cast("long").alias("n_near"), F.length(F.array_join(stays, "\n")).cast("long").alias("n_kept_chars"),
    )


def _with_marks(docs: DataFrame, rule: Lines) -> DataFrame:
    """docs with the places of the lines that go (__tm_gone, null for none) and how many are near ones (__tm_near)."""
    scratch = Scratch(docs.sparkSession)
    keyed = told_apart(docs.drop("twin"))
    gone = dropped_lines(keyed, scratch, rule)
    by_doc = gone.groupBy(F.col("doc_id").alias("__tm_doc"), F.col("twin").alias("__tm_twin")).agg(F.array_sort(F.collect_set("at")).alias("__tm_gone"), F.sum(F.col("near").cast("int")).alias("__tm_near"))
    by_doc = checkpointed(by_doc)
    scratch.close()
    if by_doc.count() <= BROADCAST_ROWS:
        by_doc = F.broadcast(by_doc)
    rows = docs.select(F.struct(*docs.columns).alias("__tm_row"), "doc_id", "text")
    met = (F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)) == F.col("__tm_doc")) & (F.col("twin") == F.col("__tm_twin"))
    return told_apart(rows).join(by_doc, met, "left").select("__tm_row.*", "__tm_gone", "__tm_near")


def dedup_lines(docs: DataFrame, rule: Lines = Lines()) -> DataFrame:
    """docs without the lines that go, with all their columns; documents without any other line than blank ones go too."""
    marked = _with_marks(docs, rule)
    at = F.col("__tm_gone")
    stays = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(at, i)), "\n")
    text = F.when(at.isNull(), F.col("text")).otherwise(stays)
    out = marked.withColumn("text", text).where(F.col("__tm_gone").isNull() | (F.trim(F.regexp_replace("text", r"\s", "")) != ""))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__tm_gone").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return out.select(*docs.columns)


#: line_report() in SQL, with the default rule: lines of like length are compared by place.
ORACLE_SQL = """
WITH x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM x),
t AS (SELECT doc_id, pos, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l WHERE length(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) >= 1),
u AS (SELECT line, min((doc_id, pos)) AS first, length(line) AS n FROM t GROUP BY line),
v AS (SELECT * FROM u WHERE n >= 20),
p AS (SELECT a.line, a.n, b.line AS other, b.n AS m FROM v a JOIN v b ON a.n = b.n AND b.first < a.first AND (left(a.line, a.n // 2) = left(b.line, a.n // 2) OR substr(a.line, a.n // 2 + 1) = substr(b.line, a.n // 2 + 1))
  UNION ALL SELECT a.line, a.n, b.line, b.n FROM v a JOIN v b ON b.n = a.n + 1 AND b.first < a.first AND (left(a.line, a.n // 2) = left(b.line, a.n // 2) OR substr(a.line, a.n // 2 + 1) = substr(b.line, a.n // 2 + 2))
  UNION ALL SELECT a.line, a.n, b.line, b.n FROM v a JOIN v b ON b.n = a.n - 1 AND b.first < a.first AND (left(a.line, b.n // 2) = left(b.line, b.n // 2) OR substr(b.line, b.n // 2 + 1) = substr(a.line, b.n // 2 + 2))),
near AS (SELECT DISTINCT line FROM p WHERE CASE WHEN n = m THEN len(list_filter(range(1, n + 1), lambda i: line[i] <> other[i])) = 1
  WHEN m > n THEN len(list_filter(range(1, m + 1), lambda i: left(other, i - 1) || substr(other, i + 1) = line)) > 0 ELSE len(list_filter(range(1, n + 1), lambda i: left(line, i - 1) || substr(line, i + 1) = other)) > 0 END),
g AS (SELECT t.doc_id, t.pos, (t.doc_id, t.pos) = u.first AS near FROM t JOIN u USING (line) LEFT JOIN near n ON n.line = t.line WHERE (t.doc_id, t.pos) <> u.first OR n.line IS NOT NULL),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (g.near = false) AS n_exact, count(*) FILTER (g.near) AS n_near, sum(CASE WHEN g.pos IS NULL THEN length(l.line) END) + count(*) FILTER (g.pos IS NULL) - 1 AS kept FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY 1)
SELECT doc_id, n_lines, n_exact, n_near, coalesce(kept, 0)::BIGINT AS n_kept_chars FROM k
"""
