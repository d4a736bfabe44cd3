"""Suffix-array dedup: removes every byte under a 100-byte string that also starts earlier in the corpus.

Sorting all suffixes isn't needed. Each 100-byte window has an anchor, the smallest of the hashes of its 32-byte grams
(the leftmost of equal ones), so equal windows have equal grams at equal offsets. The windows of one anchor are a cell,
at most 69 in a row. Cells meet by the gram of their anchor:

* cells with the same bytes and offsets hold the same windows, so all but the earliest are removed as they are;
* one of each of the others is a suffix to sort. What follows the anchor and, reversed, what goes before it are put in
  order by deep-shallow sorting: a multikey sort by words of eight bytes to a shallow depth, then a blind trie for each
  group that still shares its prefix. From the two orders and their common prefixes, windows at each offset fall into
  classes of equal ones, and all but the earliest of a class go.

A gram with more than `max_group` different cells isn't sorted in one task: its windows are hashed and reduced to the
earliest of each, before and after the shuffle. Texts are shuffled to their wanted cells at any size of the input: a
broadcast of the cells would only do for small ones. Matches are judged on the input and never cross documents.

Defined cases: a null text counts as an empty one; texts under 100 bytes lose nothing. Rows with a null doc_id come last
of all. Rows of one doc_id, or of none, are told apart by a hash of their texts, in its order; rows equal in both are one
document listed twice and get equal results. Bytes are of UTF-8. Very long texts are cut into pieces that overlap. An empty
table gives no rows. In dedup() all other columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import BROADCAST_ROWS, Scratch, arrow_batches, checkpointed, id_text, told_apart

LAST = 2**63 - 1


@dataclass(frozen=True)
class Repeats:
    length: int = 100
    gram: int = 32
    #: Most different cells of one gram that a task sorts.
    max_group: int = 20_000
    #: Bytes up to which the multikey sort goes.
    shallow: int = 16

    @property
    def offsets(self) -> int:
        return self.length - self.gram + 1


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i for i below n, modulo 2**64; kept by the worker for the next batch."""
    if base not in _powers or len(_powers[base]) < n:
        _powers[base] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1 << 22), base, dtype=np.uint64))])
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Bytes:
    """Bytes of a part of a batch, with prefix sums that give the hash of any piece."""

    def __init__(self, data: bytes) -> None:
        self.code = np.frombuffer(data, dtype=np.uint8)
        n = len(self.code)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.code.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=self.sums[1:])
        self.back = powers(_INVERSE, n + 1)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.code) - k + 1
        return mixed((self.sums[k:] - self.sums[:n]) * self.back[:n])


def sliding_minimum(v: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of w values, by doubling."""
    size = 1
    while 2 * size <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[: len(v) - (w - size)], v[w - size :]) if size < w else v


_PLACE = np.uint64(2**28 - 1)


def pieces(texts: list[bytes], rule: Repeats, most: int = 1 << 24) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, offset, bytes) of about `most` bytes; a longer text is cut, with an overlap that parts its windows."""
    out, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < rule.length:
            continue
        for at in range(0, len(t) - rule.length + 1, most):
            part = t[at : at + most + rule.length - 1]
            out.append((i, at, part))
            size += len(part)
            if size >= most:
                yield out
                out, size = [], 0
    if out:
        yield out


def cells_of(texts: list[bytes], rule: Repeats) -> Iterator[tuple[np.ndarray, ...]]:
    """For each list of pieces: row, gram hash, hash of the cell's bytes and offsets, place of the anchor in the text, largest and smallest offset."""
    for parts in pieces(texts, rule):
        own = Bytes(b"".join(p for _, _, p in parts))
        begins = np.cumsum([0, *(len(p) for _, _, p in parts)])
        h = own.grams(rule.gram)
        low = sliding_minimum((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), rule.offsets)
        valid = np.zeros(len(low) + rule.length, dtype=bool)
        for b, e in zip(begins[:-1], begins[1:], strict=True):
            valid[b : e - rule.length + 1] = True
        at = np.flatnonzero(valid)
        anchor = (low[at] & _PLACE).astype(np.int64)
        new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
        start, end = at[new], at[np.append(new[1:], len(at)) - 1]
        a = anchor[new]
        part = np.searchsorted(begins, start, side="right") - 1
        row = np.array([p[0] for p in parts])[part]
        place = a - begins[part] + np.array([p[1] for p in parts])[part]
        most, least = a - start, a - end
        cell = mixed(own.hashes(start, end + rule.length) + (most * 128 + least).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        yield row, h[a], cell, place, most, least


def keyed_text(docs: DataFrame) -> DataFrame:
    """doc_id, the whole text and twin."""
    return told_apart(id_text(docs)).select("doc_id", "text", "twin")


def cell_rows(docs: DataFrame, rule: Repeats) -> DataFrame:
    """(gram, cell, doc_id, twin, place): place holds the anchor's place and the two offsets of the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = np.array([LAST if i is None else i for i in b.column(0).to_pylist()], dtype=np.int64)
            twins = b.column(2).to_numpy()
            for row, gram, cell, place, most, least in cells_of([t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()], rule):
                yield from arrow_batches([("gram", gram.view(np.int64), pa.int64()), ("cell", cell.view(np.int64), pa.int64()), ("doc_id", ids[row], pa.int64()), ("twin", twins[row], pa.int64()), ("place", (place << 14) | (most << 7) | least, pa.int64())], 1 << 16)

    return keyed_text(docs).mapInArrow(run, "gram long, cell long, doc_id long, twin long, place long")


def common_length(x: bytes, y: bytes) -> int:
    if x == y:
        return len(x)
    low, high = 0, len(x)
    while high - low > 1:
        mid = (low + high) // 2
        if x[:mid] == y[:mid]:
            low = mid
        else:
            high = mid
    return low


def blind_trie_order(rows: list[bytes]) -> list[int]:
    """The order of strings of equal length, by a blind trie: nodes hold only where to branch, and a leaf is compared once for each string."""
    size = len(rows[0])
    root: list | tuple = ("leaf", [0], rows[0])
    for i in range(1, len(rows)):
        x = rows[i]
        node = root
        while node[0] != "leaf":  # the bytes between the branches aren't looked at
            node = node[1].get(x[node[0]]) or next(iter(node[1].values()))
        at = common_length(x, node[2])
        if at == size:
            node[1].append(i)
            continue
        above, node = None, root
        while node[0] != "leaf" and node[0] < at:
            above, node = node, node[1][x[node[0]]]
        leaf = ("leaf", [i], x)
        if node[0] == at:
            node[1][x[at]] = leaf
            continue
        # any leaf below tells the byte of the branch that stays
        below = node
        while below[0] != "leaf":
            below = next(iter(below[1].values()))
        fork = (at, {x[at]: leaf, below[2][at]: node})
        if above is None:
            root = fork
        else:
            above[1][x[above[0]]] = fork
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node[0] == "leaf":
            out += node[1]
        else:
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
    return out


def deep_shallow_order(group: np.ndarray, rows: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows (bytes) by group and bytes, and the common prefix of each with the one before it (-1 at a new group)."""
    n, size = rows.shape
    depth = min(shallow // 8 * 8, size // 8 * 8)
    words = rows[:, :depth].copy().view(">u8").astype(np.uint64) if depth else np.zeros((n, 0), np.uint64)
    order = np.lexsort([*(words[:, k] for k in reversed(range(words.shape[1]))), group])
    if n > 1:
        tied = np.append(False, (group[order][1:] == group[order][:-1]) & (words[order][1:] == words[order][:-1]).all(axis=1))
        begins = np.flatnonzero(np.diff(np.append(tied, False).astype(np.int8)) == 1)
        ends = np.flatnonzero(np.diff(np.append(tied, False).astype(np.int8)) == -1) + 1
        for b, e in zip(begins.tolist(), ends.tolist(), strict=True):
            tail = order[b:e]
            order[b:e] = tail[blind_trie_order([rows[i, depth:].tobytes() for i in tail])]
    sorted_rows = rows[order]
    differ = sorted_rows[1:] != sorted_rows[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), size) if n > 1 else np.zeros(0, np.int64)
    lcp = np.where(group[order][1:] == group[order][:-1], lcp, -1)
    return order, np.append(-1, lcp)


def repeated_windows(group: np.ndarray, rank: np.ndarray, most: np.ndarray, least: np.ndarray, right: np.ndarray, left: np.ndarray, rule: Repeats) -> np.ndarray:
    """For each cell and offset, whether the window there equals one of a cell of the same group and a smaller rank."""
    n, w = len(group), rule.offsets
    out = np.zeros((n, w), dtype=bool)
    sides = []
    for rows in (right, left):
        order, lcp = deep_shallow_order(group, rows, rule.shallow)
        back = np.empty(n, dtype=np.int64)
        back[order] = np.arange(n)
        sides.append((back, lcp))
    for o in range(w):
        on = np.flatnonzero((least <= o) & (o <= most))
        if len(on) < 2:
            continue
        (back_r, lcp_r), (back_l, lcp_l) = sides
        cls = np.cumsum(lcp_r < w - 1 - o)[back_r[on]] * (n + 1) + np.cumsum(lcp_l < o)[back_l[on]]
        by = np.lexsort([rank[on], cls])
        first = np.append(True, np.diff(cls[by]) != 0)
        lowest = rank[on][by][np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
        out[on[by], o] = rank[on][by] > lowest
    return out


def context_rows(docs: DataFrame, wanted: DataFrame, rule: Repeats) -> DataFrame:
    """(gram, doc_id, twin, place, left, right) for the wanted cells: the bytes before the anchor, reversed, and those after its gram, zero-padded."""
    listed = wanted.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("gram", "place")).alias("cells"))  # no more than the document's own cells
    joined = keyed_text(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(LAST))).join(listed, ["doc_id", "twin"]).select("doc_id", "text", "twin", "cells")
    pad = rule.offsets - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text, twin, cells in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                for c in cells:
                    at, most, least = c["place"] >> 14, (c["place"] >> 7) & 127, c["place"] & 127
                    rows.append((c["gram"], i, twin, c["place"], data[at - most : at][::-1].ljust(pad, b"\0"), data[at + rule.gram : at - least + rule.length].ljust(pad, b"\0")))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield from arrow_batches([(k, c, t) for k, c, t in zip(("gram", "doc_id", "twin", "place", "left", "right"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], 1 << 15) if rows else ()

    return joined.mapInArrow(run, "gram long, doc_id long, twin long, place long, left binary, right binary")


def sorted_spans(contexts: DataFrame, rule: Repeats) -> DataFrame:
    """(doc_id, twin, start, end) of the repeated windows among the contexts, a task's grams sorted in portions of whole groups."""
    pad = rule.offsets - 1

    def solve(parts: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(parts).combine_chunks()
        gram, ids, twin, place = (t.column(k).to_numpy() for k in ("gram", "doc_id", "twin", "place"))
        matrix = lambda k: np.frombuffer(b"".join(t.column(k).to_pylist()), dtype=np.uint8).reshape(len(gram), pad)
        group = np.cumsum(np.append(True, gram[1:] != gram[:-1]))
        most, least, at = (place >> 7) & 127, place & 127, place >> 14
        # rows come sorted by gram, doc_id and place, so the number of different ones is a rank within the gram; a repeated row has the same rank
        rank = np.cumsum(np.append(True, (gram[1:] != gram[:-1]) | (ids[1:] != ids[:-1]) | (twin[1:] != twin[:-1]) | (place[1:] != place[:-1])))
        hit = repeated_windows(group, rank, most, least, matrix("right"), matrix("left"), rule)
        edge = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(twin[row]), pa.array(at[row] - (high - 1)), pa.array(at[row] - low + rule.length)], names=["doc_id", "twin", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            if not b.num_rows:
                continue
            gram = b.column(0).to_numpy()
            other = np.flatnonzero(gram != gram[-1])
            cut = int(other[-1]) + 1 if len(other) else 0
            t = pa.Table.from_batches([b])
            if held and held[-1].column(0)[-1].as_py() != gram[0]:
                yield solve(held)
                held = []
            if cut:  # the last group may go on in the next batch
                yield solve([*held, t.slice(0, cut)])
                held = [t.slice(cut)]
            else:
                held.append(t)
        if held:
            yield solve(held)

    ordered = contexts.repartition("gram").sortWithinPartitions("gram", "doc_id", "twin", "place")
    return ordered.mapInArrow(run, "doc_id long, twin long, start long, end long")


def hashed_spans(contexts: DataFrame, rule: Repeats) -> DataFrame:
    """The same spans for grams of any number of cells: windows by two 64-bit hashes, each reduced to its earliest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for gram, i, twin, place, left, right in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                for o in range(place & 127, ((place >> 7) & 127) + 1):
                    key = hashlib.blake2b(left[:o][::-1] + b"|" + right[: rule.length - rule.gram - o], digest_size=16, salt=gram.to_bytes(8, "big", signed=True)).digest()
                    rows.append((int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True), i, twin, (place >> 14) - o))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield from arrow_batches([(k, c, pa.int64()) for k, c in zip(("h1", "h2", "doc_id", "twin", "start"), cols, strict=True)]) if rows else ()

    windows = contexts.mapInArrow(run, "h1 long, h2 long, doc_id long, twin long, start long")
    low = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "twin", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    return windows.join(low, ["h1", "h2"]).where("struct(doc_id, twin, start) > first").select("doc_id", "twin", "start", (F.col("start") + rule.length).alias("end"))


def spans(docs: DataFrame, scratch: Scratch, rule: Repeats = Repeats()) -> DataFrame:
    """(doc_id, twin, spans): the maximal removed runs of each document that has any, as sorted (start, end) in bytes."""
    by_gram = Window.partitionBy("gram")
    by_cell = Window.partitionBy("gram", "cell").orderBy("doc_id", "twin", "place")
    who = F.struct("doc_id", "twin", "place")
    rows = cell_rows(docs, rule).withColumn("first", F.first(who).over(by_cell)).withColumn("before", F.lag("place").over(by_cell))
    rows = rows.withColumn("low", F.min("cell").over(by_gram)).withColumn("high", F.max("cell").over(by_gram))
    met = scratch.keep(rows.select("gram", "doc_id", "twin", "place", (who > F.col("first")).alias("copy"), F.col("before").isNull().alias("one"), (F.col("low") != F.col("high")).alias("several")).where("copy or (one and several)").drop("one", "several"))
    copies = met.where("copy").select("doc_id", "twin", (F.shiftright("place", 14) - F.shiftright("place", 7).bitwiseAND(127)).alias("start"), (F.shiftright("place", 14) - F.col("place").bitwiseAND(127) + rule.length).alias("end"))
    wanted = met.where("not copy").select("gram", "doc_id", "twin", "place")
    large = wanted.groupBy("gram").count().where(F.col("count") > rule.max_group).select("gram")
    contexts = scratch.keep(context_rows(docs, wanted, rule))
    large = scratch.keep(large)
    found = sorted_spans(contexts.join(large, "gram", "left_anti"), rule).unionByName(hashed_spans(contexts.join(large, "gram", "left_semi"), rule))
    every = copies.unionByName(found)
    order = Window.partitionBy("doc_id", "twin").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = every.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order))
    runs = islands.groupBy("doc_id", "twin", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("doc_id", "twin").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _with_spans(docs: DataFrame, rule: Repeats) -> DataFrame:
    """docs with __tm_spans, null where nothing goes."""
    scratch = Scratch(docs.sparkSession)
    found = checkpointed(spans(docs, scratch, rule)).select(F.col("doc_id").alias("__tm_doc"), F.col("twin").alias("__tm_twin"), F.col("spans").alias("__tm_spans"))
    scratch.close()
    if found.count() <= BROADCAST_ROWS:
        found = F.broadcast(found)
    rows = docs.select(F.struct(*docs.columns).alias("__tm_row"), "doc_id", "text")
    met = (F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)) == F.col("__tm_doc")) & (F.col("twin") == F.col("__tm_twin"))
    return told_apart(rows).join(found, met, "left").select("__tm_row.*", "__tm_spans")


def kept_bytes(data: bytes, found: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of data, and the runs within it that went."""
    cut = [(s, min(e, len(data))) for s, e in found if s < len(data)]
    out, at = [], 0
    for s, e in cut:
        out.append(data[at:s])
        at = e
    return b"".join(out) + data[at:], cut


def report(docs: DataFrame, rule: Repeats = Repeats()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs."""
    marked = _with_spans(docs, rule).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "__tm_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                kept, cut = kept_bytes(data, [(x["start"], x["end"]) for x in found or []])
                rows.append((len(data), len(data) - len(kept), len(cut), hashlib.sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def dedup(docs: DataFrame, rule: Repeats = Repeats()) -> DataFrame:
    """docs without the removed bytes, with all their columns; a character that loses a byte is dropped whole."""
    marked = _with_spans(docs, rule)

    @F.pandas_udf("string")
    def cut(text, found):  # noqa: ANN001, ANN202
        keep = lambda t, f: t if t is None or f is None else kept_bytes(t.encode("utf-8", "surrogatepass"), [(x["start"], x["end"]) for x in f])[0].decode("utf-8", "ignore")
        return text.combine(found, keep)

    return marked.withColumn("text", cut("text", "__tm_spans")).select(*docs.columns)


ORACLE_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d WHERE length(h) >= 200),
k AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS s FROM w),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM k),
x AS (SELECT doc_id, p, coalesce(p > 100 + max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM r WHERE n > 1),
i AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM x),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, island),
g AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM s UNION ALL SELECT doc_id, 0, min(a) FROM s GROUP BY doc_id),
t AS (SELECT g.doc_id, string_agg(substr(h, 2 * g.a + 1, 2 * (coalesce(g.b, length(h) // 2) - g.a)), '' ORDER BY g.a) AS left_over FROM g JOIN d USING (doc_id) GROUP BY g.doc_id),
c AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
