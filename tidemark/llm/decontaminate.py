"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are sequences of words (what ASCII signs and white space part, in lower case). Windows of `seed` words that a text
shares with an item, told by a rolling hash, make candidate pairs; of the text, only words under such windows go on. For
each pair, the longest matches of words that no earlier tile covers are marked again and again by running Karp-Rabin
matching, from the longest length downwards, until none has `seed` words. The share of the item's words under tiles is its coverage, whatever the order in
which the text holds the passages. A text is contaminated by an item with a coverage of `coverage` or more.

The benchmark is cut into blocks of a bounded size, by hashed item, and each block's windows are broadcast to a pass
over the texts.

Defined cases: a null or empty text, and an item without words, match nothing. An item with fewer than `seed` words has
one window, all its words; one with fewer than `least_words` isn't looked for, so that a single common word contaminates
nothing. Of items with one id the best
covered counts. An empty benchmark leaves every document clean, an empty table of documents gives no rows. Among ties the
leftmost tile in the item, then in the text, is marked. Each row is judged by its own text, so null and repeated doc_ids do
no harm, and repeated rows get equal results. Very long texts, and texts or items that repeat a word throughout, take memory
in proportion to their words, as no pairs of places are laid out. In
clean() all columns stay, whatever their names; report() only reads doc_id and text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import _arrow_schema, id_text, small_batches

#: Bytes of UTF-8 that part words: ASCII but for letters and digits.
PARTING = bytes(c if c >= 128 or chr(c).isalnum() else 0x20 for c in range(256))


@dataclass(frozen=True)
class Tiling:
    #: Words of the shortest tile.
    seed: int = 5
    coverage: float = 0.6
    #: Words of the shortest item that is looked for.
    least_words: int = 2
    #: Characters of benchmark text that one block may hold.
    block_chars: int = 2_000_000


def tokens(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(PARTING).split()


Tile = tuple[int, int, int]


class Fingerprints:
    """Karp-Rabin fingerprints of the windows of any length, from running sums of codes times powers of an odd base."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, codes: np.ndarray, most: int) -> None:
        n = len(codes)
        self.power = np.cumprod(np.append(np.uint64(1), np.full(max(n, most), self.BASE)))
        self.sums = np.append(np.uint64(0), np.cumsum(codes * self.power[:n]))

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        """Of the windows that start at these places; equal windows have equal ones wherever they stand, also in another text with the same `most`."""
        return (self.sums[at + length] - self.sums[at]) * self.power[len(self.power) - 1 - at]


def free_starts(free: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows of this length that hold free places alone."""
    run = np.append(0, np.cumsum(free))
    return np.flatnonzero(run[length:] - run[:-length] == length)


def greedy_tiles(text: np.ndarray, item: np.ndarray, code: np.ndarray, seed: int) -> list[Tile]:
    """(text place, item place, length) of the tiles of two arrays of words, below 0 where the text has a gap.

    Running Karp-Rabin: the longest length at which free windows of both agree is found by bisection, as each match holds
    all shorter ones. All tiles of that length are marked, from the left of the item and then of the text, then the next
    shorter length is looked for. Memory follows the words of both, however often they repeat; there are no pairs of places.
    """
    most = max(len(text), len(item))
    prints_t, prints_i = Fingerprints(code[text], most), Fingerprints(code[item], most)
    free_t, free_i = text >= 0, np.ones(len(item), bool)
    tiles: list[Tile] = []

    def meeting(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text windows, their fingerprints in order, and the item windows that meet one with theirs."""
        t, i = free_starts(free_t, length), free_starts(free_i, length)
        ft, fi = prints_t.of(t, length), prints_i.of(i, length)
        met = np.isin(fi, ft)
        return t, ft, i[met], fi[met]

    longest = min(len(item), len(text)) + 1
    while longest > seed:
        low, high = seed - 1, longest - 1
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(meeting(middle)[2]) else (low, middle - 1)
        if low < seed:
            break
        longest = low
        t, ft, i, fi = meeting(longest)
        order = np.argsort(ft, kind="stable")
        t, ft = t[order], ft[order]
        first, end = np.searchsorted(ft, fi).tolist(), np.searchsorted(ft, fi, side="right").tolist()
        reached: dict[int, int] = {}
        for i0, lo, hi in zip(i.tolist(), first, end, strict=True):
            if not (free_i[i0] and free_i[i0 + longest - 1]):  # tiles of one length overlap at an end
                continue
            k = reached.get(lo, lo)
            while k < hi and not (free_t[t[k]] and free_t[t[k] + longest - 1]):
                k += 1
            reached[lo] = k
            if k < hi and np.array_equal(text[t[k] : t[k] + longest], item[i0 : i0 + longest]):
                free_t[t[k] : t[k] + longest] = False
                free_i[i0 : i0 + longest] = False
                tiles.append((int(t[k]), i0, longest))
    return tiles


def only_near(ids: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """The words that windows of seed words at these places cover, in order, with a -1 for each gap between them."""
    under = np.zeros(len(ids) + 1, np.int64)
    np.add.at(under, places, 1)
    np.add.at(under, places + seed, -1)
    covered = np.cumsum(under[:-1]) > 0
    kept = covered | np.append(False, covered[:-1])
    return np.where(covered, ids, -1)[kept]


class Block:
    """A block of the benchmark: its words, and its windows by hash."""

    def __init__(self, items: list[tuple[int, str]], rule: Tiling) -> None:
        self.rule = rule
        words: dict[bytes, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        self.short: list[tuple[int, list[int]]] = []
        for item_id, text in items:
            ids = [words.setdefault(w, len(words)) for w in tokens(text)]
            if len(ids) >= rule.least_words:
                (self.items if len(ids) >= rule.seed else self.short).append((item_id, ids))
        self.words = words
        g = np.random.default_rng(5)
        self.code = g.integers(1, 2**63, size=len(words) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.short_first: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
        for item_id, ids in self.short:
            self.short_first[ids[0]].append((item_id, ids))
        hashes = [self.windows(np.array(ids)) for _, ids in self.items]
        every = np.concatenate([np.zeros(0, np.uint64), *hashes])
        order = np.argsort(every, kind="stable")
        of_item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(h)) for h in hashes)])
        # by window: its item and place of each time it stands in the block, from first to first + often
        self.of_item, self.place = of_item[order], place[order]
        self.seeds, self.first, self.often = np.unique(every[order], return_index=True, return_counts=True)

    def windows(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.rule.seed + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        c, h = self.code[ids], np.zeros(n, np.uint64)
        for k in range(self.rule.seed):
            h = h * np.uint64(0x9E3779B97F4A7C15) + c[k : k + n]
        return h ^ (h >> np.uint64(29))

    def match(self, text: str) -> list[tuple[int, float]]:
        """(item_id, coverage) of each item that shares a window with the text."""
        found = tokens(text)
        ids = np.fromiter((self.words.get(w, -1) for w in found), dtype=np.int64, count=len(found))
        seed = self.rule.seed
        known = ids >= 0
        out: list[tuple[int, float]] = []
        if self.short:
            listed = ids.tolist()
            for at in np.flatnonzero(known).tolist():
                out += [(item_id, 1.0) for item_id, own in self.short_first.get(listed[at], ()) if listed[at : at + len(own)] == own]
        if len(ids) < seed or not len(self.seeds):
            return out
        run = np.concatenate([[0], np.cumsum(known)])
        places = np.flatnonzero(run[seed:] - run[:-seed] == seed)  # windows of words that the benchmark has
        if not len(places):
            return out
        h = self.windows(np.maximum(ids, 0))[places]
        slot = np.minimum(np.searchsorted(self.seeds, h), len(self.seeds) - 1)
        hit = self.seeds[slot] == h
        if not hit.any():
            return out
        places, slot = places[hit], slot[hit]
        kinds = np.unique(slot)
        often = self.often[kinds]
        entry = np.repeat(self.first[kinds] - np.cumsum(often) + often, often) + np.arange(often.sum())  # at most the block's windows
        item, i = self.of_item[entry], self.place[entry]
        order = np.argsort(item, kind="stable")
        item, i = item[order], i[order]
        edge = np.flatnonzero(np.append(True, np.diff(item) != 0)).tolist()
        for low, high in zip(edge, [*edge[1:], len(item)], strict=True):
            item_id, own = self.items[item[low]]
            seen = np.zeros(len(own) + 1, np.int64)
            np.add.at(seen, i[low:high], 1)
            np.add.at(seen, np.minimum(i[low:high] + seed, len(own)), -1)
            if (np.cumsum(seen[:-1]) > 0).sum() < self.rule.coverage * len(own):  # no tiling covers enough
                out.append((item_id, 0.0))
                continue
            ours = np.array(own)
            shared = places[np.isin(self.seeds[slot], self.windows(ours))]
            out.append((item_id, sum(x[2] for x in greedy_tiles(only_near(ids, shared, seed), ours, self.code, seed)) / len(own)))
        return out


def blocks(benchmark: DataFrame, rule: Tiling) -> Iterator[list[tuple[int, str]]]:
    """The items, in blocks of about rule.block_chars characters by hashed item; each fits the driver."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // rule.block_chars)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]


HITS = "array<struct<item_id: long, coverage: double>>"


def hits_of(docs: DataFrame, benchmark: DataFrame, rule: Tiling = Tiling()) -> DataFrame:
    """(doc_id, hits) for each row of docs: each item at or above rule.coverage with its coverage, the largest of equal items.

    Each row is judged by its own text, and each block of the benchmark is one more pass in the same stage: nothing is shuffled.
    """
    out = id_text(docs).withColumn("hits", F.array().cast(HITS))
    schema = out.schema
    kind = _arrow_schema(schema).field("hits").type
    for items in blocks(benchmark, rule):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            block = Block(shared.value, rule)
            for b in batches:
                rows = []
                for text, before in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    best = {x["item_id"]: x["coverage"] for x in before}
                    for item_id, c in block.match(text):
                        if c >= rule.coverage:
                            best[item_id] = max(c, best.get(item_id, 0.0))
                    rows.append([{"item_id": k, "coverage": c} for k, c in best.items()])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, kind)], names=["doc_id", "text", "hits"])

        out = out.mapInArrow(run, schema)
    return out.select("doc_id", "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, rule: Tiling = Tiling()) -> DataFrame:
    """(doc_id, item_id, coverage) for each row of docs and item at or above rule.coverage."""
    return hits_of(docs, benchmark, rule).select("doc_id", F.inline("hits"))


def report(docs: DataFrame, benchmark: DataFrame, rule: Tiling = Tiling()) -> DataFrame:
    """doc_id, contaminated, n_items, coverage (the largest) and item_id (the smallest of those with it) for each row of docs."""
    hits = hits_of(docs, benchmark, rule)
    best = F.array_max(F.transform("hits", lambda x: F.struct(x["coverage"].alias("coverage"), (-x["item_id"]).alias("less"))))
    told = hits.select("doc_id", F.size("hits").cast("long").alias("n_items"), best.alias("best"))
    return told.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", F.coalesce("best.coverage", F.lit(0.0)).alias("coverage"), (-F.col("best.less")).alias("item_id"))


def clean(docs: DataFrame, benchmark: DataFrame, rule: Tiling = Tiling()) -> DataFrame:
    """docs without the contaminated rows, with all their columns; one pass for each block of the benchmark."""
    at = docs.columns.index("text")
    out = docs
    for items in blocks(benchmark, rule):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            block = Block(shared.value, rule)
            for b in batches:
                yield b.filter(pa.array([not any(c >= rule.coverage for _, c in block.match(t or "")) for t in b.column(at).to_pylist()], pa.bool_()))

        small_batches(docs.sparkSession)
        out = out.mapInArrow(run, docs.schema)
    return out
