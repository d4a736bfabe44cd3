"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct shingles of five words (A-Z lower-cased), as 64-bit hashes. Two sets are linked when
100 * intersection >= 80 * union. Then the sets differ in at most (a + b) / 9 shingles, and their sizes in a quarter.

A parity sketch deals the shingles into m blocks and XORs the hashes of each block. A shingle that only one set holds
changes one block, so the number of blocks that differ (a Hamming distance) is a lower bound of the symmetric
difference. With m blocks, more than the largest difference in a band of sizes, and D the largest one that a set of this
size can have with a linked one, a set agrees with any linked set in at least s = m - D blocks (pigeonhole), so they
meet in a join of the blocks.

Blocks that say little are left out where the count allows it. A set with fewer than s/2 zero blocks doesn't emit them:
then it shares more than s/2 others with a linked set, by the larger s of the two. A group of more than `hot` sets (a block with nothing but a very common
passage, or many near copies) only keeps the sets of which more than s/2 blocks in that band are in such groups: all
others that are linked meet in a smaller group as well. Both rules only use what agreeing blocks have in common, so they
lose no link.

Equal sets are one node. Within a group, each node is paired with the group's first node and with the one before it, in
large groups by the number of large groups they are in, so that the first one is the middle of a set of near copies. Pairs
are sifted by size and by a longer parity sketch, half as many bits again as shingles or more, whose Hamming distance must
not exceed D, and verified on whole sets: first each node with the partner it meets most often, then those pairs that still
join two components, then pairs across the components of groups that still hold several: all of them in groups of up to
`hot` sets, and in larger ones those that share a shingle which is rare enough in both (see across_large). A large group of
near copies that are too far apart to be linked has no such pairs, as each one's rare shingles are its own.

Defined cases: null and empty texts, and texts without words, have no set (0 shingles), are linked with nothing and are
their own component. With fewer than five words the whole sequence is the only shingle. Rows with a null doc_id get a
null component and don't count for others. Repeated rows of a doc_id get that document's smallest component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import BROADCAST_ROWS, Scratch, arrow_batches, checkpointed, connected_components, id_text

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD1342543DE82EF95)


#: Bins, as a power of two, in which shingles of near copies are counted to tell rare ones from frequent ones.
BIN_BITS = 18


@dataclass(frozen=True)
class Join:
    words: int = 5
    #: Least similarity in hundredths.
    percent: int = 80
    #: Ratio between the ends of a band of sizes.
    band: float = 2.0
    #: Sets in a group from which on it only keeps those with many such groups.
    hot: int = 24
    #: Pairs that one task verifies with one set at a time.
    portion: int = 512


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: Bytes of texts that are hashed at once, at some 60 bytes of arrays a byte; a longer text goes alone.
HASHED_BYTES = 250_000


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """A 64-bit hash of each word of each text, A-Z lower-cased, in parts of HASHED_BYTES."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for t in texts:
        data = t.encode("utf-8", "surrogatepass")
        if part and size + len(data) > HASHED_BYTES:
            out += _hashed(part)
            part, size = [], 0
        part.append(data)
        size += len(data) + 1
    return out + (_hashed(part) if part else [])


def _hashed(texts: list[bytes]) -> list[np.ndarray]:
    """word_hashes() of texts in UTF-8; a polynomial over all their bytes at once."""
    data = b"\n".join(texts).lower() + b"\n"
    code = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[code]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[::2], edge[1::2]
    power = np.cumprod(np.full(len(code), _A, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
    # divided by the power at the start of the word: times the power of the inverse
    inverse = np.uint64(pow(int(_A), -1, 2**64))
    back = np.cumprod(np.full(len(code), inverse, dtype=np.uint64))
    words = mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.split(words, np.searchsorted(start, ends[:-1]))


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.full(n, np.uint64(min(len(words), k)), dtype=np.uint64)
    for i in range(min(k, len(words))):
        h = h * _B + words[i : i + n]
    return np.unique(mixed(h))


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit name of the whole set."""
    total = np.array([np.bitwise_xor.reduce(mixed(shingles * _A)), np.add.reduce(shingles), len(shingles)], dtype=np.uint64)
    return int(mixed(mixed(total * _B)[[0]] + total[[1]] * _A + total[[2]]).view(np.int64)[0])


def band_ends(rule: Join) -> list[int]:
    """Sizes at which bands begin: band i holds sizes from ends[i] up to ends[i + 1]."""
    out = [1]
    while out[-1] < 2**40:
        out.append(max(out[-1] + 1, int(out[-1] * rule.band)))
    return out


def most_apart(size: int, rule: Join) -> int:
    """The largest symmetric difference of two linked sets of which the larger has this size."""
    return max(((100 - rule.percent) * (size + small)) // (100 + rule.percent) for small in (size, -(-rule.percent * size // 100)))


def blocks_of(band: int, ends: list[int], rule: Join) -> tuple[int, int]:
    """(m, d) of a band: its blocks and the largest difference of linked sets; no blocks where only equal sets are linked."""
    d = most_apart(ends[band + 1] - 1, rule)
    return (d + 4 + d // 5, d) if d else (0, 0)


def spare_of(size: int, band: int, ends: list[int], rule: Join) -> int:
    """s: in how many blocks of a band a set of this size agrees with any linked one at least."""
    m, d = blocks_of(band, ends, rule)
    return m - min(d, (100 - rule.percent) * (size + size * 100 // rule.percent) // (100 + rule.percent))


def block_keys(shingles: np.ndarray, ends: list[int], rule: Join) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, band, least) of a set in its own band and, as the smaller one, in each further band that a partner may be in.

    least: how many emitted blocks it shares with a linked set at least.
    """
    n, out, of_band, least = len(shingles), [np.zeros(0, np.uint64)], [np.zeros(0, np.int8)], [np.zeros(0, np.int32)]
    own = int(np.searchsorted(ends, n, side="right")) - 1
    last = int(np.searchsorted(ends, n * 100 // rule.percent, side="right")) - 1
    for band in range(own, last + 1):
        m, _ = blocks_of(band, ends, rule)
        if not m:
            continue
        spare = spare_of(n, band, ends, rule)
        of = ((shingles >> np.uint64(20)) % np.uint64(m)).astype(np.int64)
        xor = np.zeros(m, dtype=np.uint64)
        np.bitwise_xor.at(xor, of, shingles)
        zero = xor == 0
        emit = np.arange(m) if int(zero.sum()) >= (spare + 1) // 2 else np.flatnonzero(~zero)
        out.append(mixed(mixed(xor[emit]) + np.uint64(band * int(_A) % 2**64) + emit.astype(np.uint64) * _B))
        of_band.append(np.full(len(emit), band, np.int8))
        least.append(np.full(len(emit), spare // 2 + 1, np.int32))
    return np.concatenate(out), np.concatenate(of_band), np.concatenate(least)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The parities of a power of two of buckets, half as many again as shingles or more, as longs."""
    bits = 1 << max(9, (3 * len(shingles) // 2).bit_length())
    parity = np.bincount((shingles >> np.uint64(5)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def sets_of(docs: DataFrame, rule: Join) -> DataFrame:
    """doc_id, node and sketch (null without a set) and n_shingles for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(w, rule.words) for w in word_hashes(b.column(1).to_pylist())] if b.num_rows else []
            nodes = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            sketches = pa.array([sketch(s).tolist() if len(s) else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), nodes, pa.array([len(s) for s in sets], pa.int64()), sketches], names=["doc_id", "node", "n_shingles", "sketch"])

    return id_text(docs).mapInArrow(run, "doc_id long, node long, n_shingles long, sketch array<long>")


def keys_of(docs: DataFrame, rule: Join) -> DataFrame:
    """(key, node, band, least) of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = band_ends(rule)
        for b in batches:
            done: set[int] = set()
            keys, bands, leasts, nodes = [], [], [], []
            for words in word_hashes(b.column(1).to_pylist()) if b.num_rows else []:
                s = shingle_set(words, rule.words)
                if len(s) and (node := node_of(s)) not in done:
                    done.add(node)
                    key, band, least = block_keys(s, ends, rule)
                    keys.append(key)
                    bands.append(band)
                    leasts.append(least)
                    nodes.append(np.full(len(key), node, dtype=np.int64))
            if keys:
                yield from arrow_batches([("key", np.concatenate(keys).view(np.int64), pa.int64()), ("node", np.concatenate(nodes), pa.int64()), ("band", np.concatenate(bands), pa.int8()), ("least", np.concatenate(leasts), pa.int32())])

    return id_text(docs).mapInArrow(run, "key long, node long, band byte, least int")


def groups(docs: DataFrame, scratch: Scratch, rule: Join) -> DataFrame:
    """(key, node, weight) of the groups of two or more different nodes, large ones without the nodes that surely meet elsewhere.

    weight: in large groups, how many large groups of the band the node is in; most for the middle of a set of near copies.
    """
    ordered = Window.partitionBy("key").orderBy("node")
    rows = keys_of(docs, rule).withColumn("before", F.lag("node").over(ordered)).where("before is null or before != node")
    met = scratch.keep(rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").select("key", "node", "band", "least", "n"))
    held = met.where(F.col("n") > rule.hot).groupBy("node", "band", "least").agg(F.count("*").cast("int").alias("weight")).where("weight >= least").drop("least")
    small = met.where(F.col("n") <= rule.hot).select("key", "node", F.lit(0).alias("weight"))
    kept = small.unionByName(met.where(F.col("n") > rule.hot).join(held, ["node", "band"]).select("key", "node", "weight"))
    out = scratch.keep(kept)
    scratch.drop(met)
    return out


def hamming(a: Column, b: Column) -> Column:
    """Distance of two sketches, the longer one folded onto half its length; null if that doesn't make them equally long."""
    n = F.least(F.size(a), F.size(b))
    fold = lambda x: F.when(F.size(x) == n, x).otherwise(F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, F.size(x)), lambda p, q: p.bitwiseXOR(q)))
    return F.aggregate(F.zip_with(fold(a), fold(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, x: s + x)


def sifted(pairs: DataFrame, info: DataFrame, rule: Join) -> DataFrame:
    """The pairs (a, b, ...) whose sizes and sketches allow a link."""
    size = lambda k: info.select(F.col("node").alias(k), F.col("size").alias(f"size_{k}"))
    parity = lambda k: info.select(F.col("node").alias(k), F.col("sketch").alias(f"sketch_{k}"))
    sizes = 100 * F.least("size_a", "size_b") >= rule.percent * F.greatest("size_a", "size_b")
    near = (100 + rule.percent) * hamming(F.col("sketch_a"), F.col("sketch_b")) <= (100 - rule.percent) * (F.col("size_a") + F.col("size_b"))
    alike = pairs.join(size("a"), "a").join(size("b"), "b").where(sizes)
    return alike.join(parity("a"), "a").join(parity("b"), "b").where(near).select(*pairs.columns)


def linked(docs: DataFrame, pairs: DataFrame, info: DataFrame, scratch: Scratch, rule: Join) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough.

    Of a pair, the set that is in more pairs is the hub that the other one goes to; a hub with many goes to several
    portions. So what is sent is in proportion to the pairs and not to pairs times portions.
    """
    met = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("met"))
    of = lambda k: met.select(F.col("node").alias(k), F.col("met").alias(f"met_{k}"))
    led = F.struct("met_a", "a") > F.struct("met_b", "b")
    turned = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    turned = turned.select(F.when(led, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(led, F.col("b")).otherwise(F.col("a")).alias("b"))
    hubs = turned.groupBy("a").agg(F.ceil(F.count("*") / rule.portion).alias("parts"))
    dealt = turned.join(hubs, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    roles = dealt.select(F.col("b").alias("node"), F.struct(F.col("a").alias("hub"), "part", F.lit(True).alias("member")).alias("role"))
    roles = roles.unionByName(dealt.select(F.col("a").alias("node"), F.struct(F.col("a").alias("hub"), "part", F.lit(False).alias("member")).alias("role")).distinct())
    listed = roles.groupBy("node", F.expr(f"role.part div {rule.portion}")).agg(F.collect_list("role").alias("roles")).select("node", "roles")
    wanted = scratch.keep(listed.join(info.select("node", "doc_id"), "node"))
    chosen = id_text(docs).join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "doc_id").select("node", "text", "roles")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hub", "part", "member", "node", "shingles"]
        for b in batches:
            rows = []
            for node, words, roles in zip(b.column(0).to_pylist(), word_hashes(b.column(1).to_pylist()) if b.num_rows else [], b.column(2).to_pylist(), strict=True):
                s = shingle_set(words, rule.words)
                if len(s) and node_of(s) == node:  # a repeated doc_id may have another text
                    rows += [(r["hub"], r["part"], r["member"], node, s.tobytes()) for r in roles]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield from arrow_batches(list(zip(names, cols, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()), strict=True)), 1000)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.zeros(0, np.uint64)
        for b in batches:
            found = []
            for hub, part, member, node, data in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                s = np.frombuffer(data, dtype=np.uint64)
                if not member:
                    at, own = (hub, part), s
                elif at == (hub, part):
                    same = len(own) + len(s) - len(np.union1d(own, s))
                    if 100 * same >= rule.percent * (len(own) + len(s) - same):
                        found.append((min(hub, node), max(hub, node)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    rows = chosen.mapInArrow(deal, "hub long, part long, member boolean, node long, shingles binary")
    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "member").mapInArrow(verify, "a long, b long").distinct()


def with_parts(rows: DataFrame, parts: DataFrame, node: str, part: str) -> DataFrame:
    """rows with the component of a node; one without links is its own."""
    named = parts.select(F.col("node").alias(node), F.col("component").alias(part))
    return rows.join(named, node, "left").withColumn(part, F.coalesce(part, node))


def open_groups(met: DataFrame, parts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, node, part, n) of the groups that hold several components; n is the group's size."""
    rows = with_parts(met.select("key", "node"), parts, "node", "part")
    several = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).where("low != high").select("key", "n")
    return scratch.keep(rows.join(several, "key").select("key", "node", "part", "n"))


def across_small(rows: DataFrame, info: DataFrame, rule: Join) -> DataFrame:
    """The pairs (a, b) of different components within each small group, of sizes that fit."""
    rows = rows.where(F.col("n") <= rule.hot).join(info.select("node", "size"), "node")
    left = rows.select("key", F.col("node").alias("a"), F.col("part").alias("part_a"), F.col("size").alias("size_a"))
    right = rows.select("key", F.col("node").alias("b"), F.col("part").alias("part_b"), F.col("size").alias("size_b"))
    fits = (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.col("part_a") != F.col("part_b")) & (100 * F.least("size_a", "size_b") >= rule.percent * F.greatest("size_a", "size_b"))
    return left.join(right, fits).select("a", "b").distinct()


def sets_with(docs: DataFrame, nodes: DataFrame, rule: Join) -> DataFrame:
    """(node, part, size, shingles) of some nodes. nodes: node, doc_id, part, size."""
    chosen = id_text(docs).join(F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes, "doc_id").select("node", "text", "part", "size")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(words, rule.words) for words in word_hashes(b.column(1).to_pylist())] if b.num_rows else []
            own = pa.array([len(s) > 0 and node_of(s) == node for s, node in zip(sets, b.column(0).to_pylist(), strict=True)], pa.bool_())  # a repeated doc_id may have another text
            every = [b.column(0), b.column(2), b.column(3), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(every, names=["node", "part", "size", "shingles"]).filter(own)

    return chosen.mapInArrow(deal, "node long, part long, size long, shingles binary")


def bins_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - BIN_BITS)).astype(np.int64)


def counted(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets are in each of a fixed number of bins; each task sends its sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << BIN_BITS, np.int64)
        for b in batches:
            for data in b.column(0).to_pylist():
                np.add.at(n, bins_of(np.frombuffer(data, dtype=np.uint64)), 1)
        held = np.flatnonzero(n)
        yield from arrow_batches([("bin", held, pa.int64()), ("n", n[held], pa.int64())])

    table = sets.select("shingles").mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BIN_BITS, np.int64)
    out[table.column("bin").to_numpy()] = table.column("n").to_numpy()
    return out


def rare_shingles(sets: DataFrame, rule: Join) -> DataFrame:
    """(shingle, node, part, size, rank): each set's rarest shingles, as many as may hold the rarest one that it shares with a linked set.

    Shingles are ordered by how full their bin is; any one order of all shingles gives right results, and this one puts those
    of many near copies last. rank counts from that end. Shingles alone in their bin are in no other set.
    """
    counts = sets.sparkSession.sparkContext.broadcast(counted(sets))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for node, part, size, data in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                s = np.frombuffer(data, dtype=np.uint64)
                often = counts.value[bins_of(s)]
                last = np.lexsort((s, often))[::-1]
                at = np.arange(1, len(s) + 1)
                kept = (100 * at >= rule.percent * size) & (often[last] > 1)
                found.append((s[last][kept].view(np.int64), np.full((3, int(kept.sum())), [[node], [part], [size]], np.int64), at[kept]))
            if found:
                rest = np.concatenate([x[1] for x in found], axis=1)
                columns = [("shingle", np.concatenate([x[0] for x in found])), *zip(("node", "part", "size"), rest, strict=True), ("rank", np.concatenate([x[2] for x in found]))]
                yield from arrow_batches([(k, c, pa.int64()) for k, c in columns])

    return sets.select("node", "part", "size", "shingles").mapInArrow(rank, "shingle long, node long, part long, size long, rank long")


def across_large(docs: DataFrame, rows: DataFrame, info: DataFrame, scratch: Scratch, rule: Join) -> DataFrame:
    """The pairs (a, b) of different components that meet in large groups and share one of their rare shingles.

    Linked sets share t shingles or more, by their sizes. So, in one order of all shingles, the rarest first, the first
    one that both hold leaves each of them with t or more from there on: it is at rank t or more from the frequent end
    in both. Within a shingle, the largest component is only paired with the others, never with itself.
    """
    nodes = scratch.keep(rows.where(F.col("n") > rule.hot).select("node", "part").distinct().join(info.select("node", "doc_id", "size"), "node"))
    rare = scratch.keep(rare_shingles(scratch.keep(sets_with(docs, nodes, rule)), rule))
    by_part = rare.groupBy("shingle", "part").agg(F.count("*").alias("n"))
    main = by_part.groupBy("shingle").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("shingle", "main")
    rare = rare.join(main, "shingle")
    side = lambda k: rare.select("shingle", F.col("node").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("part", "size", "rank", "main")))
    left, right = side("a").where("part_a != main_a"), side("b")
    shares = (100 + rule.percent) * F.least("rank_a", "rank_b") >= rule.percent * (F.col("size_a") + F.col("size_b"))
    fits = (left["shingle"] == right["shingle"]) & (F.col("part_a") != F.col("part_b")) & ((F.col("part_b") == F.col("main_b")) | (F.col("a") < F.col("b"))) & shares
    return left.join(right, fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def node_components(docs: DataFrame, nodes: DataFrame, scratch: Scratch, rule: Join) -> DataFrame:
    """(node, component) of the nodes that are linked with others. nodes: node, doc_id, size, sketch."""
    met = groups(docs, scratch, rule)
    info = scratch.keep(nodes.join(met.select("node").distinct(), "node"))
    ordered = Window.partitionBy("key").orderBy(F.desc("weight"), "node")
    near = met.withColumn("first", F.first("node").over(ordered)).withColumn("before", F.lag("node").over(ordered))
    pairs = near.select(F.explode(F.array_distinct(F.array("first", "before"))).alias("a"), F.col("node").alias("b")).where("a is not null and a != b")
    pairs = scratch.keep(sifted(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("k")), info, rule))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "k"))
    best = both.groupBy("b").agg(F.max_by("a", F.struct("k", -F.col("a"))).alias("a"))
    best = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = scratch.keep(linked(docs, best, info, scratch, rule))
    parts = scratch.keep(connected_components(links, scratch))
    # what still joins two components
    open_pairs = with_parts(with_parts(pairs, parts, "a", "part_a"), parts, "b", "part_b").where("part_a != part_b").select("a", "b")
    tried = scratch.keep(open_pairs.join(best, ["a", "b"], "left_anti"))
    if not tried.isEmpty():
        links = scratch.keep(links.unionByName(linked(docs, tried, info, scratch, rule)))
        parts = scratch.keep(connected_components(links, scratch))
    tried = tried.unionByName(best)
    rows = open_groups(met, parts, scratch)
    across = across_small(rows, info, rule).unionByName(across_large(docs, rows, info, scratch, rule)).distinct()
    across = scratch.keep(sifted(across, info, rule).join(tried, ["a", "b"], "left_anti"))
    if not across.isEmpty():
        links = links.unionByName(linked(docs, across, info, scratch, rule))
        parts = scratch.keep(connected_components(links, scratch))
    return parts


def components(docs: DataFrame, rule: Join = Join()) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs."""
    scratch = Scratch(docs.sparkSession)
    sets = scratch.keep(sets_of(docs, rule))
    nodes = sets.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.any_value("n_shingles").alias("size"), F.any_value("sketch").alias("sketch"))
    parts = node_components(docs, nodes, scratch, rule)
    # a component's name: its smallest doc_id; only linked nodes take part
    own = nodes.select("node", F.col("doc_id").alias("own"))
    names = parts.join(own, "node").groupBy("component").agg(F.min("own").alias("least"))
    named = own.join(parts.join(names, "component").select("node", "least"), "node", "left").select("node", F.coalesce("least", "own").alias("component_id"))
    out = sets.select("doc_id", "node", "n_shingles").join(named, "node", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    out = checkpointed(out.select("doc_id", "n_shingles", "component_id"))
    scratch.close()
    return out


def keep_one(docs: DataFrame, rule: Join = Join()) -> DataFrame:
    """docs without those of a component that has a smaller doc_id, with all their columns; rows without a doc_id stay."""
    gone = components(docs, rule).where("component_id < doc_id").select(F.col("doc_id").alias("__tm_doc")).distinct()
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("__tm_doc"), "left_anti")


#: The same result in SQL: all shared shingles are joined, and components found by recursion.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END AS gs FROM w),
s AS (SELECT DISTINCT doc_id, unnest(gs) AS g FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT x AS node, x AS other FROM b UNION SELECT r.node, b.y FROM r JOIN b ON b.x = r.other),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""

__all__ = ["Join", "components", "keep_one"]
