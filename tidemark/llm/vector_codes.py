"""Vector code compression: product codes of four parts, fitted by ball k-means in whole numbers.

Each component becomes floor(1024 x). The vectors are cut into `parts` equal pieces, and each piece has a codebook of at most
`entries` entries, which begin as the pieces of the smallest ids. A round assigns every piece to its nearest entry (squared
Euclidean distance, ties to the lower index) and moves each entry to its pieces' floored mean; entries without pieces stay.

Rounds after the first are ball k-means. The pieces that were assigned to an entry are its ball; the ball's radius is the largest
distance of one of its pieces from the entry where it stands now. Another entry is a neighbour of the ball only if half of the distance
between the two entries is within the radius. A piece that is nearer to its entry than half way to the nearest neighbour is
in the stable core and keeps its entry unexamined. The others lie in rings: a piece compares only the neighbours that are half
way within its own distance, which are the first few in the order of their distance from the entry. All of this is exact in
squared whole numbers, with ties examined, so that the result is that of comparing every entry. Radii are taken by Arrow batch:
those of the pieces at hand, which are at most the whole ball's.

One job a round writes the vectors with their new codes and, beside them, the sums by part and entry that the task gathered;
only these sums (parts x entries rows after an aggregation) come to the driver.

Defined cases: rows whose vector is null, or holds null or non-finite components, are dropped, as are empty vectors, those whose length isn't a multiple
of `parts`, and those of another length than the first kept vector by vec_id. Ids that repeat are vectors of their own; where they
tie among the first entries, the smaller vector comes first; rows without an id come last. With fewer vectors than
entries, the codebooks are as long as there are vectors. Scaled components beyond 2^27 either way are held there, so that squared
distances fit into 64 bits. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, bounded

SCALE = 1024
HELD = 2**27
#: Below this, sums of squares of whole numbers are exact in doubles.
EXACT = 2**22


@dataclass(frozen=True)
class Codes:
    parts: int = 4
    #: At most 256: a code is two hex digits.
    entries: int = 256
    rounds: int = 4
    #: Vectors that a task compares at a time.
    batch: int = 16_384


def whole(vectors: DataFrame, codes: Codes) -> DataFrame:
    """vec_id, label and v: the kept vectors as whole numbers."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.where(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % codes.parts == 0) & finite)
    held = F.transform(x, lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, F.lit(-float(HELD))), F.lit(float(HELD)))).cast("int"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), held.alias("v"))


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each point from each entry, exact."""
    if max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0)) < EXACT // 4 and points.shape[1] < 64:
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p**2).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e**2).sum(axis=1)[None]).astype(np.int64)
    out = np.zeros((len(points), len(entries)), dtype=np.int64)
    for d in range(points.shape[1]):
        out += (points[:, d, None] - entries[None, :, d]) ** 2
    return out


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each point and its squared distance; ties to the lower index."""
    far = squared(points, entries)
    code = far.argmin(axis=1)
    return code, far[np.arange(len(points)), code]


def ball_nearest(points: np.ndarray, entries: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """nearest(), from the entries that the points had before; and how many distances it worked out."""
    code = before.astype(np.int64)
    own = ((points - entries[code]) ** 2).sum(axis=1)
    between = squared(entries, entries)
    best, distance, compared = code.copy(), own.copy(), len(points)
    by = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.diff(code[by])) + 1
    for members in np.split(by, cuts) if len(by) else []:
        i = code[members[0]]
        reach = 4 * own[members]  # half of a distance is within d where its square is within 4 d^2
        order = np.argsort(between[i], kind="stable")
        order = order[order != i]
        order = order[between[i][order] <= reach.max()]  # neighbours of the ball
        rings = np.searchsorted(between[i][order], reach, side="right")  # 0: stable core
        low = 0
        while low < len(order):  # rings of 1, 2 to 3, 4 to 7 ... neighbours together
            high = min(2 * low + 1, len(order))
            inside = members[(rings > low) & (rings <= high)]
            if len(inside):
                near = order[:high]
                far = squared(points[inside], entries[near])
                compared += far.size
                far[np.arange(high)[None] >= rings[(rings > low) & (rings <= high)][:, None]] = np.iinfo(np.int64).max
                least = far.min(axis=1)
                first = np.where(far == least[:, None], near[None], len(entries)).min(axis=1)
                better = (least < own[inside]) | (least == own[inside]) & (first < i)
                best[inside[better]], distance[inside[better]] = first[better], least[better]
            low = high
    return best, distance, compared


ROUND = "vec_id long, label {label}, v array<int>, code array<int>, error long, part int, entry int, n long, total array<long>, kind string"


def assigned(rows: DataFrame, books: np.ndarray, codes: Codes, first: bool, sums: bool) -> DataFrame:
    """The rows with code and error by the codebooks, as kind 'vector'; with sums, each task's sums by part and entry as kind 'sum'."""
    schema = ROUND.format(label=rows.schema["label"].dataType.simpleString())
    width = books.shape[2]
    at_code = rows.columns.index("code") if not first else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(books.shape[:2], dtype=np.int64)
        total = np.zeros(books.shape, dtype=np.int64)
        label = pa.null()

        def emit(size: int, own: dict) -> pa.RecordBatch:
            kinds = {"vec_id": pa.int64(), "label": label, "v": pa.list_(pa.int32()), "code": pa.list_(pa.int32()), "error": pa.int64(), "part": pa.int32(), "entry": pa.int32(), "n": pa.int64(), "total": pa.list_(pa.int64()), "kind": pa.string()}
            return pa.RecordBatch.from_arrays([own.get(k, pa.nulls(size, t)) for k, t in kinds.items()], names=list(kinds))

        for whole_batch in batches:
            label = whole_batch.column(1).type
            for low in range(0, whole_batch.num_rows, codes.batch):
                b = whole_batch.slice(low, codes.batch)
                v = np.asarray(b.column(2).flatten()).reshape(b.num_rows, codes.parts, width).astype(np.int64)
                before = None if first else np.asarray(b.column(at_code).flatten()).reshape(b.num_rows, codes.parts)
                code, error = np.zeros((b.num_rows, codes.parts), dtype=np.int32), np.zeros(b.num_rows, dtype=np.int64)
                for p in range(codes.parts):
                    own, far = nearest(v[:, p], books[p]) if first else ball_nearest(v[:, p], books[p], before[:, p])[:2]
                    code[:, p] = own
                    error += far
                    if sums:
                        n[p] += np.bincount(own, minlength=books.shape[1])
                        np.add.at(total[p], own, v[:, p])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, codes.parts, dtype=np.int32)), pa.array(code.ravel()))
                yield emit(b.num_rows, {"vec_id": b.column(0), "label": b.column(1), "v": b.column(2), "code": lists, "error": pa.array(error), "kind": pa.array(["vector"] * b.num_rows)})
        if sums and n.any():
            part, entry = np.nonzero(n)
            yield emit(len(part), {"part": pa.array(part.astype(np.int32)), "entry": pa.array(entry.astype(np.int32)), "n": pa.array(n[part, entry]), "total": pa.array(total[part, entry].tolist(), pa.list_(pa.int64())), "kind": pa.array(["sum"] * len(part))})

    return rows.mapInArrow(run, schema)


def moved(books: np.ndarray, rows: DataFrame) -> np.ndarray:
    """The codebooks after a round, from the sums of its tasks."""
    width = books.shape[2]
    sums = rows.where("kind = 'sum'").groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[d]).alias(f"t{d}") for d in range(width)])
    out = books.copy()
    for r in sums.collect():  # at most parts x entries
        out[r.part, r.entry] = np.array([r[f"t{d}"] for d in range(width)], dtype=np.int64) // r.n
    return out


@dataclass(frozen=True)
class Fitted:
    #: By part, entry and place within the part.
    books: np.ndarray
    #: vec_id, label, v and the codes of the last round.
    rows: DataFrame | None

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def fit(vectors: DataFrame, scratch: Scratch, codes: Codes = Codes()) -> Fitted | None:
    """The codebooks after the rounds, and the vectors with the codes that they had in the last; None without a vector."""
    every = whole(vectors, codes)
    order = [F.asc_nulls_last("vec_id"), F.col("v")]
    head = every.orderBy(*order).limit(1).first()  # its length is that of all
    if head is None:
        return None
    length = len(head.v)
    kept = scratch.keep(every.where(F.size("v") == length))
    seeds = np.array([r.v for r in kept.orderBy(*order).limit(codes.entries).select("v").collect()], dtype=np.int64)
    books = seeds.reshape(len(seeds), codes.parts, length // codes.parts).transpose(1, 0, 2).copy()
    rows = kept
    for k in range(codes.rounds):
        done = scratch.keep(assigned(rows, books, codes, first=k == 0, sums=True))
        scratch.drop(kept)
        kept, rows = done, done.where("kind = 'vector'").select("vec_id", "label", "v", "code")
        books = moved(books, done)
    return Fitted(books, rows)


def coded(vectors: DataFrame, codes: Codes = Codes()) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for each kept vector."""
    scratch = Scratch(vectors.sparkSession)
    model = fit(vectors, scratch, codes)
    if model is None:
        scratch.close()
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    done = scratch.keep(assigned(model.rows, model.books, codes, first=codes.rounds == 0, sums=False).select("vec_id", "label", "code", "error"))
    hexed = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    by_label, _ = bounded(done.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    out = done.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", hexed.alias("code"), "error", "label_error", F.lit(model.sha256).alias("codebooks_sha256"))


def _oracle(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    steps = [
        f"""
k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS v FROM k, (SELECT unnest(range({parts})) AS part) q),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v FROM p QUALIFY e < {entries})"""
    ]
    nearest = "SELECT p.vec_id, p.label, p.part, p.v, min({d}) AS d, arg_min(e, ({d}) * 1000 + e) AS e FROM p JOIN b{k} b ON b.part = p.part GROUP BY ALL"
    d = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))"
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED ({nearest.format(d=d, k=k)})")
        if k < rounds:
            steps.append(f"s{k} AS (SELECT part, e, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT part, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{k}) t GROUP BY ALL)")
            steps.append(f"m{k} AS (SELECT part, e, list((s - ((s % n + n) % n)) // n ORDER BY i) AS v FROM s{k} GROUP BY ALL)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, e))")
    steps.append(f"f AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(lpad(hex(e), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS h FROM b{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM f, h"


#: The same result in SQL, for ids that don't repeat.
ORACLE_SQL = _oracle()
