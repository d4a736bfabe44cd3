"""Product codes against plain k-means in whole numbers, and ball comparisons against all comparisons."""

import hashlib
import math
import random

import numpy as np
import pytest

from tidemark.llm import vector_codes
from tidemark.llm.vector_codes import Codes, ball_nearest, nearest, squared

SCHEMA = "vec_id long, embedding array<float>, label int, code string, kind string"


def table():
    g = random.Random(4)
    make = lambda n=8: [float(np.float32(g.gauss(0, 0.2))) for _ in range(n)]
    vectors = [make() for _ in range(90)]
    vectors += [vectors[3]] * 40 + [[round(x, 1) for x in make()] for _ in range(60)]
    rows = [(5 * i - 40, v, g.choice([1, 2, None]), "c", "k") for i, v in enumerate(vectors)]
    rows += [(1000, None, 1, "c", "k"), (1001, [], 1, "c", "k"), (1002, [*make(7), None], 1, "c", "k"), (1003, [*make(7), math.nan], 1, "c", "k"), (1004, [*make(7), math.inf], None, "c", "k"), (1005, make(12), 1, "c", "k"), (1006, make(7), 1, "c", "k")]
    rows += [(1007, [1e30, -1e30, *make(6)], 1, "c", "k"), (None, make(), 2, None, None), (None, vectors[0], 2, "c", "k"), rows[5], (rows[6][0], make(), 3, "c", "k")]
    return rows


def brute(rows, codes):
    kept = []
    for i, v, label, *_ in rows:
        if v and len(v) % codes.parts == 0 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, label, [math.floor(1024 * min(max(float(np.float32(x)), -(2**17)), 2**17)) for x in v]))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    width = len(kept[0][2]) // codes.parts
    pieces = [[r[2][p * width : (p + 1) * width] for r in kept] for p in range(codes.parts)]
    books = [[list(x) for x in pieces[p][: codes.entries]] for p in range(codes.parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(codes.rounds + 1):
        near = [[min((gap(x, e), j) for j, e in enumerate(books[p])) for x in pieces[p]] for p in range(codes.parts)]
        if k < codes.rounds:
            for p in range(codes.parts):
                for j in range(len(books[p])):
                    own = [x for x, (_, e) in zip(pieces[p], near[p], strict=True) if e == j]
                    if own:
                        books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(near[p][i][0] for p in range(codes.parts)) for i in range(len(kept))]
    by: dict = {}
    for r, e in zip(kept, errors, strict=True):
        by[r[1]] = by.get(r[1], 0) + e
    return [(r[0], "".join(f"{near[p][i][1]:02x}" for p in range(codes.parts)), errors[i], by[r[1]], sha) for i, r in enumerate(kept)]


@pytest.mark.parametrize("codes", [Codes(entries=16), Codes(entries=16, batch=7), Codes(), Codes(parts=2, entries=5, rounds=2)])
def test_codes_match_plain_k_means(spark, codes):
    rows = table()
    got = vector_codes.coded(spark.createDataFrame(rows, SCHEMA).repartition(3), codes)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(rows, codes), key=str)


def test_no_vectors(spark):
    docs = spark.createDataFrame(table(), SCHEMA)
    assert vector_codes.coded(docs.limit(0)).count() == 0
    assert vector_codes.coded(docs.where("embedding is null")).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_balls_are_exact_and_compare_less(seed):
    g = np.random.default_rng(seed)
    spread = 3 if seed % 2 else 200  # small numbers make many ties
    centres = g.integers(-spread, spread, (20, 4)) * (1 if seed % 2 else 10)
    points = centres[g.integers(0, 20, 800)] + g.integers(-2, 3, (800, 4))
    entries = centres + g.integers(-1, 2, centres.shape)
    entries[7] = entries[3]  # equal entries: the lower index wins
    before = nearest(points, centres)[0]
    code, far, compared = ball_nearest(points, entries, before)
    want = nearest(points, entries)
    assert (code == want[0]).all() and (far == want[1]).all()
    if not seed % 2:
        assert compared < 800 * 20 / 2
    far_off = g.integers(0, 20, 800)  # any assignment before is right, if slower
    assert (ball_nearest(points, entries, far_off)[0] == want[0]).all()


def test_large_numbers_stay_exact():
    points, entries = np.array([[2**27, -(2**27)] * 8]), np.array([[-(2**27), 2**27] * 8, [2**27, -(2**27) + 1] * 8])
    assert squared(points, entries).tolist() == [[16 * 2**56, 8]]
