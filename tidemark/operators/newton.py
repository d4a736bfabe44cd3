"""Many fits in one pass: logistic models of all groups, strengths and bootstrap draws by Newton steps, ridge by normal equations.

A step needs the gradient and the Hessian of each fit. A task adds them up over its Arrow batches for all fits at once and sends one
row a group and fit; an aggregation adds the tasks' rows, and the driver solves a small system for each fit. So a step is one
pass over the rows, whatever the number of fits, and what reaches the driver is groups x fits x (features squared), fixed by the models and not by the rows.

Draws of a bootstrap are Poisson weights made from a hash of the row's cluster and the draw: the same wherever the cluster's rows
lie and however often a task runs, with nothing gathered by cluster. Few passes work with all draws. Where rows take few different
(group, features, label), one pass adds each draw's weights up by these and the steps run over the sums. Else the rows are fitted
as they are first; one pass there gives every draw's derivatives up to the third, as all draws share the probabilities, and a start
close to its minimum; Newton steps by the draws' own probabilities go on from it until they move by no more than the tolerance, over the draws that still move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells (rows x fits) that a task works on at a time: arrays that stay in a core's cache.
CELLS = 25_000
#: Most different (group, features, label) whose weights are added up by draw before the steps, and rows that one of them must stand for.
PATTERNS, PATTERN_ROWS = 2_000, 8
#: Most parameters whose third derivatives are added up.
CUBIC = 10
#: Poisson(1) weights by their cumulative probabilities, and by the first 16 bits of a number; 255 where these don't settle it.
_CDF = np.cumsum(np.exp(-1.0) / np.cumprod([1, *range(1, 16)]))
_LOW, _HIGH = (np.searchsorted(_CDF, at, side="right") for at in (np.arange(65536) / 65536, (np.arange(1, 65537) - 2.0**-30) / 65536))
_WEIGHT = np.where(_LOW == _HIGH, _LOW, 255).astype(np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser of a counter-based generator; it works in place."""
    with np.errstate(over="ignore"):
        high = np.empty_like(x)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x ^= np.right_shift(x, np.uint64(shift), out=high)
            if factor > 1:
                x *= np.uint64(factor)
        return x


def draw_weights(clusters: np.ndarray, draws: int, seed: int, only: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Poisson(1) weights of hashed clusters (rows) in each draw (columns), or in some of the draws."""
    with np.errstate(over="ignore"):
        streams = mixed((np.arange(1, draws + 1, dtype=np.uint64)[only] + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD1342543DE82EF95))
        bits = mixed(clusters.astype(np.int64).view(np.uint64)[:, None] + streams[None])
    out = _WEIGHT[(bits >> np.uint64(48)).view(np.int64)].astype(np.float64)
    open_ = out == 255
    out[open_] = np.searchsorted(_CDF, (bits[open_] >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right")
    return out


@dataclass(frozen=True)
class Fit:
    group: object
    #: The inverse strength, and the draw (None: the rows as they are).
    c: float
    draw: int | None
    intercept: float
    coefficients: tuple[float, ...]
    converged: bool


def _sums(rows: DataFrame, per_batch, width: int) -> dict:  # noqa: ANN001
    """Sums by (group, fit) of what per_batch returns for each batch: a dict of arrays (fits x width) by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            for g, part in per_batch(b).items():
                total[g] = total[g] + part if g in total else part
        for g, s in total.items():
            for low in range(0, len(s), 5000):
                part = s[low : low + 5000]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(part), pa.string()), pa.array(np.arange(low, low + len(part), dtype=np.int32)), pa.array(part.tolist(), pa.list_(pa.float64()))], names=["g", "fit", "s"])

    every = rows.mapInArrow(run, "g string, fit int, s array<double>")
    added = every.select("g", "fit", F.posexplode("s").alias("at", "v")).groupBy("g", "fit", "at").agg(F.sum("v").alias("v"))
    out: dict = {}
    for r in added.toLocalIterator():  # groups x fits x width
        out.setdefault(r.g, {}).setdefault(r.fit, np.zeros(width))[r["at"]] = r.v
    return out


def _design(b: pa.RecordBatch, p: int) -> tuple[list[tuple[str, np.ndarray]], np.ndarray, np.ndarray]:
    """Groups with the places of their rows, rows with a leading 1, and labels of a batch."""
    groups, x = _features(b, p)
    return groups, np.column_stack([np.ones(len(x)), x]), np.asarray(b.column(2), dtype=np.float64)


def _features(b: pa.RecordBatch, p: int) -> tuple[list[tuple[str, np.ndarray]], np.ndarray]:
    x = np.asarray(b.column(1).flatten(), dtype=np.float64)
    sizes = np.diff(np.asarray(b.column(1).offsets))
    x = x.reshape(b.num_rows, p) if (sizes == p).all() else _ragged(x, sizes, p)
    coded = b.column(0).dictionary_encode()
    at = np.asarray(coded.indices)
    return [(g, np.flatnonzero(at == i)) for i, g in enumerate(coded.dictionary.to_pylist())], x


def _ragged(x: np.ndarray, sizes: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((len(sizes), p))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = x
    return out


def _told(rows: DataFrame, group: str | None, features: str, label: str, cluster: str | None, held: bool = False) -> tuple[DataFrame, int, bool]:
    """The rows that count, how many features they have, and whether few of them differ, which is asked where rows are drawn by cluster."""
    g = F.lit("") if group is None else F.col(group).cast("string")
    kept = rows.select(g.alias("g"), F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), (F.xxhash64(cluster) if cluster else F.lit(0).cast("long")).alias("h")).where("g is not null and x is not null and y is not null")
    kept = kept if held else kept.persist(StorageLevel.MEMORY_AND_DISK)  # read once a step; lost blocks are worked out again
    if cluster is None:
        return kept, int(kept.agg(F.max(F.size("x")).alias("p")).first().p or 0), False
    about = kept.agg(F.max(F.size("x")).alias("p"), F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("g", "x", "y")).alias("different")).first()
    return kept, int(about.p or 0), about.different <= min(PATTERNS, about.n / PATTERN_ROWS)


def _by_pattern(kept: DataFrame, p: int, draws: int, seed: int) -> DataFrame:
    """g, x and y of the different rows and w, the sums of their weights in each draw as the bytes of doubles; whole numbers, so the order of adding doesn't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, bytes], np.ndarray] = {}
        for b in batches:
            groups, x, y = _design(b, p)
            h = np.asarray(b.column(3))
            for g, own in groups:
                kinds, kind = np.unique(np.column_stack([x[own, 1:], y[own]]) + 0.0, axis=0, return_inverse=True)
                clusters, cluster = np.unique(h[own], return_inverse=True)
                order = np.argsort(kind.ravel(), kind="stable")
                starts, members = np.searchsorted(kind.ravel()[order], np.arange(len(kinds))), cluster.ravel()[order]
                wide = max(1, 10 * CELLS // len(own))
                sums = np.concatenate([np.add.reduceat(draw_weights(clusters, draws, seed, slice(low, low + wide)).astype(np.float32)[members], starts, axis=0) for low in range(0, draws, wide)], axis=1)
                for k, s in zip(kinds, sums, strict=True):
                    at = (g, k.tobytes())
                    total[at] = total[at] + s if at in total else s.astype(np.float64)
        rows = [(g, np.frombuffer(k), w.tobytes()) for (g, k), w in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1][:-1].tolist() for r in rows], pa.list_(pa.float64())), pa.array([r[1][-1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.binary())], names=["g", "x", "y", "w"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(w=[sum(np.frombuffer(w) for w in pdf["w"]).tobytes()])

    kind = "g string, x array<double>, y double, w binary"
    return kept.mapInArrow(run, kind).groupBy("g", "x", "y").applyInPandas(added, kind)  # a group holds a row from each task


def _measured(rows: DataFrame, p: int, n_fits: int, weigh, tried: dict, moving: dict) -> dict:  # noqa: ANN001
    """Loss, gradient and upper Hessian of the fits that still move, at their parameters (zeros where a group is new), by group and fit."""
    upper = np.triu_indices(p + 1)
    width = len(upper[0]) + p + 2

    def per_batch(b: pa.RecordBatch) -> dict:
        groups, x, y = _design(b, p)
        out = {}
        for g, own in groups:
            fits = moving.get(g, np.arange(n_fits))
            if not len(fits):
                continue
            beta = tried[g][fits] if g in tried else np.zeros((len(fits), p + 1))
            total = np.zeros((len(fits), width))
            step = max(1, CELLS // len(fits))
            for low in range(0, len(own), step):
                at = own[low : low + step]
                xx, yy = x[at], y[at][:, None]
                z, w = xx @ beta.T, weigh(b, at, fits)
                e = np.abs(z)
                np.exp(np.negative(e, out=e), out=e)
                total[:, 0] += (w * (np.maximum(z, 0) + np.log1p(e) - yy * z)).sum(axis=0)
                q = np.where(z >= 0, 1.0, e)
                q /= np.add(e, 1, out=e)
                wq = w * q
                total[:, 1 : p + 2] += (wq - w * yy).T @ xx
                np.subtract(1, q, out=q)
                total[:, p + 2 :] += np.multiply(wq, q, out=wq).T @ (xx[:, upper[0]] * xx[:, upper[1]])
            out[g] = total
        return out

    return {g: {int(moving[g][i]) if g in moving else i: s for i, s in of.items()} for g, of in _sums(rows, per_batch, width).items()}


def _steps(rows: DataFrame, p: int, penalty: np.ndarray, weigh, start: dict, most_steps: int, tol: float) -> dict:  # noqa: ANN001
    """(parameters, converged) of all fits by group, by Newton steps from the start, or from zeros."""
    n_fits, upper = len(penalty), np.triu_indices(p + 1)
    best: dict = {}
    tried: dict = {g: b.copy() for g, b in start.items()}
    done: dict = {}
    for k in range(most_steps):
        sums = _measured(rows, p, n_fits, weigh, tried, {g: np.flatnonzero(~d) for g, d in done.items()})
        if k == 0:
            tried = {g: tried.get(g, np.zeros((n_fits, p + 1))) for g in sums}
            best = {g: (np.full(n_fits, np.inf), tried[g].copy(), np.zeros((n_fits, p + 1))) for g in sums}
            done = {g: np.zeros(n_fits, dtype=bool) for g in sums}
        for g, of in sums.items():
            score, beta, move = best[g]
            for i, s in of.items():
                b = tried[g][i]
                value = s[0] + (penalty[i] * b**2).sum() / 2
                if value > score[i] + 1e-9 * abs(score[i]):
                    move[i] /= 2
                    done[g][i] = np.abs(move[i]).max() < tol
                else:
                    hessian = np.zeros((p + 1, p + 1))
                    hessian[upper] = s[p + 2 :]
                    hessian += np.triu(hessian, 1).T + np.diag(penalty[i])
                    move[i] = -np.linalg.lstsq(hessian, s[1 : p + 2] + penalty[i] * b, rcond=None)[0]
                    score[i], beta[i] = value, b
                    size = np.abs(move[i]).max() / max(1.0, np.abs(b).max())
                    done[g][i] = size < tol
                    if size < tol**0.5 / 100:  # moves shrink by their square from here, so this one ends it
                        beta[i], done[g][i] = b + move[i], True
                tried[g][i] = beta[i] + move[i]
        if all(d.all() for d in done.values()):
            break
    return {g: (best[g][1], done[g]) for g in best}


def _near(kept: DataFrame, p: int, penalty: np.ndarray, weigh, centre: dict) -> dict:  # noqa: ANN001
    """Parameters of all draws by group from one pass at their group's centre: the root of the gradient's expansion to the second order, the first with many parameters."""
    draws, d = len(penalty), p + 1
    pairs = np.triu_indices(d)
    triples = np.array([(i, j, k) for i in range(d) for j in range(i, d) for k in range(j, d)] if d <= CUBIC else [], dtype=int).reshape(-1, 3)
    width = d + len(pairs[0]) + len(triples)

    def per_batch(b: pa.RecordBatch) -> dict:
        groups, x, y = _design(b, p)
        out = {}
        for g, own in groups:
            total = np.zeros((draws, width))
            step = max(1, CELLS // draws)
            for low in range(0, len(own), step):
                at = own[low : low + step]
                xx = x[at]
                q = (1 / (1 + np.exp(-np.clip(xx @ centre[g], -500, 500))))[:, None]
                bend = q * (1 - q)
                two = xx[:, pairs[0]] * xx[:, pairs[1]]
                three = xx[:, triples[:, 0]] * xx[:, triples[:, 1]] * xx[:, triples[:, 2]]
                total += weigh(b, at, slice(None)).T @ np.column_stack([(q - y[at][:, None]) * xx, bend * two, bend * (1 - 2 * q) * three])
            out[g] = total
        return out

    out = {}
    for g, of in _sums(kept, per_batch, width).items():
        s = np.stack([of[i] for i in range(draws)])
        hessian, third = np.zeros((draws, d, d)), np.zeros((draws, d, d, d))
        hessian[:, pairs[0], pairs[1]] = hessian[:, pairs[1], pairs[0]] = s[:, d : d + len(pairs[0])]
        for a, b, c in ((0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)):
            third[:, triples[:, a], triples[:, b], triples[:, c]] = s[:, d + len(pairs[0]) :]
        inverse = np.linalg.pinv(hessian + penalty[:, :, None] * np.eye(d), hermitian=True)
        pull = s[:, :d] + penalty * centre[g]
        first = move = -np.einsum("nij,nj->ni", inverse, pull)
        for _ in range(20):
            move = -np.einsum("nij,nj->ni", inverse, pull + np.einsum("nijk,nj,nk->ni", third, move, move) / 2)
            far = ~(np.abs(move).max(axis=1) <= 2 * np.abs(first).max(axis=1))  # too far for an expansion
            move[far] = first[far]
        out[g] = centre[g] + move
    return out


def logistic_many(rows: DataFrame, features: str, label: str, strengths: list[float], *, group: str | None = None, draws: int = 0, cluster: str | None = None, seed: int = 7, most_steps: int = 60, tol: float = 1e-8, held: bool = False) -> list[Fit]:
    """L2 logistic models for every group and inverse strength, or for every draw of clusters too; intercepts aren't penalised.

    features: a column of arrays, as long for all rows of a group. Minimises the sum of (weighted) losses + |b|^2 / 2c. A step that
    doesn't lower its fit's objective is halved. Rows without a group, features or label don't count; a group without rows has no fits.
    held: the caller has persisted the rows, or what they are filtered from, so no copy of them is.
    """
    if draws and len(strengths) != 1:
        raise ValueError("draws are made for one strength")
    if draws and cluster is None:
        raise ValueError("draws need a cluster")
    kept, p, few = _told(rows, group, features, label, cluster, held)
    n_fits = draws or len(strengths)
    penalty = np.concatenate([[0.0], np.ones(p)])[None] / np.array([strengths[0]] * n_fits if draws else strengths)[:, None]
    ones = lambda b, at, fits: 1.0
    if draws and few:
        sums = _by_pattern(kept, p, draws, seed).persist(StorageLevel.MEMORY_AND_DISK)
        found = _steps(sums, p, penalty, lambda b, at, fits: np.stack([np.frombuffer(w.as_buffer()) for w in b.column(3).take(pa.array(at))])[:, fits], {}, most_steps, tol)
        sums.unpersist()
    elif draws:
        weigh = lambda b, at, fits: draw_weights(np.asarray(b.column(3))[at], draws, seed, fits)
        whole = _steps(kept, p, penalty[:1], ones, {}, most_steps, tol)
        found = _steps(kept, p, penalty, weigh, _near(kept, p, penalty, weigh, {g: b[0] for g, (b, _) in whole.items()}), most_steps, tol)
    else:
        found = _steps(kept, p, penalty, ones, {}, most_steps, tol)
    if not held:
        kept.unpersist()
    return [Fit(None if group is None else g, strengths[0] if draws else strengths[i], i if draws else None, float(b[i, 0]), tuple(map(float, b[i, 1:])), bool(ok[i])) for g, (b, ok) in sorted(found.items()) for i in range(n_fits)]


def ridge_many(rows: DataFrame, features: str, label: str, alphas: list[float], *, group: str | None = None, draws: int = 0, cluster: str | None = None, seed: int = 7, held: bool = False) -> list[Fit]:
    """Least squares with alpha |b|^2 on the sum of squares for every group and alpha, from one pass; c of a fit is its alpha. held: see logistic_many()."""
    if draws and (len(alphas) != 1 or cluster is None):
        raise ValueError("draws are made for one alpha, of a cluster")
    kept, p, _ = _told(rows, group, features, label, cluster, held)
    upper = np.triu_indices(p + 1)
    n_fits = draws or 1
    step = max(1, CELLS // n_fits)

    def per_batch(b: pa.RecordBatch) -> dict:
        groups, x, y = _design(b, p)
        h, out = np.asarray(b.column(3)), {}
        for g, own in groups:
            total = np.zeros((n_fits, len(upper[0]) + p + 1))
            for low in range(0, len(own), step):
                at = own[low : low + step]
                w = draw_weights(h[at], draws, seed) if draws else np.ones((len(at), 1))
                total += w.T @ np.column_stack([x[at] * y[at][:, None], x[at][:, upper[0]] * x[at][:, upper[1]]])
            out[g] = total
        return out

    out = []
    for g, of in sorted(_sums(kept, per_batch, len(upper[0]) + p + 1).items()):
        for i in range(draws or len(alphas)):
            s, alpha = of[i if draws else 0], alphas[0 if draws else i]
            m = np.zeros((p + 1, p + 1))
            m[upper] = s[p + 1 :]
            m += np.triu(m, 1).T + np.diag([0.0, *[alpha] * p])
            b = np.linalg.lstsq(m, s[: p + 1], rcond=None)[0]
            out.append(Fit(None if group is None else g, alpha, i if draws else None, float(b[0]), tuple(map(float, b[1:])), True))
    if not held:
        kept.unpersist()
    return out


def linear_scores(rows: DataFrame, features: str, group: str, fits: list[Fit], keep: list[str]) -> DataFrame:
    """group, the columns to keep, and z0, z1, ...: the linear scores of a row by the fits of its group, in the order of the list; null where it has fewer.

    Features are added up one after the other, so rows with the same features have the same score wherever they lie.
    """
    by: dict = {}
    for f in fits:
        by.setdefault(f.group, []).append(f)
    p, width = max((len(f.coefficients) for f in fits), default=0), max(map(len, by.values()), default=0)
    known = rows.select(F.col(group).cast("string").alias(group), F.col(features).cast("array<double>").alias(features), *keep).where(F.col(group).isNotNull() & F.col(features).isNotNull())
    names = [group, *keep, *[f"z{i}" for i in range(width)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups, x = _features(b, p)
            z, there = np.zeros((width, b.num_rows)), np.zeros((width, b.num_rows), dtype=bool)
            for g, own in groups:
                columns = np.ascontiguousarray(x[own].T)
                for i, f in enumerate(by.get(g, [])):
                    s = np.full(len(own), f.intercept)
                    for column, v in zip(columns, f.coefficients, strict=False):
                        if v:
                            s += column * v
                    z[i, own], there[i, own] = s, True
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], *[pa.array(z[i], mask=~there[i]) for i in range(width)]], names=names)

    kinds = {f.name: f.dataType.simpleString() for f in known.schema.fields}
    return known.mapInArrow(run, ", ".join(f"`{n}` {kinds.get(n, 'double')}" for n in names))


def intervals(fits: list[Fit], names: list[str], level: float = 0.95) -> list[tuple]:
    """(name, mean, low, high, share above 0) of the intercept and each coefficient over the draws; a row a parameter."""
    values = np.array([[f.intercept, *f.coefficients] for f in fits])
    low, high = np.quantile(values, [(1 - level) / 2, (1 + level) / 2], axis=0)
    return [(n, float(values[:, i].mean()), float(low[i]), float(high[i]), float((values[:, i] > 0).mean())) for i, n in enumerate(["intercept", *names])]


def draw_sums(rows: DataFrame, cluster: str, values: list[str], draws: int, *, group: str | None = None, seed: int = 7) -> DataFrame:
    """g, draw and, for each value, its sum over the rows weighted by the draw; drawn, the sum of the weights, and clusters, how many rows the group has.

    A task holds one batch and the sums of its groups and draws, whatever the number of rows.
    """
    g = F.lit("") if group is None else F.col(group).cast("string")
    kept = rows.select(g.alias("g"), F.xxhash64(cluster).alias("h"), F.array(*[F.col(v).cast("double") for v in values], F.lit(1.0)).alias("v"))
    width = len(values) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        size: dict = {}
        for b in batches:
            coded, h, v = b.column(0).dictionary_encode(), np.asarray(b.column(1)), np.asarray(b.column(2).flatten(), dtype=np.float64).reshape(-1, width)
            groups = np.asarray(coded.indices.fill_null(-1))
            for i, own in enumerate(coded.dictionary.to_pylist()):
                at = np.flatnonzero(groups == i)
                size[own] = size.get(own, 0) + len(at)
                for low in range(0, len(at), max(1, CELLS // draws)):
                    part = at[low : low + max(1, CELLS // draws)]
                    s = draw_weights(h[part], draws, seed).T @ np.nan_to_num(v[part])
                    total[own] = total[own] + s if own in total else s
        for own, s in total.items():
            for low in range(0, draws, 5000):
                part = np.column_stack([s[low : low + 5000], np.full(len(s[low : low + 5000]), size[own])])
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(part), pa.string()), pa.array(np.arange(low, low + len(part), dtype=np.int32)), pa.array(part.tolist(), pa.list_(pa.float64()))], names=["g", "draw", "s"])

    every = kept.mapInArrow(run, "g string, draw int, s array<double>")
    return every.groupBy("g", "draw").agg(*[F.sum(F.col("s")[i]).alias(c) for i, c in enumerate([*values, "drawn", "clusters"])])
