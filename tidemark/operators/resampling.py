"""Bootstrap and permutation tests: clusters are summed in Spark, draws are dealt over tasks, each with its own seed."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.newton import draw_sums
from tidemark.sources.scratch import shared_root


def cluster_sums(rows: DataFrame, cluster: str, baseline: str, candidate: str, actual: str, stratum: str | None = None) -> DataFrame:
    """stratum, summed squared errors of both predictions and rows of each cluster."""
    e = lambda c: F.sum((F.col(actual) - F.col(c)) * (F.col(actual) - F.col(c)))
    group = F.lit("all") if stratum is None else F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    return rows.groupBy(cluster).agg(F.min(group).alias("stratum"), e(baseline).alias("baseline"), e(candidate).alias("candidate"), F.count("*").alias("n"))


def bootstrap_improvement(rows: DataFrame, cluster: str, baseline: str, candidate: str, actual: str, *, stratum: str | None = None, draws: int = 5000, seed: int = 7) -> DataFrame:
    """draw and improvement (mean squared error of the baseline less that of the candidate) over resampled clusters.

    Clusters are resampled by Poisson weights from a hash of the cluster and the draw, so that a task holds one Arrow batch and the sums
    of its strata and draws, however many clusters there are. Each stratum's sums are scaled to as many clusters as it has, which the
    same pass counts, so a draw holds every stratum in its own size.
    """
    per = cluster_sums(rows, cluster, baseline, candidate, actual, stratum)
    sums = draw_sums(per, cluster, ["baseline", "candidate", "n"], draws, group="stratum", seed=seed).where("drawn > 0")
    strata = sums.withColumn("w", F.col("clusters") / F.col("drawn"))
    return strata.groupBy("draw").agg((F.sum((F.col("baseline") - F.col("candidate")) * F.col("w")) / F.sum(F.col("n") * F.col("w"))).alias("improvement"))


def bootstrap_ridge(rows: DataFrame, cluster: str, features: list[str], label: str, alpha: float, *, draws: int = 1000, seed: int = 7) -> DataFrame:
    """draw, feature and coefficient of ridge regressions on resampled clusters; the intercept isn't penalised.

    Clusters are reduced to their sums of products first, so a draw is a weighted sum of small rows and one small solve.
    """
    names = ["intercept", *features]
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    moments = [F.sum(x[i] * x[j]).alias(f"m{n}") for n, (i, j) in enumerate(pairs)] + [F.sum(c * F.col(label)).alias(f"v{i}") for i, c in enumerate(x)]
    columns = [f"m{n}" for n in range(len(pairs))] + [f"v{i}" for i in range(len(x))]
    drawn = draw_sums(rows.groupBy(cluster).agg(*moments), cluster, columns, draws, seed=seed).select("draw", *columns)
    size = len(names)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sums = pdf.iloc[0]
        gram = np.zeros((size, size))
        for n, (i, j) in enumerate(pairs):
            gram[i, j] = gram[j, i] = sums[f"m{n}"]
        b = np.linalg.solve(gram + alpha * np.diag([0.0, *[1.0] * len(features)]), sums[[f"v{i}" for i in range(size)]].to_numpy(dtype=float))
        return pd.DataFrame({"draw": int(key[0]), "feature": names, "coefficient": b})

    return drawn.groupBy("draw").applyInPandas(solve, "draw int, feature string, coefficient double")


def interval(draws: DataFrame, value: str = "improvement", level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    return draws.agg(F.count("*").alias("n_draws"), F.avg(value).alias("mean"), F.percentile(value, a).alias("low"), F.percentile(value, 1 - a).alias("high"), F.avg((F.col(value) > 0).cast("double")).alias("p_positive"))


def stability_label(improvement: float, by_origin: list[float], low: float, high: float) -> str:
    """supported, adverse, mixed or unclear, from the interval and how many origins agree in sign."""
    if low > 0 and sum(x > 0 for x in by_origin) == len(by_origin):
        return "supported"
    if high < 0 and sum(x < 0 for x in by_origin) == len(by_origin):
        return "adverse"
    return "mixed" if any(x > 0 for x in by_origin) and any(x < 0 for x in by_origin) else "unclear"


#: Rows of a slot that a permutation is dealt over in one task, where there are more than the least number of slots hold.
SLOT_ROWS = 250_000


def permutation_heterogeneity(rows: DataFrame, group: str, value: str, *, stratum: str | None = None, key: str | None = None, draws: int = 500, seed: int = 7, slots: int = 64) -> DataFrame:
    """n_draws, spread (of group means, weighted) and p_value: how often a random permutation of the groups over the rows spreads as much.

    A permutation is drawn in two steps, which together are exact: how many rows of each slot (rows by hash) go to each
    group is hypergeometric, in the groups' own counts and within each stratum; then each slot deals these counts out over
    its rows. So a task holds one slot's values, and only groups x slots x draws small counts are made beforehand; there are
    more slots than asked for where one would hold more than SLOT_ROWS rows on average. Draws depend on the rows alone, by
    key where one is named, and not on how they are partitioned. Values are written once before they are counted: sums of
    doubles may differ between two runs of a plan, and rows that change slots then don't fit their counts. Rows without a
    group or value don't count.
    """
    known = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    layer = F.lit("all") if stratum is None else F.coalesce(F.col(stratum).cast("string"), F.lit(""))
    shared_root(rows.sparkSession)
    fixed = known.select(layer.alias("stratum"), F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v"), F.xxhash64(*([key] if key else rows.columns)).alias("row")).checkpoint()
    base = fixed.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("s")).orderBy("g").collect()  # one row a group
    names, sizes = [r.g for r in base], np.array([r.n for r in base], dtype=float)
    if not names:
        return fixed.agg(F.lit(0).cast("long").alias("n_draws"), F.lit(None).cast("double").alias("spread"), F.lit(None).cast("double").alias("p_value"))
    kept = fixed.withColumn("slot", F.pmod("row", F.lit(max(slots, -(-int(sizes.sum()) // SLOT_ROWS)))))
    mean = sum(r.s for r in base) / sizes.sum()
    observed = float((sizes * (np.array([r.s for r in base]) / sizes - mean) ** 2).sum() / sizes.sum())
    counts: dict = {}
    for r in kept.groupBy("stratum", "slot", "g").count().toLocalIterator():  # strata x slots x groups
        counts.setdefault(r.stratum, {}).setdefault(r.slot, {})[r.g] = r["count"]
    dealt: dict[tuple[str, int], np.ndarray] = {}
    for layer_name, of in sorted(counts.items()):
        g = np.random.default_rng([seed, zlib.crc32(layer_name.encode())])
        left = np.tile([sum(n.get(x, 0) for n in of.values()) for x in names], (draws, 1)).astype(np.int64)
        for slot, n in sorted(of.items()):
            got = np.vstack([g.multivariate_hypergeometric(row, sum(n.values())) for row in left])
            left -= got
            dealt[layer_name, slot] = got
    shared = rows.sparkSession.sparkContext.broadcast(dealt)

    def permute(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(["row", "v"])["v"].to_numpy()
        g = np.random.default_rng([seed + 1, int(key[1]), zlib.crc32(str(key[0]).encode())])
        sums = np.zeros((draws, len(names)))
        for n, take in enumerate(shared.value[key[0], int(key[1])]):
            before = np.concatenate([[0.0], np.cumsum(g.permutation(values))])
            ends = np.cumsum(take)
            sums[n] = before[ends] - before[ends - take]
        return pd.DataFrame({"draw": np.repeat(np.arange(draws), len(names)), "g": np.tile(names, draws), "s": sums.ravel()})

    drawn = kept.drop("g").groupBy("stratum", "slot").applyInPandas(permute, "draw int, g string, s double").groupBy("draw", "g").agg(F.sum("s").alias("s"))
    size = F.element_at(F.create_map(*[x for g, n in zip(names, sizes, strict=True) for x in (F.lit(g), F.lit(float(n)))]), F.col("g"))
    per = drawn.withColumn("n", size).groupBy("draw").agg((F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - mean, F.lit(2))) / float(sizes.sum())).alias("v"))
    as_much = F.col("v") >= observed * (1 - 1e-12)
    return per.agg(F.count("*").alias("n_draws"), F.lit(observed).alias("spread"), ((F.count_if(as_much) + 1) / (F.count("*") + 1)).alias("p_value"))
