"""Models on MLlib: a mixed-type preprocessor, regularised linear models in stated conventions, hazards, calibration, explanations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from tidemark.functions.scalars import finite, logit
from tidemark.operators.distribution import exact_quantiles, running

OTHER = "__OTHER__"


@dataclass(frozen=True)
class Preprocessor:
    """Fitted on training rows only; compiled to column expressions.

    Numbers: nulls and what isn't finite become the training median, with a flag column where training had any.
    Categories: one column for each of the commonest training levels and OTHER for all further ones; it is constant, and so
    left out, where training has no further ones, and a new level gives zeros then. Every column is scaled by its training
    mean and population standard deviation, and constant ones are left out. Columns stay in the order of the raw features.
    """

    columns: tuple[tuple[str, str, float, float], ...]
    medians: dict[str, float]
    levels: dict[str, tuple[str, ...]]

    def expressions(self) -> list[Column]:
        out = []
        for raw, kind, mean, sd in self.columns:
            if kind == "value":
                x = F.coalesce(_number(raw), F.lit(self.medians[raw]))
            elif kind == "missing":
                x = _number(raw).isNull().cast("double")
            elif kind == OTHER:
                x = (~F.coalesce(F.col(raw), F.lit("__NULL__")).isin(*self.levels[raw])).cast("double")
            else:
                x = (F.coalesce(F.col(raw), F.lit("__NULL__")) == kind[3:]).cast("double")
            out.append(((x - mean) / sd).alias(self.name(raw, kind)))
        return out

    @staticmethod
    def name(raw: str, kind: str) -> str:
        return raw if kind == "value" else f"{raw}__{kind.removeprefix('is:')}"

    def names(self) -> list[str]:
        return [self.name(raw, kind) for raw, kind, _, _ in self.columns]

    def transform(self, df: DataFrame) -> DataFrame:
        """df with a features vector; the scaled columns aren't kept."""
        wide = df.select("*", F.array(*self.expressions()).alias("__x"))
        from pyspark.ml.functions import array_to_vector

        return wide.withColumn("features", array_to_vector("__x")).drop("__x")


def _number(raw: str) -> Column:
    return finite(F.col(raw).cast("double"))


def fit_preprocessor(train: DataFrame, numbers: list[str], categories: list[str], most_levels: int = 100) -> Preprocessor:
    """Exact medians by bracketed ranks, all columns at a time; one aggregation for levels each, one for means and spreads."""
    cells = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), _number(c).alias("x")) for c in numbers])).alias("c")).select("c.*") if numbers else None
    found = {r["name"]: r.q[0] for r in exact_quantiles(cells, "x", [0.5], ["name"]).collect()} if numbers else {}  # one row a column
    medians = {c: float(found.get(c) or 0.0) for c in numbers}
    gaps = train.agg(F.lit(0).alias("__"), *[F.count_if(_number(c).isNull()).alias(c) for c in numbers]).first()
    kinds = [(c, k) for c in numbers for k in ("value", "missing") if k == "value" or gaps[c]]
    levels: dict[str, tuple[str, ...]] = {}
    for c in categories:
        kept = train.groupBy(F.coalesce(c, F.lit("__NULL__")).alias("v")).count().orderBy(F.desc("count"), "v").limit(most_levels).collect()
        levels[c] = tuple(sorted(r.v for r in kept))
        kinds += [(c, f"is:{v}") for v in levels[c]] + [(c, OTHER)]
    bare = Preprocessor(tuple((raw, kind, 0.0, 1.0) for raw, kind in kinds), medians, levels)
    cols = bare.expressions()
    stats = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    kept = [(raw, kind, float(stats[f"m{i}"]), float(stats[f"s{i}"])) for i, (raw, kind) in enumerate(kinds) if (stats[f"s{i}"] or 0) > 1e-12]
    return Preprocessor(tuple(kept), medians, levels)


def fit_preprocessors(train: DataFrame, group: str, numbers: list[str], categories: list[str], most_levels: int = 100) -> dict:
    """fit_preprocessor() for every value of a group column at once: medians, gaps and levels of all groups come from one job each."""
    cells = train.select(group, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), _number(c).alias("x")) for c in numbers])).alias("c")).select(group, "c.*")
    medians: dict = {}
    for r in exact_quantiles(cells, "x", [0.5], [group, "name"]).collect():  # groups x columns
        medians.setdefault(r[group], {})[r["name"]] = float(r.q[0] or 0.0)
    gaps = {r[group]: r for r in train.groupBy(group).agg(*[F.count_if(_number(c).isNull()).alias(c) for c in numbers]).collect()}
    levels: dict = {}
    if categories:
        kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(c, F.lit("__NULL__")).alias("v")) for c in categories])).alias("k")
        counted = train.select(group, kinds).select(group, "k.*").groupBy(group, "name", "v").count()
        first = Window.partitionBy(group, "name").orderBy(F.desc("count"), "v")
        for r in counted.withColumn("at", F.row_number().over(first)).where(F.col("at") <= most_levels).collect():
            levels.setdefault((r[group], r["name"]), []).append(r.v)
    bare = {}
    for g, gap in gaps.items():
        own = {c: tuple(sorted(levels[g, c])) for c in categories}
        columns = [(c, k) for c in numbers for k in ("value", "missing") if k == "value" or gap[c]]
        columns += [(c, k) for c in categories for k in (*(f"is:{v}" for v in own[c]), OTHER)]
        bare[g] = Preprocessor(tuple((raw, kind, 0.0, 1.0) for raw, kind in columns), {c: medians.get(g, {}).get(c, 0.0) for c in numbers}, own)
    out = {}
    kinds = list(dict.fromkeys((raw, kind) for pre in bare.values() for raw, kind, *_ in pre.columns))
    own = {g: dict(zip([(raw, kind) for raw, kind, *_ in pre.columns], pre.expressions(), strict=True)) for g, pre in bare.items()}
    cells = [reduce(lambda out, g, k=k: F.when(F.col(group) == g, own[g][k]).otherwise(out), [g for g in own if k in own[g]], F.lit(None).cast("double")).alias(f"x{j}") for j, k in enumerate(kinds)]
    spreads = [s for j in range(len(kinds)) for s in (F.avg(f"x{j}").alias(f"m{j}"), F.stddev_pop(f"x{j}").alias(f"s{j}"))]
    stats = {r[group]: r for r in train.select(group, *cells).groupBy(group).agg(F.count("*").alias("n"), *spreads).collect()} if spreads else {}
    for g, pre in bare.items():
        told = {k: (stats[g][f"m{j}"], stats[g][f"s{j}"]) for j, k in enumerate(kinds)} if g in stats else {}
        kept = [(raw, kind, *map(float, told[raw, kind])) for raw, kind, *_ in pre.columns if (told.get((raw, kind), (0, 0))[1] or 0) > 1e-12]
        out[g] = Preprocessor(tuple(kept), pre.medians, pre.levels)
    return out


def _spread(df: DataFrame, label: str) -> tuple[int, float]:
    r = df.agg(F.count(label).alias("n"), F.stddev_pop(label).alias("s")).first()
    return r.n, float(r.s)


def ridge(train: DataFrame, label: str, alpha: float, *, per_row: bool = False):  # noqa: ANN201
    """Least squares with alpha * |beta|^2 on the sum of squares, or on their mean (per_row). features should be standardised.

    MLlib scales the label by its spread, so the penalty is scaled alike.
    """
    n, s = _spread(train, label)
    return LinearRegression(featuresCol="features", labelCol=label, regParam=alpha * s / (1 if per_row else n), elasticNetParam=0.0, solver="normal").fit(train)


def elastic_net(train: DataFrame, label: str, alpha: float, l1: float):  # noqa: ANN201
    """Minimises |y - Xb|^2 / 2n + alpha * l1 * |b|_1 + alpha * (1 - l1) / 2 * |b|^2."""
    _, s = _spread(train, label)
    r = alpha * (l1 + s * (1 - l1))
    return LinearRegression(featuresCol="features", labelCol=label, regParam=r, elasticNetParam=alpha * l1 / r, maxIter=500, tol=1e-12).fit(train)


def logistic(train: DataFrame, label: str, c: float, family: str = "binomial"):  # noqa: ANN201
    """L2 logistic regression with inverse strength c; the intercept isn't penalised."""
    n = train.count()
    return LogisticRegression(featuresCol="features", labelCol=label, regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10, family=family).fit(train)


def boosted(train: DataFrame, label: str, *, classify: bool, rounds: int = 20, depth: int = 3, rate: float = 0.1, seed: int = 7):  # noqa: ANN201
    kind = GBTClassifier if classify else GBTRegressor
    return kind(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed).fit(train)


def probability(model, df: DataFrame, name: str = "p") -> DataFrame:  # noqa: ANN001
    """df with the probability of class 1."""
    out = model.transform(df)
    return out.withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def calibration_line(scored: DataFrame, p: str, label: str) -> tuple[float, float]:
    """Intercept and slope of the label on the logit of the probability; 0 and 1 if it is calibrated."""
    rows = VectorAssembler(inputCols=["__z"], outputCol="__f").transform(scored.withColumn("__z", logit(F.col(p))))
    model = LogisticRegression(featuresCol="__f", labelCol=label, regParam=0.0, maxIter=100, tol=1e-10).fit(rows)
    return float(model.intercept), float(model.coefficients[0])


def platt(scored: DataFrame, p: str, label: str):  # noqa: ANN201
    """A logistic regression on the logit; returns a function that calibrates a frame."""
    b, a = calibration_line(scored, p, label)
    return lambda df: df.withColumn("calibrated", 1 / (1 + F.exp(-(a * logit(F.col(p)) + b))))


def isotonic(scored: DataFrame, p: str, label: str):  # noqa: ANN201
    model = IsotonicRegression(featuresCol="__x", labelCol=label).fit(VectorAssembler(inputCols=[p], outputCol="__x").transform(scored))
    return lambda df: model.transform(VectorAssembler(inputCols=[p], outputCol="__x").transform(df)).withColumnRenamed("prediction", "calibrated").drop("__x")


def choose(candidates: list[tuple[dict, tuple[float, ...]]]) -> dict:
    """The parameters whose validation metrics come first in order; of equal ones the first listed."""
    return min(enumerate(candidates), key=lambda x: (x[1][1], x[0]))[1][0]


def contributions(pre: Preprocessor, coefficients: list[float]) -> Column:
    """A map from each raw feature to the sum of its coefficients times its scaled columns."""
    by: dict[str, Column] = {}
    for (raw, *_), x, b in zip(pre.columns, pre.expressions(), coefficients, strict=True):
        term = x * float(b)
        by[raw] = by[raw] + term if raw in by else term
    return F.create_map(*[v for raw, c in by.items() for v in (F.lit(raw), c)])


def correlations(df: DataFrame) -> DataFrame:
    """(i, j, r) for the pairs of columns of the features vector."""
    m = Correlation.corr(df, "features").first()[0].toArray()  # as many rows as features
    rows = [(i, j, None if m[i, j] != m[i, j] else float(m[i, j])) for i in range(len(m)) for j in range(i)]
    return df.sparkSession.createDataFrame(rows, "i int, j int, r double")


def grouped_ridge(df: DataFrame, group: str, features: list[str], label: str, alpha: float) -> DataFrame:
    """group, feature and coefficient of a ridge regression for each group; the intercept isn't penalised.

    Rows are reduced to their sums of products in one aggregation, so what is solved for a group is one small matrix.
    """
    import numpy as np
    import pandas as pd

    x = [F.col(c).cast("double") for c in (*features, label)]
    k = len(features)
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    known = df.where(F.col(group).isNotNull()).dropna(subset=[*features, label])
    moments = [F.covar_pop(x[i], x[j]).alias(f"m{i}_{j}") for i, j in pairs]
    per = known.groupBy(group).agg(F.count("*").alias("n"), *moments)
    kind = df.schema[group].dataType.simpleString()

    def solve(frames):  # noqa: ANN001, ANN202
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                gram = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) * row["n"]
                b = np.linalg.solve(gram + alpha * np.eye(k), np.array([row[f"m{i}_{k}"] for i in range(k)]) * row["n"])
                out += [(row[group], f, float(v)) for f, v in zip(features, b, strict=True)]
            yield pd.DataFrame(out, columns=[group, "feature", "coefficient"])

    return per.mapInPandas(solve, f"`{group}` {kind}, feature string, coefficient double")


def coefficient_stability(coefficients: DataFrame) -> DataFrame:
    """feature, n_origins, mean, least, greatest and the share of origins that agree with the commoner sign."""
    up = F.avg((F.col("coefficient") > 0).cast("double"))
    return coefficients.groupBy("feature").agg(F.count("*").alias("n_origins"), F.avg("coefficient").alias("mean"), F.min("coefficient").alias("least"), F.max("coefficient").alias("greatest"), F.greatest(up, 1 - up).alias("same_sign"))


def monotone_violations(df: DataFrame, keys: list[str], feature: str, grid: list[float], score, direction: int = 1) -> DataFrame:  # noqa: ANN001
    """How many rows' scores move against the direction anywhere on a grid of values of one feature.

    keys tell the rows apart; score takes a frame and adds p. A row meets its own grid only, so the largest group is the grid.
    """
    from pyspark.sql.window import Window

    rows = df.drop(feature).withColumn(feature, F.explode(F.array(*[F.lit(float(g)) for g in sorted(grid)])))
    step = F.col("p") - F.lag("p").over(Window.partitionBy(*keys).orderBy(feature))
    moved = score(rows).withColumn("__bad", F.coalesce((step * direction < -1e-12).cast("int"), F.lit(0)))
    return moved.groupBy(*keys).agg(F.max("__bad").alias("bad")).agg(F.count("*").alias("n_rows"), F.sum("bad").alias("n_violations"))


@F.pandas_udf(DoubleType())
def normal_cdf(z):  # noqa: ANN001, ANN201
    """P(Z <= z) of the standard normal; null stays null."""
    import math

    return z.map(lambda x: None if x != x else 0.5 * (1 + math.erf(x / math.sqrt(2))))


def exceedance(df: DataFrame, predicted: str, residuals: DataFrame, residual: str, threshold: Column) -> DataFrame:
    """df with the share of training residuals at or below threshold - predicted, ((k + 0.5) / (n + 1)); null where that is null.

    Residuals and places are counted by value and ranked together, so no pair of a row and a residual is made.
    """
    at = df.withColumn("__v", threshold - F.col(predicted))
    both = at.select("__v", F.lit(0).alias("k")).unionByName(residuals.select(F.col(residual).alias("__v"), F.lit(1).alias("k")))
    counts = both.where("__v is not null").groupBy("__v").agg(F.sum("k").alias("k"))
    told = running(counts, "__v", ["k"]).select("__v", ((F.col("upto_k") + 0.5) / (F.col("all_k") + 1)).alias("probability"))
    return at.join(told, "__v", "left").drop("__v")
