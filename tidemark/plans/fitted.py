"""Queries whose results are fitted or resampled: no SQL expresses them, so their parts are tested in closed form."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import boosting as G
from tidemark.operators import distribution as D
from tidemark.operators import models as M
from tidemark.operators import newton as N
from tidemark.operators import resampling as B
from tidemark.plans.point_in_time import order_features, person_periods, pit_order_features, with_previous
from tidemark.sources.tables import table

#: The penalties of ridge and the inverse strengths of logistic models that are tried.
ALPHAS, STRENGTHS = (0.1, 1.0, 10.0, 100.0), (0.01, 0.1, 1.0, 10.0)
NUMBERS = ["games_365", "appearances_365", "minutes_365", "opportunity_share", "prev_value", "staleness_days"]


def order_frame(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Features known before each order, its value and whether it is a large one, and more columns of the orders."""
    return _valued(order_features(spark, d, "o_orderpriority", *more).where("o_orderkey is not null"))


def _valued(orders: DataFrame) -> DataFrame:
    return orders.withColumns({"year": F.year("o_orderdate"), "y": F.log("o_totalprice"), "large": (F.col("o_totalprice") > 250000).cast("double")})


#: Years of each origin: the last of training, that of validation and that of evaluation.
ORIGINS = ((1997, 1998, 1999), (1998, 1999, 2000))


def _by_origin(frame: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """What is persisted, a row an order, and for each origin the frame's rows with origin and part: train, validation or evaluation.

    Training leaves customers out who order in the evaluation year, which the sort by customer tells that the frame has already.
    """
    year, parts = F.col("year"), {}
    for train_end, validation, evaluation in ORIGINS:
        seen = F.col("o_custkey").isNotNull() & F.coalesce(F.max(year == evaluation).over(Window.partitionBy("o_custkey")), F.lit(False))
        parts[str(evaluation)] = F.when((year <= train_end) & ~seen, "train").when(year == validation, "validation").when(year == evaluation, "evaluation")
    told = frame.select(*NUMBERS, "o_orderpriority", "y", "large", *[part.alias(f"in_{o}") for o, part in parts.items()]).persist()
    return told, {o: told.where(F.col(f"in_{o}").isNotNull()).select(*NUMBERS, "o_orderpriority", "y", "large", F.lit(o).alias("origin"), F.col(f"in_{o}").alias("part")) for o in parts}


def rolling_origin_models(spark: SparkSession, d: str) -> DataFrame:
    """Ridge and logistic models by origin: tuned on the validation year, scored on the evaluation year, on customers that training hasn't seen there.

    An origin whose customers all order in its evaluation year has nobody to train on, and no rows. All strengths of all origins are
    fitted together, and measured together. The penalty of ridge is chosen by the error, then the mean absolute error; the strength of the
    logistic model by the area under the curve (to 3 digits), then the Brier score (to 4), then the log loss. A row is scored once for
    all strengths; areas are ranked for those that are to be chosen from, and in the evaluation year for the chosen ones.
    """
    schema = "year int, model string, n long, metric double"
    frame, by = _by_origin(order_frame(spark, d))
    pres = M.fit_preprocessors(reduce(DataFrame.unionByName, by.values()).where("part = 'train'"), "origin", NUMBERS, ["o_orderpriority"])
    if not pres:
        frame.unpersist()
        return spark.createDataFrame([], schema)
    # a branch an origin: code for the columns of all origins in one would be too long to be compiled
    rows = reduce(DataFrame.unionByName, [by[o].select("origin", "part", "y", "large", F.array(*pre.expressions()).alias("x")) for o, pre in pres.items()]).persist()
    train = rows.where("part = 'train'")
    fits = N.ridge_many(train, "x", "y", list(ALPHAS), group="origin", held=True) + N.logistic_many(train, "x", "large", list(STRENGTHS), group="origin", held=True)
    scored = N.linear_scores(rows.where("part != 'train'"), "x", "origin", fits, ["part", "y", "large"]).persist()
    ridge, logistic = ({c: F.col(f"z{i}") for i, c in enumerate(grid, start)} for grid, start in ((ALPHAS, 0), (STRENGTHS, len(ALPHAS))))
    score = {c: 1 / (1 + F.exp(-z)) for c, z in logistic.items()}
    measures = {}
    for c, z in ridge.items():
        gap = F.col("y") - z
        measures["ridge", c] = (F.sqrt(F.avg(gap * gap)), F.avg(F.abs(gap)))
    for c, z in score.items():
        p = F.least(F.greatest(z, F.lit(1e-12)), F.lit(1 - 1e-12))
        measures["logistic", c] = (F.avg(F.pow(F.col("large") - p, F.lit(2))), -F.avg(F.col("large") * F.log(p) + (1 - F.col("large")) * F.log(1 - p)))
    told = {(r.origin, r.part): r for r in scored.groupBy("origin", "part").agg(F.count("*").alias("n"), *[F.struct(first.alias("first"), second.alias("second")).alias(f"{model}_{c}") for (model, c), (first, second) in measures.items()]).collect()}
    labelled = scored.withColumn("label", F.col("large").cast("int"))
    tried = labelled.where("part = 'validation'").select("origin", "label", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), z.alias("score")) for c, z in score.items()])).alias("of")).select("origin", "label", "of.*")
    areas = {(r.origin, r.c): r.auc for r in D.auc(tried, ["origin", "c"], "label", "score").collect()}
    chosen = {}
    for origin in sorted(pres):
        own = told.get((origin, "validation"))
        if own:
            chosen[origin, "ridge"] = M.choose([({"c": c}, tuple(own[f"ridge_{c}"])) for c in ALPHAS])["c"]
            ranks = {c: own[f"logistic_{c}"] for c in STRENGTHS}
            chosen[origin, "logistic"] = M.choose([({"c": c}, (-round(areas.get((origin, c)) or 0.0, 3), round(r.first, 4), r.second)) for c, r in ranks.items()])["c"]
    taken = reduce(lambda out, o: F.when(F.col("origin") == o, score[chosen[o, "logistic"]]).otherwise(out), [o for o, model in chosen if model == "logistic"], F.lit(None).cast("double"))
    last = {r.origin: r.auc for r in D.auc(labelled.where("part = 'evaluation'").select("origin", "label", taken.alias("score")), ["origin"], "label", "score").collect()} if chosen else {}
    out = []
    for (origin, model), c in chosen.items():
        own = told.get((origin, "evaluation"))
        if own:
            metric = own[f"ridge_{c}"].first if model == "ridge" else last.get(origin)
            out.append((int(origin), model, own.n, None if metric is None else round(metric, 6)))
    for df in (scored, rows, frame):
        df.unpersist()
    return spark.createDataFrame(out, schema)


def hazard_model(spark: SparkSession, d: str) -> DataFrame:
    """A discrete-time hazard of the next order by period and earlier activity, and its mean prediction by period."""
    rows = person_periods(spark, d).join(pit_order_features(spark, d).select("o_orderkey", "games_365"), "o_orderkey").withColumn("period_name", F.concat(F.lit("p"), F.col("period").cast("string"))).withColumn("y", F.col("hazard_event").cast("double")).cache()
    pre = M.fit_preprocessor(rows, ["games_365"], ["period_name"])
    held = pre.transform(rows).cache()
    model = M.logistic(held, "y", 1.0)
    held.unpersist()
    fitted = M.probability(model, pre.transform(rows))
    return fitted.groupBy("period").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("observed"), F.round(F.avg("p"), 6).alias("predicted"))


def boosted_model(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees for the order value: error by year after training."""
    frame = order_frame(spark, d).cache()
    train = frame.where("year <= 1998")
    pre = M.fit_preprocessor(train, NUMBERS, ["o_orderpriority"])
    held = pre.transform(train).cache()
    model = M.boosted(held, "y", classify=False, rounds=5)
    held.unpersist()
    return model.transform(pre.transform(frame.where("year > 1998"))).groupBy("year").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("y") - F.col("prediction"))), 6).alias("mae"))


def huber_boosted_model(spark: SparkSession, d: str) -> DataFrame:
    """Boosted trees with Huber loss for the order value, on numbers that may be null: error by year after training."""
    frame = order_frame(spark, d).persist()
    model = G.fit(frame.where("year <= 1998"), NUMBERS, "y", G.Boost(rounds=20))
    scored = model.transform(frame.where("year > 1998"))
    return scored.groupBy("year").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("y") - F.col("prediction"))), 6).alias("mae"))


def movement_states(spark: SparkSession, d: str) -> DataFrame:
    """A multinomial model of the order's status: mean probabilities by status."""
    frame = order_frame(spark, d, "o_orderstatus").withColumn("state", F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", 1.0).otherwise(2.0)).cache()
    pre = M.fit_preprocessor(frame, NUMBERS, ["o_orderpriority"])
    rows = pre.transform(frame).cache()
    out = M.logistic(rows, "state", 1.0, family="multinomial").transform(rows)
    p = vector_to_array("probability")
    return out.groupBy("state").agg(F.count("*").alias("n"), *[F.round(F.avg(p[i]), 6).alias(f"p{i}") for i in range(3)])


def _paired(spark: SparkSession, d: str) -> DataFrame:
    """Each order's log value with two predictions: the mean of its priority, and the last value of the customer where there is one.

    Only the orders are read, and shuffled once, by customer, for the means, a row a priority, and the predictions alike: what a
    later join on the customer would filter is filtered here already, so both have one plan.
    """
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority").where("o_custkey is not null")
    frame = _valued(with_previous(orders)).where("o_orderkey is not null and prev_value is not null")
    means = frame.groupBy("o_orderpriority").agg(F.avg("y").alias("baseline"))
    return frame.join(F.broadcast(means), "o_orderpriority").select("o_orderkey", "o_custkey", "year", "o_orderpriority", "y", "baseline", (0.9 * F.col("baseline") + 0.1 * F.log("prev_value")).alias("candidate"))


def cluster_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the improvement of one prediction over another, by resampled customers within market segments."""
    rows = _paired(spark, d).join(table(spark, d, "customer", "c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
    return B.interval(B.bootstrap_improvement(rows, "o_custkey", "baseline", "candidate", "y", stratum="c_mktsegment"))


def parameter_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of ridge coefficients by resampled customers, and how often each keeps its sign."""
    rows = order_frame(spark, d).where("prev_value is not null").select("o_custkey", "y", "games_365", F.log("prev_value").alias("log_prev"), (F.col("staleness_days") / 365).alias("staleness"))
    fits = B.bootstrap_ridge(rows, "o_custkey", ["games_365", "log_prev", "staleness"], "y", 1.0)
    q = F.percentile("coefficient", F.array(F.lit(0.025), F.lit(0.975)))
    return fits.groupBy("feature").agg(F.round(F.avg("coefficient"), 6).alias("mean"), F.round(q[0], 6).alias("low"), F.round(q[1], 6).alias("high"), F.avg((F.col("coefficient") > 0).cast("double")).alias("p_positive"))


#: Draws of the intervals of fitted parameters.
DRAWS = 1000


def logistic_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of a logistic model's parameters for large orders by resampled customers: one set of Newton steps for all draws."""
    known = order_frame(spark, d).where("prev_value is not null")
    x = F.array(F.col("games_365") / 10, F.log("prev_value"), F.col("staleness_days") / 365)
    fits = N.logistic_many(known.select("o_custkey", "large", x.alias("x")), "x", "large", [1.0], draws=DRAWS, cluster="o_custkey")
    return spark.createDataFrame([(n, *(round(v, 6) for v in r)) for n, *r in N.intervals(fits, ["games_365", "log_prev", "staleness"])], "feature string, mean double, low double, high double, p_positive double")


def hazard_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the parameters of a discrete-time hazard of the next order, by resampled orders, all their periods together."""
    periods = person_periods(spark, d).join(pit_order_features(spark, d).select("o_orderkey", "games_365"), "o_orderkey")
    last = 8
    x = F.array(*[(F.col("period") == k).cast("double") for k in range(2, last + 1)], F.col("games_365") / 10)
    fits = N.logistic_many(periods.select("o_orderkey", F.col("hazard_event").cast("double").alias("y"), x.alias("x")), "x", "y", [1.0], draws=DRAWS, cluster="o_orderkey")
    return spark.createDataFrame([(n, *(round(v, 6) for v in r)) for n, *r in N.intervals(fits, [*(f"period_{k}" for k in range(2, last + 1)), "games_365"])], "feature string, mean double, low double, high double, p_positive double")


def permutation_heterogeneity(spark: SparkSession, d: str) -> DataFrame:
    """Whether the improvement differs between priorities more than chance lets it."""
    e = lambda c: F.pow(F.col("y") - F.col(c), F.lit(2))
    rows = _paired(spark, d).select("o_orderkey", "o_orderpriority", (e("baseline") - e("candidate")).alias("gain"))
    return B.permutation_heterogeneity(rows, "o_orderpriority", "gain", key="o_orderkey")


def explained_scores(spark: SparkSession, d: str) -> DataFrame:
    """The largest contribution of a raw feature to each order's score of a logistic model."""
    frame = order_frame(spark, d).cache()
    pre = M.fit_preprocessor(frame, NUMBERS, ["o_orderpriority"])
    held = pre.transform(frame).cache()
    model = M.logistic(held, "large", 1.0)
    held.unpersist()
    parts = F.map_entries(M.contributions(pre, list(model.coefficients)))
    top = F.array_max(F.transform(parts, lambda x: F.struct(F.abs(x["value"]).alias("size"), x["key"].alias("feature"), x["value"].alias("value"))))
    return frame.select("o_orderkey", top.alias("t")).select("o_orderkey", "t.feature", F.round("t.value", 6).alias("contribution"))


QUERIES = {f.__name__: f for f in (rolling_origin_models, hazard_model, boosted_model, huber_boosted_model, movement_states, cluster_bootstrap_ci, parameter_intervals, logistic_intervals, hazard_intervals, permutation_heterogeneity, explained_scores)}
