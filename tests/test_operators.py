"""Operators on the literal cases: ties, empty groups, boundaries and nulls."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as S
from tidemark.operators import distribution as D
from tidemark.operators import models as M
from tidemark.operators import relational as R
from tidemark.operators import resampling as B
from tidemark.operators import temporal as T
from tidemark.sources import tables


def t(day, hour=0):
    return datetime(2024, 1, day, hour)


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([("a", t(1), 1.0, 1), ("a", t(5), 2.0, 2), ("a", t(5), 3.0, 3), ("b", t(9), 4.0, 4), (None, t(1), 5.0, 5)], "k string, ft timestamp, v double, o int")


def test_asof_boundaries(spark, facts):
    anchors = spark.createDataFrame([(1, "a", t(5)), (2, "a", t(6)), (3, "a", t(1)), (4, "b", t(1)), (5, None, t(9)), (6, "c", t(9)), (7, "a", None)], "id int, k string, at timestamp")
    get = lambda **kw: {r.id: r.v for r in T.asof_join(anchors, facts, "k", "at", "ft", ["v"], order=["o"], **kw).collect()}
    assert get() == {1: 3.0, 2: 3.0, 3: 1.0, 4: None, 5: None, 6: None, 7: None}
    assert get(strict=True) == {1: 1.0, 2: 3.0, 3: None, 4: None, 5: None, 6: None, 7: None}
    assert get(direction="forward") == {1: 2.0, 2: None, 3: 1.0, 4: 4.0, 5: None, 6: None, 7: None}
    assert get(direction="forward", strict=True) == {1: None, 2: None, 3: 2.0, 4: 4.0, 5: None, 6: None, 7: None}


def test_nearest_takes_the_earlier_of_equal_gaps(spark, facts):
    anchors = spark.createDataFrame([(1, "a", t(3)), (2, "a", t(4)), (3, "a", t(20))], "id int, k string, at timestamp")
    got = {r.id: (r.v, r.gap_seconds) for r in T.nearest_join(anchors, facts, "k", "id", "at", "ft", "v", 3 * 86400.0).collect()}
    assert got == {1: (1.0, 2 * 86400.0), 2: (2.0, 86400.0), 3: (None, None)}


def test_window_join_bounds(spark):
    anchors = spark.createDataFrame([(1, "a", t(10))], "id int, k string, at timestamp")
    days = spark.createDataFrame([("a", t(d)) for d in (4, 5, 9, 10, 11, 15, 16)], "fk string, ft timestamp")
    pre = sorted(r.ft.day for r in T.window_join(anchors, days, "k", "at", "fk", "ft", -5, 0).collect())
    post = sorted(r.ft.day for r in T.window_join(anchors, days, "k", "at", "fk", "ft", 0, 5, closed="right").collect())
    assert pre == [5, 9] and post == [11, 15]


def test_trailing_sum_leaves_the_anchor_out(spark):
    e = spark.createDataFrame([("a", t(1), 1), ("a", t(2), 2), ("a", t(2), 4), ("a", t(4), 8)], "k string, at timestamp, v int")
    got = {(r["at"].day, r["v"]): r["s"] for r in T.trailing_sum(e, "k", "at", {"s": F.col("v")}, 2).collect()}
    assert got == {(1, 1): None, (2, 2): 1, (2, 4): 1, (4, 8): 6}


def test_lags_skip_gaps(spark):
    p = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("a", 4, 40)], "k string, y int, v int")
    got = {r.y: (r.v_lag1, r.v_lag2) for r in T.lag_join(p, "k", "y", "v", [1, 2]).collect()}
    assert got == {1: (None, None), 2: (10, None), 4: (None, 20)}


def test_islands_and_unions(spark):
    e = spark.createDataFrame([("a", i, s) for i, s in enumerate(["x", "x", None, None, "y", "x"])], "k string, o int, s string")
    assert [r.island for r in T.islands(e, "k", ["o"], "s").orderBy("o").collect()] == [1, 1, 2, 2, 3, 4]
    i = spark.createDataFrame([("a", 0, 45), ("a", 30, 60), ("a", 60, 61), ("a", 70, 71), ("b", None, 3)], "k string, s int, e int")
    assert sorted(tuple(r) for r in T.interval_union(i, "k", "s", "e").collect()) == [("a", 0, 61), ("a", 70, 71)]


def test_cardinality_is_asserted(spark):
    dim = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string")
    with pytest.raises(ValueError, match="unique"):
        R.many_to_one(dim.select("k"), dim, ["k"])
    assert [r.found for r in R.flagged_join(spark.createDataFrame([(1,), (2,)], "k int"), dim.limit(1), ["k"], "found").orderBy("k").collect()] == [True, False]


def test_consolidation(spark):
    rows = spark.createDataFrame([(1, None, None, None), (2, 5, None, None), (3, 5, 5, None), (4, None, 5, 6)], "k int, a int, b int, c int")
    value, source = R.prioritised((F.col("a"), "A"), (F.col("b"), "B"), (F.col("c"), "C"))
    got = [(r.v, r.s, r.g) for r in rows.select("k", value.alias("v"), source.alias("s"), R.agreement(F.col("a"), F.col("b"), F.col("c")).alias("g")).orderBy("k").collect()]
    assert got == [(None, None, "missing"), (5, "A", "single"), (5, "A", "agree"), (5, "B", "differ")]
    newer = spark.createDataFrame([(2, 9), (7, 1)], "k int, a int")
    assert [(r.k, r.a) for r in R.later_wins(rows.select("k", "a"), newer, ["k"], [F.col("a")]).orderBy("k").collect()] == [(1, None), (2, 9), (3, 5), (4, None), (7, 1)]


def test_leave_one_out(spark):
    rows = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("g", None), ("h", 2.0)], "g string, v double")
    got = sorted(((r.g, r.v or 0, r.m) for r in rows.select("*", R.leave_one_out(rows, "g", "v").alias("m")).collect()), key=str)
    assert got == [("g", 0, 2.0), ("g", 1.0, 3.0), ("g", 3.0, 1.0), ("h", 2.0, None)]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = F.lit
    assert one(S.clean_id(lit("123.0"))) == "123" and one(S.clean_id(lit(None).cast("string"))) == "" and one(S.to_whole(lit("2.5"))) == 2 and one(S.strict_whole(lit("2.5"))) is None
    assert one(S.to_bool(lit(" Yes "))) and not one(S.to_bool(lit(None).cast("string"))) and one(S.to_bool_or_null(lit(None).cast("string"))) is None
    assert one(S.non_blank(lit(" "), lit("b"))) == "b" and one(S.conflict(lit("a"), lit("b"))) and not one(S.conflict(lit(""), lit("b")))
    assert one(S.safe_divide(lit(1.0), lit(0.0))) is None and one(S.clip(lit(None).cast("double"), 0.0, 1.0)) is None and one(S.clip(lit(1.3), 0.0, 1.05)) == 1.05
    assert one(S.reasons((lit(True), "A"), (lit(False), "B"), (lit(True), "C"))) == "A;C"
    assert one(S.row_mean([lit(1.0), lit(None).cast("double"), lit(3.0)])) == 2.0 and one(S.row_mean([lit(1.0)], 2)) is None and one(S.row_sum([lit(None).cast("int")])) is None
    assert one(S.name_key(lit("Łódź & Müller-Straße"))) == "lodzandmullerstrasse" and one(S.token_signature(lit("b a-C b"))) == "a|b|b|c"
    assert one(S.strip_tags(lit("<b>a&amp;lt;</b>"))) == "a&lt;" and one(S.money(lit("€ 1,234.50"))) == 1234.5 and one(S.money(lit("-"))) is None
    assert one(S.surrogate_key(lit(None).cast("string"), lit("a"))) == one(F.sha2(lit("|a"), 256)) and one(S.surrogate_key_or_null(lit(None).cast("string"), lit("a"))) is None
    assert one(S.shape_of(lit("4-3-3 flat"))) == "4-3-3" and one(S.shape_of(lit("flat"))) is None and one(S.clock_minutes(lit("01:30:30"))) == 90.5 and one(S.clock_minutes(lit("x"))) is None
    d = lambda x: lit(x).cast("date")
    assert one(S.season_start(d("2024-06-30"))) == 2023 and one(S.season_start(d("2024-06-30"), 6)) == 2024 and one(S.season_label(d("1999-08-01"))) == "99/00"
    assert one(S.completed_season(d("2024-06-30"))) == 2023 and one(S.completed_season(d("2024-06-29"))) == 2022 and one(S.season_years(lit("19/20"))) == 2019 and one(S.season_years(lit("85/86"))) == 1985
    assert one(S.bin_right(lit(1.0), [0, 1, 2], ["a", "b"])) == "a" and one(S.bin_left(lit(1.0), [0, 1, 2], ["a", "b"])) == "b" and one(S.bin_right(lit(0.0), [0, 1], ["a"])) is None
    assert one(S.polygon_area(F.array(*map(lit, (0.0, 2.0, 2.0, 0.0))), F.array(*map(lit, (0.0, 0.0, 1.0, 1.0))))) == 2.0
    assert one(S.cosine(F.array(lit(1.0), lit(0.0)), F.array(lit(0.0), lit(0.0)))) is None and one(S.similarity_ratio(lit("abcd"), lit("bcde"))) == 0.75
    assert [round(one(c), 6) for c in S.pava_decreasing_3(lit(0.2), lit(0.4), lit(0.1))] == [0.3, 0.3, 0.1]
    assert one(S.close_to(lit(1.0), lit(1.000001))) and one(S.smoothed(lit(0), lit(0))) == 0.5 and one(S.finite(lit(float("nan")))) is None and one(S.null_token(lit(" N/A ")))


def pava(xs):
    blocks = []
    for x in xs:
        blocks.append([x, 1])
        while len(blocks) > 1 and blocks[-2][0] < blocks[-1][0]:
            (a, n), (b, m) = blocks[-2:]
            blocks[-2:] = [[(a * n + b * m) / (n + m), n + m]]
    return [v for v, n in blocks for _ in range(n)]


def test_pava_closed_form(spark):
    g = random.Random(1)
    rows = [tuple(g.random() for _ in range(3)) for _ in range(60)]
    got = spark.createDataFrame(rows, "a double, b double, c double").select("a", "b", "c", *[c.alias(f"o{i}") for i, c in enumerate(S.pava_decreasing_3(F.col("a"), F.col("b"), F.col("c")))]).collect()
    for r in got:
        assert [r.o0, r.o1, r.o2] == pytest.approx(pava([r.a, r.b, r.c]))


def test_auc_matches_pairs(spark):
    g = random.Random(2)
    rows = [("x", g.randrange(2), g.randrange(6) / 5) for _ in range(80)] + [("one", 1, 0.3), ("one", 1, 0.4)]
    got = {r.k: r.auc for r in D.auc(spark.createDataFrame(rows, "k string, y int, p double"), ["k"], "y", "p").collect()}
    pos, neg = [p for k, y, p in rows if k == "x" and y], [p for k, y, p in rows if k == "x" and not y]
    assert got["x"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)) and got["one"] is None


def test_ranks_and_bands(spark):
    rows = spark.createDataFrame([("a", v) for v in (3.0, 1.0, 3.0, None)], "k string, v double")
    assert sorted((r.v or 0, r.p) for r in rows.select("v", D.pct_rank_average("v", Window.partitionBy("k")).alias("p")).collect() if r.v) == [(1.0, 1 / 3), (3.0, 2.5 / 3), (3.0, 2.5 / 3)]
    bands = [r.b for r in spark.range(1, 8).select(D.equal_bands(F.col("id"), F.lit(7), 3).alias("b")).collect()]
    assert bands == [1, 1, 1, 2, 2, 3, 3]


def test_benjamini_hochberg(spark):
    ps = [0.01, 0.04, 0.03, 0.5]
    got = {r.i: r.p_adjusted for r in D.benjamini_hochberg(spark.createDataFrame([("f", i, p) for i, p in enumerate(ps)], "f string, i int, p double"), "f", "p", "i").collect()}
    order = sorted(range(4), key=lambda i: ps[i])
    want, low = {}, 1.0
    for rank in (4, 3, 2, 1):
        low = min(low, ps[order[rank - 1]] * 4 / rank)
        want[order[rank - 1]] = low
    assert got == pytest.approx(want)


@pytest.fixture(scope="module")
def linear(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(200, 2))
    x = (x - x.mean(0)) / x.std(0)
    y = x @ [1.0, -2.0] + g.normal(size=200) + 3
    from pyspark.ml.linalg import Vectors

    return x, y, spark.createDataFrame([(Vectors.dense(a), float(b), float(b > 3)) for a, b in zip(x, y, strict=True)], ["features", "y", "z"]).cache()


def test_ridge_conventions(linear):
    x, y, df = linear
    c = y - y.mean()
    assert np.allclose(M.ridge(df, "y", 50.0).coefficients, np.linalg.solve(x.T @ x + 50 * np.eye(2), x.T @ c), atol=1e-8)
    assert np.allclose(M.ridge(df, "y", 0.5, per_row=True).coefficients, np.linalg.solve(x.T @ x / 200 + 0.5 * np.eye(2), x.T @ c / 200), atol=1e-8)


def test_elastic_net_objective(linear):
    x, y, df = linear
    c, alpha, l1 = y - y.mean(), 0.3, 0.5
    b = np.zeros(2)
    for _ in range(2000):
        for j in range(2):
            r = c - x @ b + x[:, j] * b[j]
            rho = x[:, j] @ r / 200
            b[j] = np.sign(rho) * max(abs(rho) - alpha * l1, 0) / (x[:, j] @ x[:, j] / 200 + alpha * (1 - l1))
    assert np.allclose(M.elastic_net(df, "y", alpha, l1).coefficients, b, atol=1e-5)


def test_logistic_matches_newton(linear):
    x, y, df = linear
    z, design, b = (y > 3).astype(float), np.c_[np.ones(200), x], np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ b))
        b -= np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag([0, 1.0, 1.0]), design.T @ (p - z) + np.r_[0, b[1:]])
    m = M.logistic(df, "z", 1.0)
    assert np.allclose([m.intercept, *m.coefficients], b, atol=1e-4)
    flat = M.platt(M.probability(m, df), "p", "z")(M.probability(m, df))
    assert flat.agg(F.avg("calibrated")).first()[0] == pytest.approx(z.mean(), abs=1e-3)
    assert M.isotonic(M.probability(m, df), "p", "z")(M.probability(m, df)).agg(F.avg("calibrated")).first()[0] == pytest.approx(z.mean(), abs=1e-6)


def test_preprocessor(spark):
    train = spark.createDataFrame([(1.0, "a", 5), (None, "b", 5), (3.0, "a", 5)], "x double, c string, k int")
    pre = M.fit_preprocessor(train, ["x", "k"], ["c"])
    assert pre.names() == ["x", "x__missing", "c__a", "c__b"] and pre.medians["x"] == 2.0
    unseen = pre.transform(spark.createDataFrame([(None, "zzz", 5)], "x double, c string, k int")).first().features
    assert unseen[0] == pytest.approx(0.0) and unseen[2] == pytest.approx(-(2 / 3) / math.sqrt(2 / 9))


def test_preprocessor_gathers_further_levels(spark):
    train = spark.createDataFrame([("a", 1.0)] * 3 + [("b", float("inf")), ("c", 3.0)], "c string, x double")
    pre = M.fit_preprocessor(train, ["x"], ["c"], most_levels=1)
    assert pre.names() == ["x", "x__missing", "c__a", f"c__{M.OTHER}"] and pre.medians["x"] == 1.0
    row = pre.transform(spark.createDataFrame([("new", 1.0)], "c string, x double")).first().features
    assert row[3] == pytest.approx((1 - 2 / 5) / math.sqrt(6 / 25)) and row[2] < 0


def test_saved_models(spark, tmp_path):
    from pyspark.ml.regression import LinearRegressionModel

    from tidemark.sources.models import load_model, save_model

    train = spark.createDataFrame([(float(i), "ab"[i % 2], 2.0 * i) for i in range(20)], "x double, c string, y double")
    pre = M.fit_preprocessor(train, ["x"], ["c"])
    model = M.ridge(pre.transform(train), "y", 1.0)
    for _ in range(2):  # a second save replaces the first
        save_model(spark, model, pre, str(tmp_path), {"cutoff": "1998-06-30"})
    again, same, facts = load_model(spark, LinearRegressionModel, str(tmp_path))
    assert same == pre and facts == {"cutoff": "1998-06-30"} and list(again.coefficients) == list(model.coefficients)
    part = next((tmp_path / "preprocessor").glob("part-*"))
    part.write_text(part.read_text().replace("x", "z", 1))
    next(iter((tmp_path / "preprocessor").glob(".part-*.crc"))).unlink()
    with pytest.raises(ValueError, match="isn't the file"):
        load_model(spark, LinearRegressionModel, str(tmp_path))


def test_normal_cdf_and_decomposition(spark):
    got = spark.createDataFrame([(0.0, "Ångström ﬁ"), (1.96, "abc"), (None, None)], "z double, t string").select(M.normal_cdf("z"), S.decomposed("t")).collect()
    assert got[0][0] == 0.5 and got[1][0] == pytest.approx(0.9750021) and got[2][0] is None
    assert [r[1] for r in got] == ["Angstrom fi", "abc", None]


def test_exceedance(spark):
    res = [-2.0, -1.0, 0.0, 1.0, 2.0]
    got = M.exceedance(spark.createDataFrame([(0.0,), (1.0,), (9.0,)], "p double"), "p", spark.createDataFrame([(r,) for r in res], "r double"), "r", F.lit(1.0))
    assert {r.p: r.probability for r in got.collect()} == pytest.approx({p: (sum(r <= 1.0 - p for r in res) + 0.5) / 6 for p in (0.0, 1.0, 9.0)})


def test_bootstrap_is_repeatable(spark):
    g = random.Random(5)
    rows = spark.createDataFrame([(g.randrange(40), float(i % 3), 1.0, float(i % 3) * 0.9) for i in range(400)], "c int, y double, b double, m double")
    one, two = (B.interval(B.bootstrap_improvement(rows.repartition(k), "c", "b", "m", "y", draws=200)).first() for k in (2, 5))
    assert one.n_draws == 200 and one.low > 0 and [round(x, 9) for x in one] == [round(x, 9) for x in two]
    assert B.stability_label(one.mean, [1.0, 2.0], one.low, one.high) == "supported" and B.stability_label(0, [1, -1], -1, 1) == "mixed"
    same = B.permutation_heterogeneity(rows.withColumn("g", F.col("c") % 2).select("g", (F.col("y") * 0 + F.col("c")).alias("v")), "g", "v", draws=60).first()
    apart = B.permutation_heterogeneity(rows.withColumn("g", F.col("c") % 2).select("g", (F.col("g") * 10 + F.col("y")).alias("v")), "g", "v", draws=60).first()
    assert apart.p_value < 0.05 and same.n_draws == 60


def test_bootstrap_within_strata(spark):
    """Strata of very unlike errors: only resampling within them leaves their sizes alone."""
    rows = spark.createDataFrame([(c, "ab"[c % 2], 0.0, 1.0 + 9.0 * (c % 2), 0.5) for c in range(200)], "c int, s string, y double, b double, m double")
    spread = {s: B.interval(B.bootstrap_improvement(rows, "c", "b", "m", "y", stratum=s, draws=300)).first() for s in (None, "s")}
    assert spread["s"].high - spread["s"].low < 1e-9 < spread[None].high - spread[None].low
    assert spread["s"].mean == pytest.approx((1 + 100) / 2 - 0.25)


def test_permutation_keeps_counts(spark):
    """All permutations of a few rows: the p value is near the exact one, the same however rows are partitioned, and strata bind."""
    from itertools import permutations

    groups, values = [0, 0, 0, 1, 1, 1, 1], [5.0, 4.0, 1.0, 2.0, 0.0, 3.0, 1.5]
    gap = lambda v: sum(n * (sum(v[i] for i, g in enumerate(groups) if g == k) / n - sum(values) / 7) ** 2 for k, n in ((0, 3), (1, 4)))
    exact = np.mean([gap(x) >= gap(values) - 1e-9 for x in permutations(values)])
    rows = spark.createDataFrame(list(zip(range(7), groups, values, strict=True)), "id int, g int, v double")
    one, two = (B.permutation_heterogeneity(rows.repartition(k), "g", "v", draws=2000, slots=3).first() for k in (1, 4))
    assert one == two and one.p_value == pytest.approx(exact, abs=0.04) and one.spread == pytest.approx(gap(values) / 7)
    bound = B.permutation_heterogeneity(rows.withColumn("s", F.col("g")), "g", "v", stratum="s", draws=50).first()
    assert bound.p_value == 1.0  # within strata of one group nothing can move


def test_bootstrapped_coefficients(spark):
    g = np.random.default_rng(2)
    x = g.normal(size=(300, 2))
    y = 1 + x @ [2.0, -1.0] + 0.1 * g.normal(size=300)
    rows = spark.createDataFrame([(i % 50, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))], "c int, a double, b double, y double")
    got = B.bootstrap_ridge(rows, "c", ["a", "b"], "y", 1e-6, draws=40).toPandas()
    assert len(got) == 120
    means = got.groupby("feature").coefficient.mean()
    fit = np.linalg.lstsq(np.c_[np.ones(300), x], y, rcond=None)[0]
    assert np.allclose(means[["intercept", "a", "b"]], fit, atol=0.02)


def test_sources(spark, tmp_path):
    (tmp_path / "x_2019_2020.csv").write_text("﻿id,name\n1,\n2,b\n", encoding="utf-8")
    assert [tuple(r) for r in tables.read_text_csv(spark, str(tmp_path / "x_2019_2020.csv"), ["id", "name"]).orderBy("id").collect()] == [("1", ""), ("2", "b")]
    assert {r.season_start for r in tables.read_season_files(spark, str(tmp_path / "*.csv"), ["id", "name"]).collect()} == {2019}
    assert [r.id for r in tables.read_typed_csv(spark, str(tmp_path / "x_2019_2020.csv"), "id int, name int").orderBy("id").collect()] == [1, 2]
    (tmp_path / "7.json").write_text('[{"a": {"b": 1}}, {"a": null}]')
    assert {(r.source_file, r.a.b if r.a else None) for r in tables.read_nested_json(spark, str(tmp_path / "7.json"), "a struct<b: int>").collect()} == {("7", 1), ("7", None)}
    m = tables.file_manifest(spark, str(tmp_path / "7.json")).first()
    assert m.bytes == len('[{"a": {"b": 1}}, {"a": null}]')
    fields = tables.field_dictionary(spark.range(1), {"id": "key"}).first()
    assert (fields.column_name, fields.role) == ("id", "key")
    tables.write_parquet(spark.range(3).withColumn("p", F.col("id") % 2), str(tmp_path / "out"), ["p"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    tables.write_csv(spark.range(3), str(tmp_path / "csv"))
    assert tables.to_json_rows(spark.createDataFrame([(1, float("nan"))], "id int, x double"), "id").first().payload == '{"id":1}'


def test_exact_quantiles_ranks_and_places(spark):
    import random

    import numpy as np
    import pandas as pd

    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.choice([1.0, 1.0, 1.0, rng.gauss(0, 5)]), i) for i in range(3000)] + [("c", 2.0, 3000), (None, 4.0, 3001), ("a", None, 3002)]
    df, pdf = spark.createDataFrame(rows, "g string, v double, i long"), pd.DataFrame(rows, columns=["g", "v", "i"])
    shares = [0.0, 0.13, 0.5, 0.999, 1.0]
    # a sketch of 1 in 20 misses some brackets, which are then opened
    for how, accuracies in (("linear", (20, 10_000)), ("higher", (20,)), ("lower", (10_000,))):
        for accuracy in accuracies:
            got = {r.g: r.q for r in D.exact_quantiles(df, "v", shares, ["g"], how, accuracy).collect()}
            for g, part in pdf.dropna(subset=["v"]).groupby("g", dropna=False):
                assert np.allclose(got[None if pd.isna(g) else g], np.quantile(part.v, shares, method=how))
        assert np.allclose(D.exact_quantiles(df, "v", shares, how=how).first().q, np.quantile(pdf.v.dropna(), shares, method=how))
    assert D.exact_quantiles(df.where("v > 1e9"), "v", [0.5]).first().q == [None]
    below = {r.i: (r["__below"], r["__same"], r["__all"]) for r in D.ranked(df, "v", ["g"]).collect()}
    assert below[3002] == (None, None, None) and below[3001] == (0, 1, 1)
    for g, part in pdf.dropna().groupby("g"):
        assert all(below[r.i] == ((part.v < r.v).sum(), (part.v == r.v).sum(), len(part)) for r in part.head(40).itertuples())
    full = pdf.dropna(subset=["v"])
    places = {r.i: r.place for r in D.row_numbers(df.where("v is not null"), "v", "i", "place").collect()}
    assert [i for i, _ in sorted(places.items(), key=lambda x: x[1])] == list(full.sort_values(["v", "i"]).i)
    tiles = spark.range(1, 12).select(D.tile(F.col("id"), F.lit(11), 4).alias("t")).collect()
    assert [r.t for r in tiles] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4]


def test_text_cleaning(spark, tmp_path):
    from tidemark.functions import cleaning as C

    cells = [("2024-02-03", "7.0", "1.5"), (" 3/2/2024 ", "7.5", "1d"), ("Feb 3, 2024", "", None), ("2024-13-40", "x", "-.5e1"), (None, "-2", "NaN")]
    df = spark.createDataFrame(cells, "day string, k string, x string")
    kinds = {"dates": ["day"], "wholes": ["k"], "numbers": ["x"]}
    got = C.typed(df, **kinds).collect()
    assert [str(r.day) for r in got] == ["2024-02-03"] * 3 + ["None"] * 2
    assert [r.k for r in got] == [7, None, None, None, -2] and [r.x for r in got] == [1.5, None, None, -5.0, None]
    assert {r.column_name: (r.n_blank, r.n_trimmed, r.n_invalid) for r in C.cleaning_counts(df, **kinds).collect()} == {"day": (1, 1, 1), "k": (1, 0, 2), "x": (1, 0, 2)}
    assert C.text_profile(df.where("day = ''"), ["k"]).count() == 0
    assert C.snake_columns(spark.createDataFrame([(1, 2, 3)], "`Goals/p 90` int, `A%` int, `a pct` int")).columns == ["goals_per_per90", "a_pct", "a_pct_3"]
    nested = spark.sql("select 1 as id, named_struct('a', named_struct('b', 2), 'c', array(3)) as e")
    assert tables.flattened(nested).columns == ["id", "e_a_b", "e_c"]
    tables.write_parts(spark.range(10), str(tmp_path / "o"), {"all": F.lit(True), "even": F.col("id") % 2 == 0, "none": F.col("id") < 0})
    assert {r.output: r["count"] for r in spark.read.parquet(str(tmp_path / "o")).groupBy("output").count().collect()} == {"all": 10, "even": 5}
    (tmp_path / "gate.json").write_text('{"verified": true, "other": false}')
    tables.require_verified(spark, str(tmp_path / "gate.json"))
    for field in ("other", "absent"):
        with pytest.raises(ValueError, match="isn't marked"):
            tables.require_verified(spark, str(tmp_path / "gate.json"), field)
