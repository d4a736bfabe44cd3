"""Quality classifier: a sparse ensemble of rules.

A small random forest is fitted on statistics of labelled texts; every path of its trees, from the root to each node, is
a conjunctive rule over the statistics. A lasso logistic regression over the rules keeps few of them with weights, and
the kept rules are compiled to one Spark column expression over the statistics.

Only labelled rows outside the held-out third (crc32 of doc_id as text, mod 3, is 1 there) are learned from, and of
those at most `sample`, by the smallest hash. doc_id, lang, source and labels aren't inputs of a score.

Defined cases: a null text counts as an empty one and is scored by its statistics; without labelled rows of both kinds
every score is the share of good ones (0.5 without any). A document labelled twice counts with its mean label, rounded
down. Null doc_id: not held out, and never learned from. Repeated rows are scored alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, id_text, map_texts
from tidemark.llm.quality_rules import _SPACE_BYTES, SYMBOLS, byte_counts, common_counts, repeated_words, words_of

STATS = (
    "n_words", "mean_word", "symbol_share", "upper_share", "digit_share", "space_share", "stop_share", "bang_share", "pipe_share", "common_share",
    "distinct_share", "repeat_share", "words_per_line", "repeated_line_share", "longest_word", "capital_share",
)


@dataclass(frozen=True)
class Fit:
    #: Most labelled rows that the trees and the lasso see.
    sample: int = 12_000
    trees: int = 24
    depth: int = 3
    lasso: float = 0.002
    iterations: int = 60
    seed: int = 11


def statistics(text: str) -> tuple:
    """STATS of one text; shares are 0 where there's nothing to divide by."""
    of = byte_counts(text)
    words = words_of(text, of)
    n, chars = len(words), max(1, len(text))
    letters = max(1, int(of[65:91].sum() + of[97:123].sum() + of[192:].sum()))
    lines = [x for x in text.split("\n") if x.strip()]
    per = lambda a, b: float(a) / b if b else 0.0
    return (
        float(np.log1p(n)), per(chars - of[_SPACE_BYTES].sum(), n), per(of[list(SYMBOLS.encode())].sum(), chars), per(of[65:91].sum(), letters), per(of[48:58].sum(), chars), per(of[_SPACE_BYTES].sum(), chars),
        per(of[[33, 44, 46, 58, 59, 63]].sum(), chars), per(of[33], chars), per(of[124], chars), 1 - per(common_counts(words)[-1], n) if n else 0.0, per(len(set(words)), n), per(repeated_words(words), n),
        per(n, len(lines)), per(len(lines) - len(set(lines)), len(lines)), float(np.log1p(max(map(len, words), default=0))), per(sum(w[0].isupper() for w in words), n),
    )


def statistics_of(docs: DataFrame) -> DataFrame:
    return map_texts(docs, statistics, ", ".join(f"{s} double" for s in STATS))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % 3 == 1, F.lit(False))


Rule = tuple[tuple[str, str, float], ...]


def tree_rules(described: str) -> list[Rule]:
    """Every path from a root to a node of MLlib's description of a tree or forest, as (statistic, '<=' or '>', bound) conjunctions."""
    rules, path = set(), []
    for line in described.split("\n"):
        if m := re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)", line):
            depth = len(m[1])
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, (STATS[int(m[2])], m[3], float(m[4]))))
            # one bound on each side of each statistic is enough: the tightest
            tight: dict[tuple[str, str], float] = {}
            for _, (s, op, v) in path:
                tight[s, op] = min(v, tight.get((s, op), v)) if op == "<=" else max(v, tight.get((s, op), v))
            rules.add(tuple((s, op, v) for (s, op), v in sorted(tight.items(), key=lambda x: (STATS.index(x[0][0]), x[0][1]))))
    return sorted(rules)


def rule_column(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [F.col(s) <= v if op == "<=" else F.col(s) > v for s, op, v in rule])


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    weights: tuple[tuple[Rule, float], ...] = ()

    def score(self) -> Column:
        """The compiled ensemble: a logistic of the summed weights of the rules that hold."""
        total = reduce(lambda a, b: a + b, [F.when(rule_column(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.weights], F.lit(self.intercept))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rules(labelled: DataFrame, fit: Fit = Fit()) -> RuleEnsemble:
    """labelled: STATS and label (0.0 or 1.0)."""
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}  # two rows
    n, good = sum(counts.values()), counts.get(1.0, 0)
    if good in (0, n):
        p = (good + 1) / (n + 2)
        return RuleEnsemble(float(np.log(p / (1 - p))))
    rows = VectorAssembler(inputCols=list(STATS), outputCol="stats").transform(labelled)
    forest = RandomForestClassifier(featuresCol="stats", labelCol="label", numTrees=fit.trees, maxDepth=fit.depth, maxBins=64, minInstancesPerNode=5, featureSubsetStrategy="sqrt", seed=fit.seed).fit(rows)
    rules = tree_rules(forest.toDebugString)
    if not rules:
        return RuleEnsemble(float(np.log(good / (n - good))))
    held = labelled.select("label", F.array(*[rule_column(r).cast("double") for r in rules]).alias("held"))
    from pyspark.ml.functions import array_to_vector

    held = held.select("label", array_to_vector("held").alias("rules")).cache()
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=fit.lasso, maxIter=fit.iterations, tol=1e-5).fit(held)
    held.unpersist()
    kept = tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w)
    return RuleEnsemble(float(lasso.intercept), kept)


def training_rows(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """doc_id and label of at most fit.sample labelled documents outside the held-out third."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.floor(F.avg("quality")).cast("double").alias("label"))
    known = known.where(~held_out()).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit.sample)


def score_documents(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, score, predicted and the statistics for each row of docs."""
    scratch = Scratch(docs.sparkSession)
    chosen = F.broadcast(training_rows(docs, labels, fit))  # at most fit.sample rows
    # of several texts of one doc_id the smallest is learned from, however often a task runs
    texts = id_text(docs).join(chosen.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    learned = scratch.keep(statistics_of(texts).join(chosen, "doc_id"))
    ensemble = fit_rules(learned, fit)
    scratch.close()
    scored = statistics_of(docs).withColumn("score", ensemble.score())
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *STATS)
