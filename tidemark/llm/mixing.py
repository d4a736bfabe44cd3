"""Mixing to target weights by soft membership, with DataFrame functions only.

A binned naive Bayes classifier, learned from the labelled table, gives each document a posterior over domains: good,
poor and toxic. Nonnegative rates for the documents are then fitted so that the expected tokens of each domain,
sum(rate * tokens * posterior), come to a target: least squares by projected gradient, all rates starting at 1 (see
fit_rates). The
gradient of a document depends on its few domain tokens and the few residuals of each step, so a step is one aggregation
over the rows, pre-aggregated in each task, and only as many sums as there are domains reach the driver.

At most `sample` labelled documents are learned from, by the smallest hash. Inputs are statistics of the text and
whether it holds words that the labels tell apart; doc_id, lang and source aren't used.

Defined cases: a null or empty text has no tokens, the prior as its posterior, and keeps the rate 1, since it can't
change a total. Without labelled rows all domains are equally likely. Targets that can't be met leave a residual,
which fit_rates returns and which is warned of; so does a domain without expected tokens. Repeated rows, and rows of equal
texts, get equal rates; ids don't matter, null or not. Very long texts count by their tokens like others. In mixed() other
columns stay, those named rate or p_<domain> are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, checkpointed

DOMAINS = ("good", "poor", "toxic")


@dataclass(frozen=True)
class Mix:
    #: Share of the corpus's tokens that each domain is to have, in the order of DOMAINS.
    targets: tuple[float, ...] = (0.9, 0.06, 0.04)
    #: Most labelled documents that the classifier sees, and most telling words that it keeps.
    sample: int = 4000
    lexicon: int = 64
    #: Most steps, and after how many the rates are written.
    steps: int = 60
    written: int = 10
    #: Largest gap of a domain, as a share of all tokens, at which the targets count as met.
    tolerance: float = 1e-4
    #: Least relative gain of five steps when they can't be met.
    gain: float = 1e-4


#: Upper bounds of the bins of each statistic; the last bin is open.
BINS = {
    "symbol_share": (0.0005, 0.005, 0.02, 0.05),
    "upper_share": (0.005, 0.02, 0.04, 0.1, 0.5),
    "mean_word": (3.5, 4.5, 5.0, 5.5, 6.5, 8.0),
    "distinct_share": (0.05, 0.2, 0.4, 0.6, 0.8),
    "log_words": (2.0, 3.0, 4.0, 5.0, 6.0, 7.0),
    "hits": (0.5, 1.5, 2.5),
}
PARTING = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), PARTING), lambda w: w != "")


def with_statistics(texts: DataFrame, lexicon: list[str]) -> DataFrame:
    """texts (doc_id, text) with n_tokens and the statistics of BINS; the text goes."""
    base = texts.select("*", F.array_remove(F.split(F.lower("text"), r"[\x20\x09-\x0D.,;:!?]+"), "").alias("raw"), F.length("text").alias("chars"))
    n = F.size("raw")
    chars = F.greatest(F.col("chars"), F.lit(1))
    kept = lambda others: F.length(F.regexp_replace("text", others, ""))  # noqa: E731  runs of other characters go at once
    hits = F.size(F.array_intersect("raw", F.array(*[F.lit(w) for w in lexicon]))) if lexicon else F.lit(0)
    return base.select(
        *[c for c in texts.columns if c != "text"], n.cast("long").alias("n_tokens"), (kept(r"[^#*$%&|<>]+") / chars).alias("symbol_share"), (kept("[^A-Z]+") / chars).alias("upper_share"),
        (F.col("chars") / F.greatest(n, F.lit(1))).alias("mean_word"), (F.size(F.array_distinct("raw")) / F.greatest(n, F.lit(1))).alias("distinct_share"), F.log1p(n.cast("double")).alias("log_words"), hits.cast("double").alias("hits"),
    )


def bin_of(name: str) -> Column:
    out = F.lit(len(BINS[name]))
    for i, bound in reversed(list(enumerate(BINS[name]))):
        out = F.when(F.col(name) <= bound, F.lit(i)).otherwise(out)
    return out


def labelled_texts(docs: DataFrame, labels: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, text and domain of at most mix.sample labelled documents; of several texts of one doc_id the smallest, however often a task runs."""
    domain = F.when(F.max("toxic") == 1, "toxic").when(F.min("quality") == 0, "poor").when(F.min("quality") == 1, "good")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(domain.alias("domain")).where("domain is not null")
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(mix.sample))  # at most mix.sample rows
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").groupBy("doc_id", "domain").agg(F.min("text").alias("text")).select("doc_id", "text", "domain")


def telling_words(learned: DataFrame, mix: Mix) -> list[str]:
    """The words of toxic documents that are the most over-represented there; at most mix.lexicon of them."""
    toxic = (F.col("domain") == "toxic").cast("long")
    words = learned.select(toxic.alias("toxic"), F.explode(F.array_distinct(words_of(F.col("text")))).alias("word")).where(F.length("word") >= 3)
    counts = words.groupBy("word").agg(F.sum("toxic").alias("k"), F.count("*").alias("n")).where("k >= 5")
    total = learned.agg(F.sum(toxic).alias("k"), F.count("*").alias("n")).first()
    if not total.n or not total.k:
        return []
    share = total.k / total.n
    lift = (F.col("k") / F.col("n")) / F.lit(share)
    return [r.word for r in counts.where(lift >= min(2.5, 0.9 / share)).orderBy(F.desc(lift * F.log1p("k")), "word").limit(mix.lexicon).collect()]


@dataclass(frozen=True)
class Posterior:
    lexicon: tuple[str, ...]
    log_prior: tuple[float, ...]
    #: By statistic, bin and domain.
    log_share: dict[str, tuple[tuple[float, ...], ...]]

    def columns(self) -> list[Column]:
        """One posterior for each domain, as expressions over the statistics."""
        logs = []
        for k, prior in enumerate(self.log_prior):
            total = F.lit(prior)
            for name, table in self.log_share.items():
                total = total + F.element_at(F.array(*[F.lit(row[k]) for row in table]), F.col(f"bin_{name}") + 1)
            logs.append(total)
        top = F.greatest(*logs)
        parts = [F.exp(x - top) for x in logs]
        return [p / reduce(lambda a, b: a + b, parts) for p in parts]


def fit_posterior(docs: DataFrame, labels: DataFrame, scratch: Scratch, mix: Mix) -> Posterior:
    learned = scratch.keep(labelled_texts(docs, labels, mix))
    lexicon = telling_words(learned, mix)
    binned = with_statistics(learned, lexicon).select("domain", *[bin_of(s).alias(s) for s in BINS])
    rows = binned.unpivot("domain", list(BINS), "statistic", "bin").groupBy("domain", "statistic", "bin").count().collect()  # domains x bins
    seen = {(r.statistic, r.bin, r.domain): r["count"] for r in rows}
    totals = {d: sum(v for (s, _, x), v in seen.items() if x == d and s == "hits") for d in DOMAINS}
    every = sum(totals.values())
    prior = tuple(float(np.log((totals[d] + 1) / (every + len(DOMAINS)))) for d in DOMAINS)
    share = {s: tuple(tuple(float(np.log((seen.get((s, b, d), 0) + 0.5) / (totals[d] + 0.5 * (len(edges) + 1)))) for d in DOMAINS) for b in range(len(edges) + 1)) for s, edges in BINS.items()}
    return Posterior(tuple(lexicon), prior, share)


def with_posteriors(docs: DataFrame, posterior: Posterior) -> DataFrame:
    """doc_id, n_tokens and p_<domain> for each row of docs."""
    rows = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), list(posterior.lexicon))
    rows = rows.select("doc_id", "n_tokens", *[bin_of(s).alias(f"bin_{s}") for s in BINS])
    prior = [F.lit(float(np.exp(p))) for p in posterior.log_prior]
    return rows.select("doc_id", "n_tokens", *[F.when(F.col("n_tokens") == 0, q).otherwise(p).alias(f"p_{d}") for d, p, q in zip(DOMAINS, posterior.columns(), prior, strict=True)])


Vector = tuple[float, ...]
#: Lengths of a scaled step, and of one along the gradient itself, that are tried at once.
SCALED = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)
PLAIN = (1.0, 10.0, 100.0)


@dataclass(frozen=True)
class Fit:
    #: The steps: the gap before each, and what each domain token of a free document adds.
    steps: tuple[tuple[Vector, Vector], ...]
    #: Norm of the gap to the targets, and the largest gap of a domain, as shares of all tokens.
    residual: float
    left: float
    #: Whether the targets are met, or the gap no longer falls.
    converged: bool


def dot(vector: Vector, tokens: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(v)) * t for v, t in zip(vector, tokens, strict=True)])


def fit_rates(rows: DataFrame, mix: Mix) -> Fit:
    """Nonnegative least squares for the rates by projected gradient. rows: n_tokens and p_<domain>.

    A document is free if its rate is above 0 or its gradient raises it. Free ones move along their gradient, in the
    metric of the Gram matrix of the free documents' domain tokens, and are cut at 0; several lengths of that step, and
    of one in the plain metric, are tried in one aggregation, and the one that leaves the smallest gap is taken. So the
    gap never grows, and the process rests only where no free document has a gradient: at a least-squares solution,
    whether or not the targets can be met.
    """
    k = len(DOMAINS)
    t = [F.col(f"t{i}") for i in range(k)]
    state = rows.select(*[(F.col("n_tokens") * F.col(f"p_{d}")).alias(f"t{i}") for i, d in enumerate(DOMAINS)], "n_tokens", F.lit(1.0).alias("x"))
    first = state.agg(F.sum("n_tokens").alias("all"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(t)]).first()
    if not first["all"]:
        return Fit((), 0.0, 0.0, True)
    total = float(first["all"])
    goal = total * np.array(mix.targets, dtype=float)
    gap = goal - np.array([first[f"s{i}"] for i in range(k)], dtype=float)
    steps: list[tuple[Vector, Vector]] = []
    norms = [float(np.linalg.norm(gap))]
    written = 0
    while True:
        left = float(np.abs(gap).max() / total)
        done = left <= mix.tolerance or (len(norms) > 5 and norms[-1] > (1 - mix.gain) * norms[-6])
        if done or len(steps) >= mix.steps:
            return Fit(tuple(steps), norms[-1] / total, left, done)
        at = tuple(gap.tolist())
        now = state.select(*t, moved(t, steps[written:], F.col("x")).alias("x"))
        free = (F.col("x") > 0) | (dot(at, t) > 0)
        got = now.agg(*[F.sum(F.when(free, t[i] * t[j])).alias(f"g{i}{j}") for i in range(k) for j in range(i, k)]).first()
        gram = np.array([[got[f"g{min(i, j)}{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], dtype=float)
        height = float(np.linalg.eigvalsh(gram)[-1])
        if height <= 0:  # no document is free
            return Fit(tuple(steps), norms[-1] / total, left, True)
        along = np.linalg.pinv(gram, rcond=1e-9, hermitian=True) @ gap
        tried = [tuple((a * along).tolist()) for a in SCALED] + [tuple((a * gap / height).tolist()) for a in PLAIN]
        sums = now.agg(*[F.sum(moved(t, [(at, v)], F.col("x")) * c).alias(f"s{n}_{i}") for n, v in enumerate(tried) for i, c in enumerate(t)]).first()
        after = [goal - np.array([sums[f"s{n}_{i}"] for i in range(k)], dtype=float) for n in range(len(tried))]
        best = int(np.argmin([np.linalg.norm(v) for v in after]))
        if np.linalg.norm(after[best]) >= norms[-1]:
            return Fit(tuple(steps), norms[-1] / total, left, True)
        gap = after[best]
        norms.append(float(np.linalg.norm(gap)))
        steps.append((at, tried[best]))
        if len(steps) - written >= mix.written:
            state = checkpointed(state.select(*t, moved(t, steps[written:], F.col("x")).alias("x")))
            written = len(steps)


def moved(tokens: list[Column], steps: list[tuple[Vector, Vector]], x: Column) -> Column:
    """The rate after these steps: a free document moves along its domain tokens and is cut at 0."""

    def one(rate: Column, slope: Column, move: Column) -> Column:
        return F.when((rate > 0) | (slope > 0), F.greatest(F.lit(0.0), rate + move)).otherwise(rate)

    if not steps:
        return x
    if len(steps) == 1:
        return one(x, dot(steps[0][0], tokens), dot(steps[0][1], tokens))
    moves = F.array(*[F.struct(dot(gap, tokens).alias("slope"), dot(step, tokens).alias("move")) for gap, step in steps])
    return F.aggregate(moves, x, lambda rate, m: one(rate, m["slope"], m["move"]))


def rate_column(fit: Fit) -> Column:
    """The fitted rate, from n_tokens and p_<domain>."""
    return moved([F.col("n_tokens") * F.col(f"p_{d}") for d in DOMAINS], list(fit.steps), F.lit(1.0))


def told(fit: Fit) -> Fit:
    """Warns where the targets aren't met."""
    if fit.left > 1e-3:
        warnings.warn(f"mixing targets are missed by up to {fit.left:.4f} of all tokens (residual {fit.residual:.4f}{'' if fit.converged else ', not converged'})", stacklevel=3)
    return fit


def rates(docs: DataFrame, labels: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, n_tokens, p_<domain> and rate for each row of docs."""
    scratch = Scratch(docs.sparkSession)
    posterior = fit_posterior(docs, labels, scratch, mix)
    rows = checkpointed(with_posteriors(docs, posterior))
    scratch.close()
    return rows.select("*", rate_column(told(fit_rates(rows, mix))).alias("rate"))


def mixed(docs: DataFrame, labels: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """docs with rate and p_<domain>; columns of these names are replaced.

    The statistics are taken again from each text, so no text is shuffled.
    """
    scratch = Scratch(docs.sparkSession)
    posterior = fit_posterior(docs, labels, scratch, mix)
    rows = scratch.keep(with_posteriors(docs, posterior))
    fit = told(fit_rates(rows, mix))
    scratch.close()
    added = [f"p_{d}" for d in DOMAINS]
    names = [c for c in docs.columns if c not in {*added, "rate"}]
    inner = docs.select(F.struct(*names).alias("__tm_row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    stats = with_statistics(inner, list(posterior.lexicon)).select("__tm_row", "n_tokens", *[bin_of(s).alias(f"bin_{s}") for s in BINS])
    prior = [F.lit(float(np.exp(p))) for p in posterior.log_prior]
    known = stats.select("__tm_row", "n_tokens", *[F.when(F.col("n_tokens") == 0, q).otherwise(p).alias(c) for c, p, q in zip(added, posterior.columns(), prior, strict=True)])
    return known.select("__tm_row.*", *added, rate_column(fit).alias("rate"))
