"""Distribution statistics: ranks, concentration, distances between distributions, calibration and ranking metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tidemark.sources.scratch import shared_root


#: Groups whose brackets, a small row each, may be broadcast.
BROADCAST_GROUPS = 10_000
#: Bands into which different values are dealt for running totals: each task sorts about this share of them.
BANDS = 128


def band_edges(df: DataFrame, value: str, bands: int = BANDS) -> list:
    """Fewer than bands values that cut the rows into parts of about one size; one aggregate of fixed size reaches the driver."""
    at = F.array(*[F.lit(i / bands) for i in range(1, bands)])
    return sorted(set(df.agg(F.percentile_approx(value, at, F.lit(50 * bands)).alias("q")).first().q or []))


def band_of(value: Column, edges: list) -> Column:
    """How many edges lie below the value, by halving. A fixed expression: a task that is run again deals rows alike."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value <= F.lit(edges[mid]), within(low, mid)).otherwise(within(mid + 1, high))

    return within(0, len(edges))


def running(counts: DataFrame, value: str, sums: list[str], groups: list[str] | None = None, bands: int = BANDS, edges: list | None = None) -> DataFrame:
    """counts with upto_<c>, the sum of c over the values up to this one, and all_<c>, that over all, by group.

    counts has one row for each different value of a group. Values are dealt into bands by fixed edges and sorted within
    them; the bands before count by their totals, at most one row a band and group. So no task sorts all values, and a
    value that many rows share is one row. Null values come first, with the first band.
    """
    groups = groups or []
    parts = counts.withColumn("__band", band_of(F.col(value), band_edges(counts, value, bands) if edges is None else edges))
    totals = parts.groupBy(*groups, "__band").agg(*[F.sum(c).alias(f"__s_{c}") for c in sums])
    order = Window.partitionBy(*groups).orderBy("__band")
    past = [(F.sum(f"__s_{c}").over(order) - F.col(f"__s_{c}")).alias(f"__past_{c}") for c in sums]
    every = [F.sum(f"__s_{c}").over(Window.partitionBy(*groups)).alias(f"all_{c}") for c in sums]
    keys = [*groups, "__band"]
    before = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *past, *every)
    own = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    inside = parts.select("*", *[F.sum(c).over(own).alias(f"__own_{c}") for c in sums])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return inside.join(before, same).select(*counts.columns, *[(F.col(f"__past_{c}") + F.col(f"__own_{c}")).alias(f"upto_{c}") for c in sums], *[f"all_{c}" for c in sums])


def ranked(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """df with __below, __same and __all: how many values of the group lie below, are equal, and are there; null for null."""
    groups = groups or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n"))
    told = running(counts, value, ["n"], groups)
    keys = [*groups, value]
    side = told.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], (F.col("upto_n") - F.col("n")).alias("__below"), F.col("n").alias("__same"), F.col("all_n").alias("__all"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r{i}")) for i, k in enumerate(keys)])
    return df.join(side, same, "left").drop(*[f"__r{i}" for i in range(len(keys))])


def pct_ranks(df: DataFrame, value: str, groups: list[str], name: str) -> DataFrame:
    """df with the mid-rank of the value among those of its group that are there, by their number; null for null."""
    return ranked(df, value, groups).withColumn(name, (F.col("__below") + (F.col("__same") + 1) / 2) / F.col("__all")).drop("__below", "__same", "__all")


def row_numbers(df: DataFrame, value: str, tie: str, name: str, groups: list[str] | None = None) -> DataFrame:
    """df with the place of each row, from 1, in the order of value and tie, and __all, the rows of its group.

    Rows of one value are dealt into bands of tie, so that a value of a third of all rows isn't sorted in one task.
    """
    keys = [*(groups or []), value]
    parts = df.withColumn("__tie", band_of(F.col(tie), band_edges(df, tie)))
    counts = parts.groupBy(*keys, "__tie").agg(F.count("*").alias("n"))
    equal = Window.partitionBy(*keys).orderBy("__tie")
    told = running(counts.groupBy(*keys).agg(F.sum("n").alias("n")), value, ["n"], groups)
    places = counts.withColumn("__past", F.sum("n").over(equal) - F.col("n")).drop("n")
    below = told.select(*keys, (F.col("upto_n") - F.col("n")).alias("__below"), F.col("all_n").alias("__all"))
    out = parts.join(places.join(below, keys), [*keys, "__tie"])
    own = F.row_number().over(Window.partitionBy(*keys, "__tie").orderBy(tie))
    return out.withColumn(name, F.col("__below") + F.col("__past") + own).select(*df.columns, name, "__all")


def tile(place: Column, n: Column, tiles: int) -> Column:
    """The tile, from 1, of a place among n rows: tiles of equal counts, the first ones larger by one."""
    size, more = F.floor(n / tiles), n % tiles
    at, wide = place - 1, size + 1
    return F.when(at < more * wide, F.floor(at / wide) + 1).otherwise(more + F.floor((at - more * wide) / F.greatest(size, F.lit(1))) + 1).cast("int")


def exact_quantiles(df: DataFrame, value: str, shares: list[float], groups: list[str] | None = None, how: str = "linear", accuracy: int = 10_000) -> DataFrame:
    """One row a group: its keys and q, the exact quantiles in the order of the shares; how: linear, higher or lower.

    A sketch of fixed size brackets each quantile; the rows below each bracket are only counted, and only the different
    values within the brackets are ranked, about 4 rows in accuracy for each share and those equal to them. A bracket that
    the counts show to miss its quantile is opened to all values. Nulls don't count; without values there is no row, or
    one of null without groups. Brackets of up to BROADCAST_GROUPS counted groups are broadcast, so that rows of a few large
    groups stay where they are; with more groups rows are shuffled by group.
    """
    groups = groups or []
    k = len(shares)
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("__v"))
    at = [min(max(s + e, 0.0), 1.0) for s in shares for e in (-2 / accuracy, 2 / accuracy)]
    sketch = rows.groupBy(*groups).agg(F.percentile_approx("__v", F.array(*[F.lit(a) for a in at]), F.lit(accuracy)).alias("__e"))

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        if not groups:
            return left.crossJoin(F.broadcast(right))  # one row
        other = right.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], *[c for c in right.columns if c not in groups])
        return left.join(F.broadcast(other) if few else other, reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(groups)])).drop(*[f"__g{i}" for i in range(len(groups))])

    few = True
    if groups:
        shared_root(df.sparkSession)
        sketch = sketch.checkpoint()
        few = sketch.count() <= BROADCAST_GROUPS
    v, low, high = F.col("__v"), lambda i: F.col("__e")[2 * i], lambda i: F.col("__e")[2 * i + 1]
    seen = beside(rows, sketch).groupBy(*groups).agg(
        F.count("*").alias("__n"), *([] if groups else [F.first("__e").alias("__e")]), *[F.count_if(v < low(i)).alias(f"__below{i}") for i in range(k)], *[F.count_if(v <= high(i)).alias(f"__upto{i}") for i in range(k)]
    )
    seen = beside(seen, sketch) if groups else seen  # an array in a grouped aggregate would have each task sort its rows
    first, last = lambda i: F.floor(F.lit(shares[i]) * (F.col("__n") - 1) + 1e-9), lambda i: F.ceil(F.lit(shares[i]) * (F.col("__n") - 1) - 1e-9)
    hit = lambda i: (F.col(f"__below{i}") <= first(i)) & (last(i) < F.col(f"__upto{i}"))
    fit = seen.select(*groups, "__n", *[F.when(hit(i), low(i)).otherwise(float("-inf")).alias(f"__low{i}") for i in range(k)], *[F.when(hit(i), high(i)).otherwise(float("inf")).alias(f"__high{i}") for i in range(k)], *[F.when(hit(i), F.col(f"__below{i}")).otherwise(0).alias(f"__below{i}") for i in range(k)])
    fit = fit.checkpoint() if groups else fit  # a row a group
    part = F.explode(F.array(*[F.when(v.between(F.col(f"__low{i}"), F.col(f"__high{i}")), F.lit(i)) for i in range(k)]))
    near = beside(rows, fit).select(*groups, "__v", part.alias("__i")).where("__i is not null").groupBy(*groups, "__i", "__v").agg(F.count("*").alias("__c"))
    pick = lambda name: F.element_at(F.array(*[F.col(f"{name}{i}") for i in range(k)]), F.col("__i") + 1)
    upto = F.sum("__c").over(Window.partitionBy(*groups, "__i").orderBy("__v"))
    placed = beside(near.withColumn("__cum", upto), fit).withColumn("__cum", F.col("__cum") + pick("__below"))
    share = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("__i") + 1)
    h = share * (F.col("__n") - 1)
    ends = placed.withColumn("__h", h).groupBy(*groups, "__i").agg(F.first("__h").alias("__h"), F.min(F.when(F.col("__cum") > F.floor(F.col("__h") + 1e-9), v)).alias("__a"), F.min(F.when(F.col("__cum") > F.ceil(F.col("__h") - 1e-9), v)).alias("__b"))
    q = {"linear": F.col("__a") + (F.col("__b") - F.col("__a")) * (F.col("__h") - F.floor(F.col("__h") + 1e-9)), "higher": F.col("__b"), "lower": F.col("__a")}[how]
    return ends.groupBy(*groups).agg(*[F.max(F.when(F.col("__i") == i, q)).alias(f"__q{i}") for i in range(k)]).select(*groups, F.array(*[F.col(f"__q{i}") for i in range(k)]).alias("q"))


def mid_rank(value: str, by: WindowSpec) -> Column:
    """Rank with ties averaged, among the rows of the window's partition; for groups of a size that one task sorts."""
    ordered = by.orderBy(F.col(value).asc_nulls_last())
    same = ordered.rangeBetween(0, 0)
    return F.rank().over(ordered) + (F.count("*").over(same) - 1) / 2


def pct_rank_average(value: str, by: WindowSpec) -> Column:
    """Mid-rank by the number of values that are there; null for null."""
    return F.when(F.col(value).isNotNull(), mid_rank(value, by) / F.count(value).over(by))


def equal_bands(rank: Column, n: Column, bands: int) -> Column:
    """The band, from 1, of a rank among n rows, cut at equally spaced quantiles."""
    return F.greatest(F.lit(1), F.floor(((rank - 1) * bands + n - 2) / (n - 1))).cast("int")


def gini(value: str, rank: str) -> Column:
    """Gini coefficient as an aggregate; rank: 1 for the smallest."""
    n, s = F.count(value), F.sum(value)
    return F.when(s > 0, 2 * F.sum(F.col(rank) * F.col(value)) / (n * s) - (n + 1) / n)


def herfindahl(value: str) -> Column:
    return F.when(F.sum(value) > 0, F.sum(F.col(value) * F.col(value)) / F.pow(F.sum(value), F.lit(2)))


def normalised_entropy(counts: DataFrame, key: str, n: str) -> DataFrame:
    """key and entropy of its counts by the logarithm of how many there are; 0 for fewer than two."""
    p = F.col(n) / F.sum(n).over(Window.partitionBy(key))
    out = counts.withColumn("__p", p).groupBy(key).agg(F.count("*").alias("__k"), (-F.sum(F.col("__p") * F.log("__p"))).alias("__h"))
    return out.select(key, F.when(F.col("__k") < 2, 0.0).otherwise(F.col("__h") / F.log("__k")).alias("entropy"))


def total_variation(left: DataFrame, right: DataFrame, key: str, category: str) -> DataFrame:
    """key and half the summed absolute difference of the category shares; both sides: key, category, n."""
    share = lambda df, name: df.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(key))).drop("n")
    both = share(left, "__p").join(share(right, "__q"), [key, category], "full")
    return both.groupBy(key).agg((0.5 * F.sum(F.abs(F.coalesce("__p", F.lit(0.0)) - F.coalesce("__q", F.lit(0.0))))).alias("distance"))


def banded_mid_ranks(df: DataFrame, value: str, group: str, name: str, bands: int = 16) -> DataFrame:
    """df with the value's rank in its group, ties averaged; rows are sorted in bands of each group, the bands before count by their totals.

    Rows of one value share a band. For values that are there; a null group is a group of its own.
    """
    parts = df.withColumn("__band", band_of(F.col(value), band_edges(df, value, bands)))
    past = F.sum("__n").over(Window.partitionBy(group).orderBy("__band")) - F.col("__n")
    before = parts.groupBy(group, "__band").agg(F.count("*").alias("__n")).select(F.col(group).alias("__g"), F.col("__band").alias("__b"), past.alias("__past"))
    inside = parts.withColumn("__own", mid_rank(value, Window.partitionBy(group, "__band")))
    out = inside.join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__band") == F.col("__b")))
    return out.select(*df.columns, (F.col("__past") + F.col("__own")).alias(name))


def spearman(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """group, pearson and spearman of the rows that have both values."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, x, y)
    shared_root(df.sparkSession)
    known = known.checkpoint()  # read for edges and totals of both values
    ranked = banded_mid_ranks(banded_mid_ranks(known, x, group, "__rx"), y, group, "__ry")
    return ranked.groupBy(group).agg(F.corr(x, y).alias("pearson"), F.corr("__rx", "__ry").alias("spearman"))


def weighted_regression(x: Column, y: Column, w: Column) -> dict[str, Column]:
    """slope, correlation, effective_n and shrunken_slope as aggregates."""
    sw = F.sum(w)
    mx, my = F.sum(w * x) / sw, F.sum(w * y) / sw
    vx, vy, c = F.sum(w * x * x) / sw - mx * mx, F.sum(w * y * y) / sw - my * my, F.sum(w * x * y) / sw - mx * my
    n = sw * sw / F.sum(w * w)
    slope = F.when(vx > 0, c / vx)
    return {"slope": slope, "correlation": F.when((vx > 0) & (vy > 0), c / F.sqrt(vx * vy)), "effective_n": n, "shrunken_slope": slope * n / (n + 3)}


def auc(scored: DataFrame, groups: list[str], label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve by mid-ranks; null with one class. Ties and classes are counted first, so only different scores are sorted, in bands.

    A band adds up what its positives win within it; against the bands below they win by the bands' totals. So counts are shuffled
    once to be made and once to be sorted, whatever the number of different scores.
    """
    known = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = known.groupBy(*groups, score).agg(F.sum(label).cast("double").alias("pos"), F.count("*").alias("n"))
    parts = counts.withColumn("__band", band_of(F.col(score), band_edges(known, score))).withColumn("neg", F.col("n") - F.col("pos"))
    own = Window.partitionBy(*groups, "__band").orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    inside = parts.withColumn("__below", F.sum("neg").over(own) - F.col("neg"))
    per = inside.groupBy(*groups, "__band").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * (F.col("__below") + F.col("neg") / 2)).alias("won"))
    past = F.sum("neg").over(Window.partitionBy(*groups).orderBy("__band")) - F.col("neg")  # a row a band
    pos, other = F.sum("pos"), F.sum("neg")
    return per.withColumn("won", F.col("won") + F.col("pos") * past).groupBy(*groups).agg(F.when((pos > 0) & (other > 0), F.sum("won") / (pos * other)).alias("auc"))


def average_precision(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Step sum over the different scores, highest first."""
    told = running(scored.groupBy(score).agg(F.sum(label).cast("double").alias("pos"), F.count("*").alias("n")), score, ["pos", "n"])
    tp, seen = F.col("all_pos") - F.col("upto_pos") + F.col("pos"), F.col("all_n") - F.col("upto_n") + F.col("n")
    return told.agg(F.when(F.sum("pos") > 0, F.sum(F.col("pos") * tp / seen) / F.sum("pos")).alias("average_precision"))


def benjamini_hochberg(df: DataFrame, group: str, p: str, tie: str) -> DataFrame:
    """df with p_adjusted: the least of p * m / rank over this and all higher ranks, at most 1; null p-values aren't counted and stay null.

    Rows of one p-value share their last rank's result whatever the order of tie, so values are counted and ranked in bands, and
    the least of what follows is a running one from the highest p-value down: no family is sorted in one task.
    """
    counts = df.where(F.col(p).isNotNull()).groupBy(group, p).agg(F.count("*").alias("__n"))
    edges = band_edges(counts, p)
    raw = F.col(p) * F.col("all___n") / F.col("upto___n")
    parts = running(counts, p, ["__n"], [group], edges=edges).select(F.col(group).alias("__g"), F.col(p).alias("__p"), raw.alias("__raw"), band_of(F.col(p), edges).alias("__band"))
    above = Window.partitionBy("__g").orderBy(F.desc("__band")).rowsBetween(Window.unboundedPreceding, -1)
    later = parts.groupBy("__g", "__band").agg(F.min("__raw").alias("__m")).select(F.col("__g").alias("__h"), F.col("__band").alias("__b"), F.min("__m").over(above).alias("__later"))
    own = Window.partitionBy("__g", "__band").orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, 0)
    told = parts.withColumn("__own", F.min("__raw").over(own)).join(later, F.col("__g").eqNullSafe(F.col("__h")) & (F.col("__band") == F.col("__b")))
    side = told.select("__g", "__p", F.least(F.lit(1.0), "__own", "__later").alias("p_adjusted"))
    return df.join(side, F.col(group).eqNullSafe(F.col("__g")) & (F.col(p) == F.col("__p")), "left").drop("__g", "__p")
