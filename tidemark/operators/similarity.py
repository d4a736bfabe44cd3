"""Pairs of names by difflib's ratio, without comparing all pairs and without losing any.

Twice the matching characters by the characters of both is at least r only if

* the lengths allow it: the shorter has at least r / (2 - r) of the longer's characters,
* they share enough characters, counted with repeats: at least r / 2 of those of both, and
* they share enough pairs of neighbouring characters: matches form at most one run more than there are unmatched characters, and a run
  of m characters has m - 1 such pairs, which leaves at least (3 r / 2 - 1) of the characters of both, less one.

Names are indexed by their rarest grams: of two names that share c of their grams, each has one among its first (number of grams - c + 1)
in one order of all grams. Where the last bound holds for a pair's lengths, the grams are pairs of characters, else single ones.
Pairs that meet are checked by the other bounds in the JVM, and only those left are compared in Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalars import similarity_ratio
from tidemark.operators.entities import tiered_matches
from tidemark.operators.relational import top_per_key

ROUNDING = 1e-6  # scores are rounded to so much


def grams(name: Column, size: int) -> Column:
    """The runs of so many characters of a name, repeats told apart by number, so that common ones are an intersection."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    runs = chars if size == 1 else F.filter(F.transform(chars, lambda c, i: F.when(i + 1 < F.size(chars), F.concat(c, F.get(chars, i + 1)))), lambda g: g.isNotNull())
    ordered = F.array_sort(runs)
    return F.transform(ordered, lambda g, i: F.concat(g, F.lit("\x00"), (i + 1 - F.array_position(ordered, g)).cast("string")))


def common_characters(least: float, both: Column) -> Column:
    return F.ceil((least / 2 - ROUNDING) * both)


def common_pairs(least: float, both: Column) -> Column:
    return F.ceil((1.5 * least - 1 - 3 * ROUNDING) * both - 1)


def _indexed(names: DataFrame, block: list[str], name: str, size: int, often: DataFrame, shortest: Callable[[Column], Column]) -> DataFrame:
    """block, name, length, n_grams, place and gram: the first grams of each name in the order of rarity that any partner must share one of."""
    each = names.select(*block, name, F.char_length(name).alias("length"), F.explode(grams(F.col(name), size)).alias("gram")).join(often, "gram")
    held = each.groupBy(*block, name, "length").agg(F.array_sort(F.collect_list(F.struct("times", "gram"))).alias("g"))  # a name's grams
    first = F.slice("g", F.lit(1), F.greatest(F.size("g") - F.greatest(shortest(F.col("length")), F.lit(1)) + 1, F.lit(0)))
    return held.select(*block, name, "length", F.size("g").alias("n_grams"), F.posexplode(F.transform(first, lambda x: x["gram"])).alias("place", "gram"))


def similar_pairs(left: DataFrame, right: DataFrame, block: list[str], left_name: str, right_name: str, least: float = 0.6) -> DataFrame:
    """block, left_name, right_name and score of all pairs of different names of a block whose rounded ratio is `least` or more.

    Null and empty names match nothing.
    """
    if not 0 < least <= 1:
        raise ValueError("least is above 0 and at most 1")
    some = lambda df, c: df.select(*block, c).where(F.col(c) != "").distinct()
    a, b = some(left, left_name), some(right, right_name)
    ratio = least / (2 - least)
    found = None
    for size, bound in ((2, common_pairs), (1, common_characters)):
        if size == 2 and 1.5 * least <= 1:
            continue
        every = a.select(F.col(left_name).alias("__n")).unionByName(b.select(F.col(right_name).alias("__n"))).distinct()
        often = every.select(F.explode(grams(F.col("__n"), size)).alias("gram")).groupBy("gram").agg(F.count("*").alias("times"))
        shortest = lambda length, bound=bound: bound(least, length * (1 + ratio - 2 * ROUNDING)).cast("int")
        x = _indexed(a, block, left_name, size, often, shortest)
        y = _indexed(b, block, right_name, size, often, shortest).withColumnsRenamed({"length": "__length", "n_grams": "__n", "place": "__place"})
        both, pairs = F.col("length") + F.col("__length"), common_pairs(least, F.col("length") + F.col("__length"))
        enough = F.least(F.col("n_grams") - F.col("place"), F.col("__n") - F.col("__place")) >= bound(least, both)  # places count from 0
        near = F.least("length", "__length") >= (least / 2 - ROUNDING) * both
        mine = (pairs >= 1 if size == 2 else pairs < 1) if 1.5 * least > 1 else F.lit(True)
        met = x.join(y, [*block, "gram"]).where(enough & near & mine & (F.col(left_name) != F.col(right_name))).select(*block, left_name, right_name).distinct()
        found = met if found is None else found.unionByName(met)
    both = F.char_length(left_name) + F.char_length(right_name)
    sizes = (1, 2) if 1.5 * least > 1 else (1,)
    held = lambda df, c, side: df.select(*block, c, *[grams(F.col(c), k).alias(f"__{side}{k}") for k in sizes])
    met = found.join(held(a, left_name, "a"), [*block, left_name]).join(held(b, right_name, "b"), [*block, right_name])
    shared = lambda k: F.size(F.array_intersect(f"__a{k}", f"__b{k}"))
    fits = (shared(1) >= common_characters(least, both)) & ((shared(2) >= common_pairs(least, both)) if 2 in sizes else F.lit(True))
    scored = met.where(fits).select(*block, left_name, right_name, F.round(similarity_ratio(F.col(left_name), F.col(right_name)), 6).alias("score")).where(F.col("score") >= least)
    same = a.join(b.withColumn(left_name, F.col(right_name)), [*block, left_name]).select(*block, left_name, right_name, F.lit(1.0).alias("score"))
    return scored.unionByName(same)


def three_tier_matches(
    left: DataFrame, right: DataFrame, block: list[str], left_id: str, right_id: str, name: str, words: str, left_members: DataFrame, right_members: DataFrame, member: str, *, least: float = 0.6, sure: float = 0.92, margin: float = 0.03
) -> DataFrame:
    """left_id, n_candidates, right_id, tier, status and score of each left row: by name, then by sorted words, then by ratio.

    Rows without a candidate in the first two tiers take the right name of the highest ratio, the smallest right_id of that name: accepted if
    the score is sure or ahead of the next name's by the margin, else ambiguous; unmatched below `least`. Both tables have the columns
    `name` and `words`.
    """
    first = tiered_matches(left, right, block, left_id, right_id, [("exact", name, name), ("words", words, words)], left_members, right_members, member)
    open_ = left
    for c in (name, words):
        open_ = open_.join(right.where(F.col(c) != "").select(*block, c).distinct(), [*block, c], "left_anti")
    named = right.select(*block, F.col(name).alias("__other"), right_id)
    scored = similar_pairs(open_.select(*block, name), named, block, name, "__other", least)
    w = Window.partitionBy(*block, name).orderBy(F.desc("score"), "__other")
    best = scored.select(*block, name, "__other", "score", F.row_number().over(w).alias("__place"), F.lead("score").over(w).alias("__next"), F.count("*").over(Window.partitionBy(*block, name)).alias("__n")).where("__place = 1")
    ids = top_per_key(named, [*block, "__other"], [F.col(right_id)], 1)
    ok = (F.col("score") >= sure) | (F.col("score") - F.coalesce("__next", F.lit(0.0)) >= margin)
    told = open_.select(left_id, *block, name).join(best, [*block, name], "left").join(ids, [*block, "__other"], "left")
    third = told.select(left_id, F.coalesce("__n", F.lit(0)).alias("n_candidates"), F.when(ok, F.col(right_id)).alias(right_id), F.when(F.col("score").isNotNull(), "ratio").alias("tier"), F.when(ok, "accepted").when(F.col("score").isNotNull(), "ambiguous").otherwise("unmatched").alias("status"), "score")
    done = first.where("status != 'unmatched'").select(left_id, "n_candidates", right_id, "tier", "status", F.lit(None).cast("double").alias("score"))
    return done.unionByName(third)
