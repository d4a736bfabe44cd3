"""Entity resolution and selection: blocked similarity, votes by shared members, greedy picks, result checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalars import similarity_ratio
from tidemark.operators.relational import top_per_key


def blocked_matches(
    left: DataFrame, right: DataFrame, block: list[str], left_id: str, right_id: str, left_name: str, right_name: str, *, least: float = 0.6, most: int = 5, margin: float = 0.03, sure: float = 0.92, tokens: bool = False, same: bool = False
) -> DataFrame:
    """left_id, right_id, score, place and accepted: the best candidates of each left name among the right names of its block.

    Exact names score 1. accepted: the first place, either sure or ahead of the second by the margin. Different names are
    paired, within a block or (tokens) where they share a word, and each right name goes on with the few rows that can take
    a place; so rows of equal names make no pairs. same: both sides are one table, and no row meets itself.
    """
    words = lambda c: F.array_distinct(F.array_append(F.split(F.lower(c), "[^\\p{L}\\p{N}]+"), F.lower(c))) if tokens else F.array(F.lit(""))
    names = lambda rows, c: rows.select(*block, c).distinct().withColumn("__word", F.explode(words(F.col(c)))).where((F.col("__word") != "") | F.lit(not tokens))
    pairs = names(left, left_name).join(names(right, right_name), [*block, "__word"]).select(*block, left_name, right_name).distinct()
    scored = pairs.withColumn("score", F.when(F.col(left_name) == F.col(right_name), 1.0).otherwise(F.round(similarity_ratio(F.col(left_name), F.col(right_name)), 6))).where(F.col("score") >= least)
    few = top_per_key(right.select(*block, right_id, right_name), [*block, right_name], [F.col(right_id)], most + 1)
    met = left.select(*block, left_id, left_name).join(scored, [*block, left_name]).join(few, [*block, right_name])
    w = Window.partitionBy(left_id).orderBy(F.desc("score"), right_id)
    ranked = (met.where(F.col(left_id) != F.col(right_id)) if same else met).withColumn("place", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where(F.col("place") <= most)
    ok = (F.col("place") == 1) & ((F.col("score") >= sure) | (F.col("score") - F.coalesce("next", F.lit(0.0)) >= margin))
    return ranked.select(left_id, right_id, "score", "place", ok.alias("accepted"))


def tiered_matches(left: DataFrame, right: DataFrame, block: list[str], left_id: str, right_id: str, tiers: list[tuple[str, str, str]], left_members: DataFrame, right_members: DataFrame, member: str) -> DataFrame:
    """left_id, n_candidates, right_id, tier and status of each left row: the right row that its first fitting tier gives.

    tiers: (tier, left column, right column), the surest first, as folded names and then sorted words. A row goes to the
    first tier in which any right row of its block has the same value: accepted if there is one, else resolved by the
    members that both share, if one right row has more of them than all others, else ambiguous. Without a candidate it is
    unmatched, and left to similarity.

    Names are told by counts and minima, so a name of many rows on both sides makes no pairs; only pairs that share a
    member are made, and only for rows that need them.
    """
    rows = left
    for i, (_, mine, theirs) in enumerate(tiers):
        side = right.where(F.col(theirs) != "").groupBy(*block, F.col(theirs).alias(mine)).agg(F.count_distinct(right_id).alias(f"__n{i}"), F.min(right_id).alias(f"__r{i}"))
        rows = rows.join(side, [*block, mine], "left")
    at = F.coalesce(*[F.when(F.col(f"__n{i}") > 0, F.lit(i)) for i in range(len(tiers))])
    found = rows.withColumn("__tier", at).withColumn("__n", F.coalesce(*[F.col(f"__n{i}") for i in range(len(tiers))], F.lit(0))).withColumn("__r", F.coalesce(*[F.col(f"__r{i}") for i in range(len(tiers))]))
    votes = None
    for i, (_, mine, theirs) in enumerate(tiers):
        a = found.where((F.col("__tier") == i) & (F.col("__n") > 1)).join(left_members, left_id).select(left_id, *block, F.col(mine).alias("__name"), member)
        b = right.join(right_members, right_id).select(right_id, *block, F.col(theirs).alias("__name"), member)
        pairs = a.distinct().join(b.distinct(), [*block, "__name", member]).groupBy(left_id, right_id).agg(F.count("*").alias("__votes"))
        votes = pairs if votes is None else votes.unionByName(pairs)
    level = votes.groupBy(left_id, "__votes").agg(F.count("*").alias("__same"), F.min(right_id).alias("__id"))
    best = level.groupBy(left_id).agg(F.max(F.struct("__votes", "__same", "__id")).alias("__m"))
    out = found.join(best, left_id, "left")
    led = F.coalesce(F.col("__m.__same") == 1, F.lit(False))
    one = F.col("__n") == 1
    tier = F.coalesce(*[F.when(F.col("__tier") == i, t) for i, (t, _, _) in enumerate(tiers)])
    status = F.when(F.col("__n") == 0, "unmatched").when(one, "accepted").when(led, "resolved").otherwise("ambiguous")
    return out.select(left_id, F.col("__n").alias("n_candidates"), F.when(one, F.col("__r")).when(led, F.col("__m.__id")).alias(right_id), tier.alias("tier"), status.alias("status"))


def member_votes(left: DataFrame, right: DataFrame, left_group: str, right_group: str, member: str, *, margin: int = 2, share: float = 0.2) -> DataFrame:
    """For each left group the right group with which it shares the most members: votes, the lead over the second, and whether both suffice."""
    votes = left.join(right, member).groupBy(left_group, right_group).agg(F.count_distinct(member).alias("votes"))
    sizes = left.groupBy(left_group).agg(F.count_distinct(member).alias("size"))
    w = Window.partitionBy(left_group).orderBy(F.desc("votes"), right_group)
    best = votes.withColumn("place", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("votes").over(w), F.lit(0))).where("place = 1").join(sizes, left_group)
    lead = F.col("votes") - F.col("second")
    return best.select(left_group, right_group, "votes", lead.alias("lead"), ((lead >= margin) & (F.col("votes") >= share * F.col("size"))).alias("resolved"))


def mapped(rows: DataFrame, mapping: DataFrame, key: str, value: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """rows with the mapping's value for their key; literal overrides come first, keys with several values are left out."""
    single = mapping.groupBy(key).agg(F.count_distinct(value).alias("__n"), F.min(value).alias(value)).where("__n = 1").drop("__n")
    out = rows.join(single, key, "left")
    if overrides:
        literal = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
        out = out.withColumn(value, F.coalesce(F.try_element_at(literal, F.col(key)), F.col(value)))
    return out


def greedy_picks(rows: DataFrame, category: str, person: str, role: str, score: str, quota: int) -> DataFrame:
    """Up to quota rows of each category by falling score: no person twice, first one of each role, then any.

    Only the best rows of each category, person and role can be picked, so those are kept before a category is gathered:
    at most quota persons of a role can matter.
    """
    best = top_per_key(rows, [category, person, role], [F.desc(score)])
    few = top_per_key(best, [category, role], [F.desc(score), F.col(person)], quota * quota)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, person], ascending=[False, True])
        persons, roles, picked = set(), set(), []
        for again in (False, True):
            for i, p, r in zip(pdf.index, pdf[person], pdf[role], strict=True):
                if len(picked) < quota and p not in persons and i not in picked and (again or r not in roles):
                    persons.add(p)
                    roles.add(r)
                    picked.append(i)
        return pdf.loc[picked]

    return few.groupBy(category).applyInPandas(pick, few.schema)


def self_lookup(rows: DataFrame, scope: str, reference: str, target: str, columns: dict[str, str]) -> DataFrame:
    """rows with columns of the row of the same scope that they refer to."""
    found = rows.select(F.col(scope).alias("__s"), F.col(target).alias("__t"), *[F.col(c).alias(name) for c, name in columns.items()])
    return rows.join(found, (F.col(scope) == F.col("__s")) & (F.col(reference) == F.col("__t")), "left").drop("__s", "__t")


def paired(candidate: DataFrame, baseline: DataFrame, keys: list[str], actual: str, prediction: str) -> DataFrame:
    """Rows of both with both predictions; raises if they don't agree on the actual value."""
    both = candidate.select(*keys, F.col(actual), F.col(prediction).alias("candidate")).join(baseline.select(*keys, F.col(actual).alias("__actual"), F.col(prediction).alias("baseline")), keys)
    wrong = both.where(~F.col(actual).eqNullSafe(F.col("__actual"))).limit(1).collect()
    if wrong:
        raise ValueError(f"the actual values differ: {wrong[0]}")
    return both.drop("__actual")


def masked(df: DataFrame, columns: list[str], available: Column) -> DataFrame:
    """df with a block of columns null where its evidence isn't available."""
    return df.withColumns({c: F.when(available, F.col(c)) for c in columns})


def violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, failed) of the rows that break any named check; an unknown check counts as broken."""
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    return df.select(key, codes.alias("failed")).where(F.size("failed") > 0)
