"""Repairs of results and names: reshaping, merging, relabelling, remapping, local aliases, scores of sequences, tiers in force."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.joins import latest_per_key
from tallyframe.operators.windows import top_per_key


def pick_one(df: DataFrame, slot: list[str], order: list[str], member: str, ghost: Column, placeholder: Column, has_id: Column, clean: Column) -> DataFrame:
    """(slot, status, pick): the member that a slot keeps when teams become single competitors.

    Ghosts and placeholders go. Of the first two left a sole one wins; else the only one with an id; else the better score (4 for an id,
    2 for a clean name); equal scores are AMBIGUOUS, and a slot without anyone is EMPTY. Null flags count as false."""
    yes = lambda c, n: F.when(c, n).otherwise(0)
    real = df.where((yes(ghost, 1) + yes(placeholder, 1)) == 0).select(*slot, *{*order, member}, yes(has_id, 1).alias("has"), (yes(has_id, 4) + yes(clean, 2) + 1).alias("score"))
    two = top_per_key(real, slot, [F.col(c) for c in order], 2)
    per = two.groupBy(*slot).agg(F.count("*").alias("n"), F.sum("has").alias("ids"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.max_by(member, "score").alias("best"))
    status = F.when(F.col("n").isNull(), "EMPTY").when(F.col("n") == 1, "SOLE").when(F.col("ids") == 1, "ID").when(F.col("hi") > F.col("lo"), "SCORE").otherwise("AMBIGUOUS")
    return df.select(*slot).distinct().join(per, slot, "left").select(*slot, status.alias("status"), F.when(status != "AMBIGUOUS", F.col("best")).alias("pick"))


def merge_groups(df: DataFrame, group: str, slot: str, member: str, remap: DataFrame) -> DataFrame:
    """(group, slot, n, moved, conflict) after remap(doomed, survivor): conflict where a slot holds different members of several groups."""
    both = df.join(remap, F.col(group) == F.col("doomed"), "left").select(F.coalesce("survivor", group).alias("into"), F.col(group).alias("was"), slot, member)
    differ = (F.min("was") != F.max("was")) & (F.min(member) != F.max(member))
    return both.groupBy(F.col("into").alias(group), slot).agg(F.count("*").alias("n"), F.count_if(F.col("was") != F.col("into")).alias("moved"), F.coalesce(differ, F.lit(False)).alias("conflict"))


def qualify_bare(labels: DataFrame, group: str, label: str, bare: Column, other: Column, suffix: str) -> DataFrame:
    """Adds new_label to distinct (group, label): bare labels get `suffix` in groups that also have a label of another kind.

    Where the group has that longer label already, nothing changes."""
    kinds = labels.groupBy(group).agg(F.bool_or(other).alias("_other"))
    taken = labels.select(F.col(group).alias("_g"), F.col(label).alias("_l"))
    longer = F.concat(label, F.lit(suffix))
    both = labels.join(kinds, group).join(taken, (F.col(group) == F.col("_g")) & (longer == F.col("_l")), "left")
    return both.withColumn("new_label", F.when(bare & F.col("_other") & F.col("_l").isNull(), longer).otherwise(F.col(label))).drop("_other", "_g", "_l")


def remap_members(df: DataFrame, key: str, members: str, remap: DataFrame, sep: str = "|") -> DataFrame:
    """(key, members, changed): ids inside separated `members` replaced in place by remap(old, new). Chains are not followed."""
    parts = df.select(key, F.posexplode(F.split(members, re.escape(sep))).alias("pos", "old")).join(remap, "old", "left")
    listed = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("new", "old").alias("id"))))
    joined = F.array_join(F.transform(listed, lambda x: x["id"]), sep)
    return parts.groupBy(key).agg(joined.alias(members), F.count_if(F.col("new") != F.col("old")).alias("changed"))


def local_aliases(df: DataFrame, groups: list[str], name: str, member: str, prefix: int = 3) -> DataFrame:
    """(groups, token, kind, member): what a short mention means inside its group.

    Kinds: 1 whole name, 2 first word, 3 last word, 4 initials, 5 the first letters. A token counts for a kind if one member alone has it;
    of several kinds the first counts."""
    n = F.trim(F.lower(name))
    words = F.split(n, " ")
    initials = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    tokens = [n, F.element_at(words, 1), F.element_at(words, -1), initials, F.substring(n, 1, prefix)]
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), t.alias("token")) for i, t in enumerate(tokens, 1)])).alias("t")
    each = df.select(*groups, F.col(member).alias("_m"), listed).groupBy(*groups, "t.token", "t.kind").agg(F.min("_m").alias("lo"), F.max("_m").alias("hi"))
    return each.where("lo = hi").groupBy(*groups, "token").agg(F.min("kind").alias("kind"), F.min_by("lo", "kind").alias(member))


def sequence_scores(items: DataFrame, chain: str, name: str, direct: DataFrame, aliases: DataFrame, modifiers: DataFrame) -> DataFrame:
    """(chain, items, resolved, mean): direct(name, score), else by aliases(alias, name), else the last word's score plus modifiers(word, plus).

    Every word before the last must be a modifier. The mean is over all items; those without a score count 0. Names are resolved once
    each, so chains only look numbers up."""
    names = items.select(F.col(name).alias("_name")).distinct()
    own = direct.select(F.col("name").alias("_name"), F.col("score").alias("by_name"))
    by_alias = aliases.join(direct, "name").select(F.col("alias").alias("_name"), F.col("score").alias("by_alias"))
    words = F.split("_name", " ")
    before = names.select("_name", F.explode(F.slice(words, 1, F.size(words) - 1)).alias("word")).join(modifiers, "word", "left")
    before = before.groupBy("_name").agg(F.sum("plus").alias("plus"), F.count_if(F.col("plus").isNull()).alias("unknown")).where("unknown = 0")
    base = names.withColumn("base", F.element_at(words, -1)).join(direct.select(F.col("name").alias("base"), F.col("score").alias("by_base")), "base").join(before, "_name").select("_name", (F.col("by_base") + F.col("plus")).alias("by_parts"))
    found = names.join(own, "_name", "left").join(by_alias, "_name", "left").join(base, "_name", "left").select("_name", F.coalesce("by_name", "by_alias", "by_parts").alias("score"))
    per = items.groupBy(chain, F.col(name).alias("_name")).agg(F.count("*").alias("k")).join(found, "_name")
    return per.groupBy(chain).agg(F.sum("k").alias("items"), F.sum(F.when(F.col("score").isNotNull(), F.col("k")).otherwise(0)).alias("resolved"), F.round(F.sum(F.coalesce("score", F.lit(0)) * F.col("k")) / F.sum("k"), 6).alias("mean"))


def merge_longest(tokens: Column, lexicon: list[list[str]]) -> Column:
    """An array of tokens with runs in the lexicon merged into one, from the left, the longest first. Tokens hold neither < nor >."""
    marked = F.concat(F.lit("<"), F.array_join(tokens, "><"), F.lit(">"))
    pattern = "|".join([*("".join(f"<{re.escape(t)}>" for t in run) for run in sorted(lexicon, key=len, reverse=True)), "<[^>]*>"])
    return F.transform(F.regexp_extract_all(marked, F.lit(pattern), F.lit(0)), lambda x: F.regexp_replace(F.regexp_replace(x, "><", " "), "[<>]", ""))


def tiers_in_force(ledger: DataFrame, members: DataFrame, asof: Column) -> DataFrame:
    """(member, tier, expires) of every member at `asof`, from ledger(member, id, at, tier, expires, fallback, bought) of additions only.

    The latest row counts. An expired tier falls back, to tier0 unless the fallback is of tier1 or tier2. Whoever ever bought stands at
    tier1_lifetime at least. Members without rows are tier0."""
    known = ledger.where(F.col("at") <= asof)
    last = latest_per_key(known.select("member", "id", "at", "tier", "expires", "fallback"), ["member"], [F.desc("at"), F.desc("id")])
    over = F.coalesce(F.col("expires") <= asof, F.lit(False))
    held = F.when(over, F.when(F.col("fallback").rlike("^tier[12]_"), F.col("fallback")).otherwise("tier0")).otherwise(F.col("tier"))
    now = last.select("member", held.alias("tier"), F.when(~over, F.col("expires")).alias("expires")).join(known.groupBy("member").agg(F.bool_or("bought").alias("bought")), "member")
    lifted = F.col("bought") & F.col("tier").isin("tier0", "tier1_annual")
    now = now.select("member", F.when(lifted, "tier1_lifetime").otherwise(F.col("tier")).alias("tier"), F.when(~lifted, F.col("expires")).alias("expires"))
    return members.select("member").join(now, "member", "left").select("member", F.coalesce("tier", F.lit("tier0")).alias("tier"), "expires")
