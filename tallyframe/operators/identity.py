"""Entity resolution: passes of matching, graded links, aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.windows import placed


def passes(people: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, status, match): ALIAS, else EXACT name, else WEAK (same first initial and surname, if only one), else CONFLICT or NONE.

    people(id, name), known(pid, name), aliases(alias, pid). Of several equal names or aliases the least pid counts."""
    first = lambda c: F.substring(F.lower(c), 1, 1)
    last = lambda c: F.element_at(F.split(F.lower(c), " "), -1)
    a = aliases.groupBy(F.lower("alias").alias("_a")).agg(F.min("pid").alias("by_alias"))
    e = known.groupBy(F.lower("name").alias("_a")).agg(F.min("pid").alias("by_name"))
    w = known.groupBy(first("name").alias("_f"), last("name").alias("_l")).agg(F.min("pid").alias("weak"), F.countDistinct("pid").alias("weak_n"))
    p = people.select("id", F.lower("name").alias("_a"), first("name").alias("_f"), last("name").alias("_l"))
    p = p.join(a, "_a", "left").join(e, "_a", "left").join(w, ["_f", "_l"], "left")
    status = F.when(F.col("by_alias").isNotNull(), "ALIAS").when(F.col("by_name").isNotNull(), "EXACT").when(F.col("weak_n") == 1, "WEAK").when(F.col("weak_n") > 1, "CONFLICT").otherwise("NONE")
    return p.select("id", status.alias("status"), F.when(status != "CONFLICT", F.coalesce("by_alias", "by_name", F.when(F.col("weak_n") == 1, F.col("weak")))).alias("match"))


def graded_edges(edges: DataFrame) -> DataFrame:
    """Edges (l, r) graded by their ends' degrees: HIGH if both have one edge, MEDIUM otherwise, with the reason."""
    both = edges.distinct()
    both = both.withColumn("dl", F.count("*").over(Window.partitionBy("l"))).withColumn("dr", F.count("*").over(Window.partitionBy("r")))
    reason = F.when(F.col("dr") > 1, "several_left").when(F.col("dl") > 1, "several_right").otherwise("one_to_one")
    return both.select("l", "r", F.when((F.col("dl") == 1) & (F.col("dr") == 1), "HIGH").otherwise("MEDIUM").alias("grade"), reason.alias("reason"))


def scored(candidates: DataFrame, key: str, other: str, score: str) -> DataFrame:
    """(key, match, score, status): the best candidate, CONFLICT where the best score is shared."""
    best = candidates.groupBy(key, other).agg(F.max(score).alias(score))
    w = Window.partitionBy(key).orderBy(F.desc(score))
    best = best.withColumn("_r", F.rank().over(w)).where("_r = 1")
    out = best.groupBy(key).agg(F.count("*").alias("_n"), F.min(other).alias("match"), F.max(score).alias(score))
    return out.select(key, F.when(F.col("_n") == 1, F.col("match")).alias("match"), score, F.when(F.col("_n") == 1, "MATCHED").otherwise("CONFLICT").alias("status"))


def scored_by_group(people: DataFrame, key: str, group: str, known: DataFrame, other: str, other_group: str, hit: int, miss: int) -> DataFrame:
    """As `scored` over all pairs of people and known ones, which score `hit` in the same group and `miss` otherwise, hit > miss.

    No pair is made: candidates are counted once for each group, and once in all for people without one in their group. A key with
    rows in several groups (a null is none) has the candidates of each, every one once."""
    p = people.groupBy(key).agg(F.sort_array(F.collect_set(group)).alias("_g"))
    k = known.select(F.col(other).alias("_o"), F.col(other_group).alias("_of")).distinct()
    near = p.select("_g").distinct().select("_g", F.explode("_g").alias("_of")).join(k, "_of").select("_g", "_o").distinct()
    near = near.groupBy("_g").agg(F.count("*").alias("_n"), F.min("_o").alias("_m"))
    rest = k.select("_o").distinct().agg(F.count("*").alias("_all"), F.min("_o").alias("_first")).where("_all > 0")
    out = p.join(near, "_g", "left").crossJoin(F.broadcast(rest))
    best = F.col("_n").isNotNull()
    n = F.coalesce("_n", "_all")
    match = F.when(best, F.col("_m")).otherwise(F.col("_first"))
    return out.select(key, F.when(n == 1, match).alias("match"), F.when(best, hit).otherwise(miss).alias("score"), F.when(n == 1, "MATCHED").otherwise("CONFLICT").alias("status"))


def most_referenced(df: DataFrame, name: str, pid: str) -> DataFrame:
    """(pid, kept): each name's ids are remapped to the one that occurs most (ties: the least)."""
    n = df.groupBy(name, pid).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(name).orderBy(F.desc("_n"), pid)
    return n.select(pid, F.first(pid).over(w).alias("kept"))


def unique_keys(df: DataFrame, base: str, order: list[str], deal: Column | None = None) -> DataFrame:
    """Adds `key`: the base for the first row in order, base_2, base_3 and so on for the others. `deal` splits bases with many rows: it
    rises with the order, and rows are numbered within it and over it."""
    out = placed(df, [base], F.lit(0) if deal is None else deal, order, "_n")
    return out.withColumn("key", F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), F.col("_n").cast("string")))).drop("_n")
