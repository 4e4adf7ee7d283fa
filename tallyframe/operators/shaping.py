"""Flat rows to what a page shows: nested sections, team mates, merged searches, marginals, compositions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The order of categories and, within one, of divisions by a word of their names.
CATEGORY_ORDER = ("freestyle", "net", "golf", "sideline")
DIVISION_ORDER = ("open", "intermediate", "novice", "women", "masters", "mixed")
ROTATIONAL = ("mirage", "whirl", "torque", "swirl", "drifter")


def place_in(words: tuple[str, ...], hit) -> Column:
    out = F.lit(len(words))
    for i in range(len(words) - 1, -1, -1):
        out = F.when(hit(words[i]), i).otherwise(out)
    return out


def division_order(category: Column, name: Column) -> list[Column]:
    """Order by category, then by division, then by name."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return [place_in(CATEGORY_ORDER, lambda w: F.coalesce(category == w, F.lit(False))), place_in(DIVISION_ORDER, low.contains), low]


def sections(rows: DataFrame) -> DataFrame:
    """(event, nth, discipline, placements): an event's disciplines in order, each with its placements in the order they came in and their
    participants by number. rows(ord, event, discipline, category, entry, placement, score, name, participant_order)."""
    people = rows.groupBy("event", "discipline", "category", "entry").agg(F.min("ord").alias("ord"), F.min("placement").alias("placement"), F.min("score").alias("score"), F.array_sort(F.collect_list(F.struct(F.col("participant_order").alias("o"), F.col("name").alias("n")))).alias("p"))
    people = people.withColumn("p", F.transform("p", lambda x: x["n"]))
    s = people.groupBy("event", "discipline", "category").agg(F.array_sort(F.collect_list(F.struct("ord", "placement", "score", F.col("p").alias("participants")))).alias("a"))
    w = Window.partitionBy("event").orderBy(*division_order(F.col("category"), F.col("discipline")))
    return s.select("event", F.row_number().over(w).alias("nth"), "discipline", F.transform("a", lambda x: F.struct(x["placement"].alias("placement"), x["score"].alias("score"), x["participants"].alias("participants"))).alias("placements"))


def teammates(rows: DataFrame, me: str) -> DataFrame:
    """(event, discipline, placement, prefix, mates): one person's results with the others of the entry, each name once, in order; what
    comes before the names says whether it is a tie of singles, one partner or several. rows(ord, event, discipline, team_type, placement,
    person_id, name)."""
    other = ~F.coalesce(F.col("person_id") == me, F.lit(False))
    first = rows.where(other).groupBy("event", "discipline", "placement", "name").agg(F.min("ord").alias("ord"))
    mates = first.groupBy("event", "discipline", "placement").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("mates"))
    r = rows.groupBy("event", "discipline", "placement").agg(F.min_by("team_type", "ord").alias("team_type"))
    keys = ["event", "discipline", "placement"]
    j = r.join(mates.select(*[F.col(k).alias(f"_{k}") for k in keys], "mates"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    n = F.size(F.coalesce("mates", F.array().cast("array<string>")))
    prefix = F.when(n == 0, "").when(F.col("team_type") == "singles", "Tied with: ").when(n > 1, "With partners: ").otherwise("With partner: ")
    return j.select(*keys, prefix.alias("prefix"), F.array_join(F.coalesce("mates", F.array().cast("array<string>")), ", ").alias("mates"))


def search(members: DataFrame, persons: DataFrame, query: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(rows, facts): up to `limit` members whose name contains the query, then persons who are not linked to one that came before; and
    whether it was too short, and whether there are more. members(slug, name), persons(person_id, name, slug)."""
    q = query.strip().lower()
    hit = lambda df: df.where(F.lit(len(q) >= 2) & F.contains(F.lower("name"), F.lit(q)))
    m = hit(members).orderBy(F.lower("name"), "slug").limit(limit + 1).select(F.lit(0).alias("part"), "name", "slug", F.lit(None).cast("string").alias("person_id"))
    p = hit(persons).orderBy(F.lower("name"), "person_id").limit(limit + 1).select(F.lit(1).alias("part"), "name", "slug", "person_id")
    both = m.unionByName(p).withColumn("_k", F.coalesce("slug", F.concat(F.lit("/"), F.col("person_id"))))
    # Two pages at most: what the windows rank is bounded by the limit.
    w = Window.partitionBy("_k").orderBy("part", F.lower("name"), "person_id")
    both = both.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    order = [F.col("part"), F.lower("name"), F.col("slug"), F.col("person_id")]
    href = F.when(F.col("slug").isNotNull(), F.concat(F.lit("/members/"), "slug")).otherwise(F.concat(F.lit("/history/"), "person_id"))
    rows = both.orderBy(*order).limit(limit).select("name", href.alias("href"))
    facts = both.agg((F.count("*") > limit).alias("has_more")).withColumn("too_short", F.lit(0 < len(q) < 2))
    return rows, facts


def marginals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(key, value, n) of each of the keys, from one count of their combinations."""
    summary = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    pairs = summary.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x"))
    return pairs.groupBy("x.key", "x.value").agg(F.sum("n").alias("n"))


def families(rows: DataFrame, family: str, member: str, order: dict[str, int] | None = None) -> DataFrame:
    """(family, members): families of more than one, in the given order or by name."""
    f = rows.where(F.col(family).isNotNull()).groupBy(family).agg(F.array_sort(F.collect_set(member)).alias("m")).where("size(m) > 1")
    rank = [F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in order.items() for x in p]), F.col(family)), F.lit(len(order)))] if order else []
    return f.orderBy(*rank, family).select(family, F.array_join("m", "|").alias("members"))


def subtract_tokens(text: Column, base: Column) -> Column:
    """The words of a text without those of the base, each taken away as often as the base has it, first ones first. White space of all
    kinds parts words; those with a hyphen are one word."""
    words = lambda c: F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda x: x != "")
    def without(acc: Column, w: Column) -> Column:
        at = F.array_position(acc, w)
        return F.when(at > 0, F.concat(F.slice(acc, F.lit(1), (at - 1).cast("int")), F.slice(acc, (at + 1).cast("int"), F.size(acc)))).otherwise(acc)
    return F.aggregate(words(base), words(text), without)


def compositions(tricks: DataFrame, modifiers: DataFrame) -> DataFrame:
    """(name, bonus, composition) of tricks(name, adds, base): what a trick's modifiers add to its base, more on rotational bases.
    modifiers(slug, modifier, add_bonus, add_bonus_rotational). Tricks without base, base value or known modifier have none."""
    t = tricks.where("base is not null and base <> name")
    base = tricks.select(F.col("name").alias("base"), F.try_to_number(F.col("adds"), F.lit("99")).cast("int").alias("base_adds"))
    t = t.join(base, "base").where("base_adds is not null").withColumn("rotational", F.col("base").isin(*ROTATIONAL))
    parts = t.select("name", "base", "base_adds", "adds", "rotational", F.posexplode(subtract_tokens(F.col("name"), F.col("base"))).alias("pos", "slug")).join(modifiers, "slug")
    bonus = F.when(F.col("rotational"), F.col("add_bonus_rotational")).otherwise(F.col("add_bonus"))
    say = F.concat(F.col("modifier"), F.lit(" (+"), bonus.cast("string"), F.when(F.col("rotational"), " on rotational base").otherwise(""), F.lit(")"))
    g = parts.withColumn("say", say).withColumn("b", bonus).groupBy("name", "base", "base_adds", "adds").agg(F.sum("b").alias("bonus"), F.array_sort(F.collect_list(F.struct("pos", "say"))).alias("p"))
    total = F.coalesce(F.try_to_number(F.col("adds"), F.lit("99")).cast("int"), (F.col("base_adds") + F.col("bonus")).cast("int"))
    return g.select("name", F.col("bonus").cast("long").alias("bonus"), F.concat(F.col("base"), F.lit(" ("), F.col("base_adds").cast("string"), F.lit(") + "), F.array_join(F.transform("p", lambda x: x["say"]), " + "), F.lit(" = "), total.cast("string")).alias("composition"))
