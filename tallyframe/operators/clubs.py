"""Clubs: which are shown at once, who may lead them, how they are listed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The years and counts of the rules.
ACTIVE, EDITED, NEW, LARGE, KNOWN = 2020, 2016, 2022, 10, 3


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def classify_clubs(clubs: DataFrame) -> DataFrame:
    """Adds R1..R10 (0 or 1), `category` and `contact_signal_substitute_applied`.

    Columns: last_hosted_year, ever_hosted (0/1), last_updated_year, created_year, contact_member_id, contact_member_last_year,
    max_member_last_year, unique_members, linkable_members, has_description. Where the contact is unknown, any member stands for it."""
    since = lambda c, y: yes(F.col(c) >= y)
    member, hosted, updated = since("max_member_last_year", ACTIVE), yes(F.col("ever_hosted") == 1), since("last_updated_year", ACTIVE)
    no_contact = F.trim(F.coalesce("contact_member_id", F.lit(""))) == ""
    contact = F.when(no_contact, member).otherwise(since("contact_member_last_year", ACTIVE))
    rules = [
        since("last_hosted_year", ACTIVE), updated & hosted, updated & contact, contact & hosted,
        contact, hosted, since("last_updated_year", EDITED) & yes(F.col("last_updated_year") > F.col("created_year")), member, since("created_year", NEW), yes(F.col("unique_members") >= LARGE) | yes(F.col("linkable_members") >= KNOWN),
    ]
    out = clubs.withColumns({f"R{i}": r.cast("int") for i, r in enumerate(rules, 1)})
    any_ = lambda a, b: reduce(Column.__or__, [F.col(f"R{i}") == 1 for i in range(a, b + 1)])
    category = F.when(any_(1, 4), "pre_populate").when(any_(5, 10), "onboarding_visible").when(yes(F.col("has_description")), "dormant").otherwise("junk")
    return out.withColumns({"category": category, "contact_signal_substitute_applied": (no_contact & any_(3, 5)).cast("int")})


def club_score(clubs: DataFrame) -> DataFrame:
    """Adds `score`: what speaks for a club, 1 at most."""
    part = lambda c, x: F.when(yes(c), x).otherwise(0.0)
    n = F.coalesce("linkable_members", F.lit(0))
    total = part(F.col("has_name") & F.col("has_country"), 0.40) + part(F.col("has_city"), 0.10) + part(F.col("has_contact_email"), 0.15) + part(F.col("has_description"), 0.05) + part(F.col("has_external_url"), 0.05) + part(n >= 1, 0.15) + part(n >= 5, 0.05) + part(n >= 20, 0.05)
    return clubs.withColumn("score", F.round(F.least(F.lit(1.0), total), 4))


def affiliations(rows: DataFrame) -> DataFrame:
    """Adds `score`: half, and a fifth each for a mirror id and for a match, 1 at most."""
    part = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", 0.2).otherwise(0.0)
    return rows.withColumn("score", F.round(F.least(F.lit(1.0), 0.5 + part(F.col("mirror_member_id")) + part(F.col("person_id"))), 4))


def leaders(rows: DataFrame, enough: int = 5) -> DataFrame:
    """(club_key, person_id, role, selection_rank): each club's best candidate, and a second one of the same score if it has enough of
    them. rows(club_key, person_id, person_name, mirror_member_id, score)."""
    has = F.when(F.trim(F.coalesce("mirror_member_id", F.lit(""))) != "", 1).otherwise(0)
    w = Window.partitionBy("club_key").orderBy(F.desc("score"), has.desc(), "person_name", "person_id")
    every = Window.partitionBy("club_key")
    r = rows.withColumns({"selection_rank": F.row_number().over(w), "_n": F.count("*").over(every), "_top": F.max("score").over(every)})
    r = r.where((F.col("selection_rank") == 1) | ((F.col("selection_rank") == 2) & (F.col("_n") >= enough) & (F.col("score") == F.col("_top"))))
    return r.select("club_key", "person_id", F.when(F.col("selection_rank") == 1, "leader").otherwise("co_leader").alias("role"), "selection_rank")


def by_region(clubs: DataFrame) -> DataFrame:
    """(country, region, clubs, total): by region where every club of the country has one and there are two at least; else in one group
    with a null region. Regions are ordered without regard to case and accents."""
    named = F.nullif(F.col("region"), F.lit(""))
    facts = clubs.groupBy("country").agg((F.count("*") == F.count(named)).alias("_all"), F.countDistinct(named).alias("_k"), F.count("*").alias("total"))
    c = clubs.join(facts, "country").withColumn("region", F.when(F.col("_all") & (F.col("_k") > 1), F.col("region")))
    return c.groupBy("country", "region", "total").agg(F.array_join(F.array_sort(F.collect_list("club")), "|").alias("clubs"))
