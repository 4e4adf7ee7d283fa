"""Tricks in free text: found longest first, named by lookups, scored."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEMBER_VIEWS = {
    # What the named views of members, clubs and evidence ask for.
    "members_searchable": "deleted_at IS NULL AND is_deceased = 0 AND searchable = 1 AND personal_data_purged_at IS NULL AND email_verified_at IS NOT NULL",
    "members_active": "deleted_at IS NULL AND is_deceased = 0",
    "clubs_open": "status IN ('active', 'inactive')",
    "canonical_evidence": "evidence_class = 'canonical_only'",
    "templates_enabled": "is_enabled = 1",
}


def view(df: DataFrame, name: str) -> DataFrame:
    """The rows of a named view; where a condition is null, a row is not in it."""
    return df.where(MEMBER_VIEWS[name])


def mapped(col: Column, names: dict[str, str], otherwise: str | None = None) -> Column:
    """The value that a text stands for."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), col), F.lit(otherwise))


def tricks_in(line: Column, lexicon: list[str]) -> Column:
    """The tricks that a line names, in order. One alternation, longest first: where a longer name is, no shorter one inside it is found.

    Names are whole words, in any letter case; spaces and hyphens in them stand for each other."""
    names = sorted({n.strip().lower() for n in lexicon if n.strip()}, key=lambda n: (-len(n), n))
    pattern = "|".join(re.sub(r"(?:\\ |\\-|-|\s)+", r"[\\s-]+", re.escape(n)) for n in names)
    return F.transform(F.regexp_extract_all(line, F.lit(rf"(?i)(?<![\w-])({pattern})(?![\w-])"), F.lit(1)), lambda t: F.regexp_replace(F.lower(t), r"[\s-]+", " "))


def line_class(line: Column, lexicon: list[str]) -> Column:
    """skip, header, sequence (several tricks in a row), result_trick, result_score, result_plain or text."""
    placed, n = line.rlike(r"^\s*\d{1,3}\s*[.)\-:]\s*\S"), F.size(tricks_in(line, lexicon))
    return F.when(F.length(F.trim(line)) < 3, "skip").when(line.rlike(r"^[^a-z]{3,40}:?$|:\s*$") & ~placed, "header").when(line.contains(">") & (n > 1), "sequence").when(placed & (n > 0), "result_trick").when(placed & line.rlike(r"\d+(\.\d+)?\s*$"), "result_score").when(placed, "result_plain").otherwise("text")


def mine(texts: DataFrame, lexicon: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """(id, line_no, nth, trick, class) from texts(id, text): aliases count as what they stand for."""
    lines = texts.select("id", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line"))
    found = lines.select("id", "line_no", line_class(F.col("line"), lexicon).alias("class"), F.posexplode(tricks_in(F.col("line"), lexicon)).alias("nth", "trick"))
    named = F.coalesce(mapped(F.col("trick"), aliases), F.col("trick")) if aliases else F.col("trick")
    return found.where("class <> 'skip' and class <> 'header'").select("id", "line_no", "nth", named.alias("trick"), "class")


def overlay(rows: DataFrame, tricks: DataFrame) -> DataFrame:
    """(id, slug, how) of rows(id, name, alt): the trick of the same name, else of the slug made of it, else of the other name.
    tricks(slug, name)."""
    slug = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    by_name = tricks.groupBy(F.lower("name").alias("_n")).agg(F.min("slug").alias("s"))
    r = rows.select("id", F.lower("name").alias("_name"), slug("name").alias("_slug"), F.lower("alt").alias("_alt"))
    r = r.join(by_name.select(F.col("_n").alias("_name"), F.col("s").alias("by_name")), "_name", "left").join(tricks.select(F.col("slug").alias("_slug"), F.col("slug").alias("by_slug")).distinct(), "_slug", "left").join(by_name.select(F.col("_n").alias("_alt"), F.col("s").alias("by_alt")), "_alt", "left")
    how = F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_slug").isNotNull(), "slug").when(F.col("by_alt").isNotNull(), "alt").otherwise("none")
    return r.select("id", F.coalesce("by_name", "by_slug", "by_alt").alias("slug"), how.alias("how"))


def cohorts(persons: DataFrame, others: DataFrame, variants: DataFrame) -> DataFrame:
    """(era, honoured, overlap, n): persons(person_id, name, last_year, honoured) by era, honours, and whether the other side's names
    (other_id, name) have theirs: once, several times, by a variant (a, b, either way), or not."""
    n = others.where("coalesce(name, '') <> ''").groupBy("name").agg(F.countDistinct("other_id").alias("_exact"))
    both = variants.select("a", "b").union(variants.select("b", "a")).distinct()
    loose = both.join(n.select(F.col("name").alias("b")), "b").select(F.col("a").alias("name")).distinct().withColumn("_loose", F.lit(True))
    era = F.when(F.col("last_year").isNull(), "unknown").when(F.col("last_year") < 1990, "before_1990").when(F.col("last_year") < 2000, "1990s").when(F.col("last_year") < 2010, "2000s").otherwise("2010_on")
    overlap = F.when(F.col("_exact") == 1, "unique_name_matches_other").when(F.col("_exact") > 1, "ambiguous_multiple_matches").when(F.col("_loose"), "variant_assisted_match").otherwise("no_name_match")
    return persons.join(n, "name", "left").join(loose, "name", "left").groupBy(era.alias("era"), F.coalesce("honoured", F.lit(False)).alias("honoured"), overlap.alias("overlap")).agg(F.count("*").alias("n"))
