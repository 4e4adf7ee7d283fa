"""Careers of persons and coverage of events, by the surveyed rules and without expanding rows for distinct counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def careers(rows: DataFrame, person: str, event: str, kind: Column, place: str, year: Column, first: Column | None = None) -> DataFrame:
    """(person, wins, podiums, events, kinds, first_year, span) of placements.

    `first` says whether a row is its entry's first participant; wins and podiums count these rows only, events and kinds all. Rows are
    pre-aggregated by (person, event), so an event is one row in the second count; kinds, of which there are few, are counted from their
    distinct pairs with persons. Neither count expands the rows."""
    one = F.lit(True) if first is None else first
    r = rows.select(F.col(person).alias("person"), F.col(event).alias("event"), kind.alias("kind"), F.col(place).alias("place"), year.alias("year"), one.alias("one"))
    per = r.groupBy("person", "event").agg(F.count_if(F.col("one") & (F.col("place") == 1)).alias("w"), F.count_if(F.col("one") & (F.col("place") <= 3)).alias("p"), F.min("year").alias("lo"), F.max("year").alias("hi"))
    base = per.groupBy("person").agg(F.sum("w").alias("wins"), F.sum("p").alias("podiums"), F.count("event").alias("events"), F.min("lo").alias("first_year"), (F.max("hi") - F.min("lo") + 1).cast("long").alias("span"))
    kinds = r.where("kind is not null").select(F.col("person").alias("_p"), "kind").distinct().groupBy("_p").agg(F.count("*").alias("kinds"))
    out = base.join(kinds, F.col("person").eqNullSafe(F.col("_p")), "left")
    return out.select(F.col("person").alias(person), "wins", "podiums", "events", F.coalesce("kinds", F.lit(0).cast("long")).alias("kinds"), "first_year", "span")


def coverage(events: DataFrame, results: DataFrame, quarantine: DataFrame) -> DataFrame:
    """(event, placements, disciplines, coverage) of events(event, status) by results(event, discipline) and quarantine(event).

    QUARANTINED goes before all; NO RESULTS has the status no_results or no placement; FULL 20 placements and three disciplines; PARTIAL
    ten placements or two disciplines; the rest is SPARSE. Results are counted by (event, discipline) before events are."""
    n = results.groupBy("event", "discipline").agg(F.count("*").alias("k")).groupBy("event").agg(F.sum("k").alias("placements"), F.count("discipline").alias("disciplines"))
    e = events.join(n, "event", "left").join(quarantine.select("event").distinct().withColumn("_q", F.lit(True)), "event", "left").na.fill(0, ["placements", "disciplines"])
    p, d = F.col("placements"), F.col("disciplines")
    level = F.when(F.col("_q"), "QUARANTINED").when((F.coalesce("status", F.lit("")) == "no_results") | (p == 0), "NO RESULTS").when((p >= 20) & (d >= 3), "FULL").when((p >= 10) | (d >= 2), "PARTIAL").otherwise("SPARSE")
    return e.select("event", "placements", "disciplines", level.alias("coverage"))
