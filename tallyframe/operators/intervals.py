"""Interval joins by bins, and what is known as of a year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], at: str, low: str, high: str, bin_width: int) -> DataFrame:
    """Points whose `at` is from `low` to `high` of a span of the same keys: an equi-join on (keys, bin). A point is in one bin, a span in
    those that it touches; bins about as wide as spans make that two. Integer columns; names must not clash but for the keys."""
    b = lambda c: F.floor(F.col(c) / bin_width)
    left = points.withColumn("_bin", b(at))
    right = spans.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(F.sequence(b(low), b(high))))
    return left.join(right, [*keys, "_bin"]).where(F.col(at).between(F.col(low), F.col(high))).drop("_bin")


def partners_as_of(asks: DataFrame, appearances: DataFrame, reach: int = 5, top: int = 5) -> DataFrame:
    """(ask, partner, n, last_year, confidence, nth): for asks(ask, person, year) the partners of the last `reach` years and that year.

    appearances(person, partner, year) is counted by year before the join. HIGH: five or more appearances; MEDIUM: three or more; of the first `top`
    partners by count (ties: the later, then the smaller id) those with less are left out."""
    known = appearances.groupBy("person", "partner", "year").agg(F.count("*").alias("k"))
    spans = asks.select("ask", "person", (F.col("year") - reach).alias("low"), F.col("year").alias("high"))
    met = interval_join(known, spans, ["person"], "year", "low", "high", reach + 1)
    n = met.groupBy("ask", "partner").agg(F.sum("k").alias("n"), F.max("year").alias("last_year"))
    ranked = n.withColumn("nth", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("n"), F.desc("last_year"), "partner"))).where(F.col("nth") <= top)
    confidence = F.when(F.col("n") >= 5, "HIGH").when(F.col("n") >= 3, "MEDIUM")
    return ranked.withColumn("confidence", confidence).where("confidence is not null").select("ask", "partner", "n", "last_year", "confidence", "nth")
