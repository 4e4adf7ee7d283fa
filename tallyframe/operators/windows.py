"""Rankings, runs, gaps and chains."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def tie_rank(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """`place`: competition rank by falling value, written T-n where it is shared (1, T-2, T-2, 4)."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    rank = F.rank().over(part.orderBy(F.desc(value)))
    shared = F.count("*").over(Window.partitionBy(*keys, value)) > 1
    return df.withColumn("place", F.concat(F.when(shared, F.lit("T-")).otherwise(F.lit("")), rank.cast("string")))


def best_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Adds `nth` by order within the key: 1 is kept, the others are displaced."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def superseded_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """`next_value`: the next higher value of the key, null for its current (highest) rows; equal rows share it."""
    steps = df.select(key, value).where(F.col(value).isNotNull()).distinct()
    steps = steps.withColumn("next_value", F.lead(value).over(Window.partitionBy(key).orderBy(value)))
    return df.join(steps, [key, value], "left")


def progression(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """As superseded_by over several keys, of which nulls are equal: `next_value` is null for the highest rows, which share it."""
    steps = df.select(*keys, value).where(F.col(value).isNotNull()).distinct()
    steps = steps.withColumn("next_value", F.lead(value).over(Window.partitionBy(*keys).orderBy(value))).select(*[F.col(c).alias(f"_{c}") for c in (*keys, value)], "next_value")
    return df.join(steps, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, value)], "left").select(*df.columns, "next_value")


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """`run`: the number, from 1, of the unbroken run of equal values that the row is in."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gaps(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each group: its rows, distinct values, whether they are 1..n without gaps, whether any is shared."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.countDistinct(value).alias("n_distinct"), F.max(value).alias("highest")).withColumns({"gapless": F.col("highest") == F.col("n_distinct"), "tied": F.col("n") > F.col("n_distinct")})


def pair_up(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Consecutive rows in pairs: slot and order in the slot, both from 1."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("slot", (F.floor(n / 2) + 1).cast("int")).withColumn("slot_order", (n % 2 + 1).cast("int"))


def neighbours(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with the one before and the one after; meant for few values, such as years."""
    w = Window.partitionBy(F.lit(0)).orderBy(column)
    d = df.select(column).distinct()
    return d.withColumns({"previous": F.lag(column).over(w), "next": F.lead(column).over(w)})


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def placed(df: DataFrame, keys: list[str], deal: Column, order: list[Column | str], out: str) -> DataFrame:
    """Adds each row's number in order within the keys, from 1. `deal` must not fall along the order, and parts the rows of a key: they are
    numbered within each part, and parts are counted before they are summed, so no task holds a key's rows. Nulls in the keys are a key."""
    df = df.withColumn("_deal", deal)
    by = [*keys, "_deal"]
    sums = df.groupBy(*by).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_deal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], before.alias("_before"))
    inner = df.withColumn("_in", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]
    return inner.join(sums, same).withColumn(out, F.col("_before") + F.col("_in")).select(*[c for c in df.columns if c != "_deal"], out)


def first_hit_windows(df: DataFrame, key: str, at: str, width: float, most: int, retry: bool = False) -> DataFrame:
    """Fixed-window rate limit: a window opens at a key's first hit and the first hit `width` or more later opens the next; in a window
    the first `most` hits are allowed. `at` is in seconds. Gives key, id, at, allowed and, if asked for, retry_after: the whole seconds, one at
    least, until a refused hit's window ends. Rows without key or time give none.

    Keys are dealt to partitions and sorted by time there; one pass carries a key's window from row to row, whatever its number of hits."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, n = None, 0.0, 0
        for f in frames:
            allowed, after = [], []
            for k, t in zip(f["key"].tolist(), f["at"].tolist(), strict=True):
                if k != now or t - start >= width:
                    now, start, n = k, t, 0
                n += 1
                allowed.append(n <= most)
                after.append(None if n <= most else max(1, math.ceil(round(start + width - t, 6))))
            yield f.assign(allowed=allowed, retry_after=pd.array(after, "Int32")) if retry else f.assign(allowed=allowed)

    kind = df.schema[key].dataType.simpleString()
    hits = df.select(F.col(key).alias("key"), F.col("id").cast("bigint").alias("id"), F.col(at).cast("double").alias("at")).where("key is not null and at is not null")
    hits = hits.repartition("key").sortWithinPartitions("key", "at", "id")
    return hits.mapInPandas(fold, f"key {kind}, id bigint, at double, allowed boolean{', retry_after int' if retry else ''}").withColumnRenamed("key", key)
