"""Distinct counts at several grains at once, by bitmaps that are merged and never recounted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_by_grain(df: DataFrame, value: str, finest: list[str], grains: dict[str, list[str]], out: str = "n") -> DataFrame:
    """(grain, *finest, `out`): the distinct integers `value` at each grain, a name for some of the columns `finest`; the others are null.

    Rows become bitmaps of 32,768 values by (finest, bucket of the value) before the shuffle; each coarser grain is the bitwise or of these,
    so df is read once, and its rows are neither expanded nor shuffled. Columns of a coarser grain (an era beside its year) are to be in
    `finest`. For values that are dense (numbered keys) this is smaller than the distinct rows; sparse ones should be numbered first."""
    rows = df.where(F.col(value).isNotNull())
    bits = rows.groupBy(*finest, F.bitmap_bucket_number(F.col(value)).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(value))).alias("_bits"))
    parts = None
    for name, columns in grains.items():
        merged = bits.groupBy(*columns, "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits")).withColumn("_n", F.bitmap_count("_bits"))
        one = merged.groupBy(*columns).agg(F.sum("_n").alias(out)) if columns else merged.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias(out))
        one = one.select(F.lit(name).alias("grain"), *[F.col(c) if c in columns else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in finest], out)
        parts = one if parts is None else parts.union(one)
    return parts
