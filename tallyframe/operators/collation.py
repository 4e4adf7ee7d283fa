"""Order, equality and joins without regard to case or marks, by collations as column types: values keep their spelling, comparisons do not
see it. Sorts, groups, joins and windows over such a column need no second key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: nocase: letters without their case. base: letters without case and marks, in the order of the root locale.
HOW = {"nocase": "UTF8_LCASE", "base": "UNICODE_CI_AI", "locale": "UNICODE"}


def collated(column: str | Column, how: str = "nocase") -> Column:
    return F.collate(F.col(column) if isinstance(column, str) else column, HOW[how])


def plain(column: str | Column) -> Column:
    """Back to the comparison of bytes."""
    return F.collate(F.col(column) if isinstance(column, str) else column, "UTF8_BINARY")


def groups(df: DataFrame, column: str, how: str = "nocase", *aggregates: Column) -> DataFrame:
    """One row for each value up to case (and marks): `column` as its spelling that is first in byte order, `spellings` and n."""
    return df.groupBy(collated(column, how).alias("_c")).agg(F.min(plain(column)).alias(column), F.countDistinct(plain(column)).alias("spellings"), F.count("*").alias("n"), *aggregates).where("_c is not null").drop("_c")


def join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "nocase", kind: str = "inner") -> DataFrame:
    """An equi-join up to case (and marks); a shuffle by the collated value, as with any key."""
    a, b = left.withColumn("_l", collated(left_on, how)), right.withColumn("_r", collated(right_on, how))
    return a.join(b, F.col("_l") == F.col("_r"), kind).drop("_l", "_r")


def ordered(df: DataFrame, column: str, how: str = "nocase", *ties: Column | str) -> DataFrame:
    return df.orderBy(collated(column, how), *ties)
