"""What a table is after rows are inserted, changed or deleted: each takes the table and returns the new one. And pages of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def patch(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Changes the given columns of the rows where the condition holds (where it is null, nothing changes)."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def compare_and_set(df: DataFrame, key: str, claims: DataFrame, expected: Column, **values: Column) -> DataFrame:
    """Changes rows whose key is claimed and for which `expected` holds; adds `changed`, so that a caller sees which claims took effect."""
    hit = df.join(claims.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return patch(hit.withColumn("changed", F.coalesce(F.col("_hit") & expected, F.lit(False))), F.col("changed"), **values).drop("_hit")


def delete(df: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return df.join(gone.select(key).distinct(), key, "left_anti")


def insert_first(old: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Keeps what is there; of new rows with one key the first in order, if the key is not there yet."""
    w = Window.partitionBy(key).orderBy(*order)
    first = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(key).distinct(), key, "left_anti").select(*old.columns))


def fill_empty(old: DataFrame, new: DataFrame, key: str, texts: list[str], flags: list[str]) -> DataFrame:
    """Texts that are null or empty take the new value; flags rise to the higher of both and are null if either is, as in SQLite."""
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in (*texts, *flags)], F.lit(True).alias("_there"))
    out = old.join(n, key, "left")
    for c in texts:
        out = out.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), f"_{c}", c))
    for c in flags:
        highest = F.when(F.col(c).isNotNull() & F.col(f"_{c}").isNotNull(), F.greatest(c, f"_{c}"))
        out = out.withColumn(c, F.when(F.col("_there"), highest).otherwise(F.col(c)))
    return out.select(*old.columns)


def browse(df: DataFrame, order: list[Column], filters: list[Column | None] = (), limit: int = 50, offset: int = 0, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(rows, facts): the rows that meet the filters that are given, in order, `limit` of them but `most` at most; and their `total`, and
    whether there are more behind these."""
    for f in filters:
        df = df if f is None else df.where(f)
    limit = max(0, min(limit, most))
    facts = df.agg(F.count("*").alias("total")).withColumn("has_more", F.col("total") > offset + limit)
    return df.orderBy(*order).offset(offset).limit(limit), facts


def keep_first(frames: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """The frames one after the other, without later rows of equal keys; within a frame, in order."""
    both = frames[0].withColumn("_frame", F.lit(0))
    for i, f in enumerate(frames[1:], 1):
        both = both.unionByName(f.withColumn("_frame", F.lit(i)))
    w = Window.partitionBy(*keys).orderBy("_frame", *order)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_frame")


def cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """Drops children whose parent is gone: for each (child, parent, key), in order. Null keys have no parent and stay."""
    out = dict(tables)
    for child, parent, key in links:
        c = out[child]
        out[child] = c.where(F.col(key).isNull()).unionByName(c.join(out[parent].select(key).distinct(), key, "left_semi").select(*c.columns))
    return out


def blank_last(col: Column) -> list[Column]:
    """Order by a text with nulls and empty ones at the end."""
    return [F.when(F.coalesce(col, F.lit("")) == "", 1).otherwise(0), col]


def nocase(col: Column) -> Column:
    """Order and equality without regard to the case of A-Z alone."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
