"""Joins of a star schema, generic over names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, first in `order`. Ties beyond it are arbitrary: end it with a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """For each left row the `values` of the right row of its key with the latest right_time at or before left_time.

    One shuffle of the union and a window that carries the last right row forward; no range join, so its cost does not grow with the
    number of versions of a key. Rows of `right` with equal times: the greatest values win. Names must not clash but for the key."""
    carried = F.struct(*values)
    both = left.withColumn("_t", F.col(left_time)).withColumn("_v", F.lit(None).cast(right.select(carried.alias("c")).schema["c"].dataType)).withColumn("_left", F.lit(1))
    empty = [F.lit(None).cast(left.schema[c].dataType).alias(c) if c != key else F.col(key) for c in left.columns]
    versions = right.select(*empty, F.col(right_time).alias("_t"), carried.alias("_v"), F.lit(0).alias("_left"))
    w = Window.partitionBy(key).orderBy("_t", "_left", "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = both.unionByName(versions).withColumn("_last", F.last("_v", ignorenulls=True).over(w)).where("_left = 1")
    return out.select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


#: Members of a group that one task pairs with as many others.
BLOCK = 1000


def co_members(df: DataFrame, group: str, member: str, block: int = BLOCK) -> DataFrame:
    """Ordered pairs (member, other) of different members of one group, with the number of groups that hold both.

    A heavy-light join: a group of up to `block` members is paired as it is; a larger one is dealt into blocks of about that many, and
    each pair of its blocks is a key of its own. So no task has more than block x block pairs of one group at once, and a group with a third
    of the rows runs in as many tasks as it has pairs of blocks."""
    one = df.select(group, member).where(F.col(group).isNotNull() & F.col(member).isNotNull()).distinct()
    large = one.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > block).select(group, F.ceil(F.col("_n") / block).cast("int").alias("_blocks"))
    dealt = one.join(large, group, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn("_at", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = dealt.select(group, member, F.col("_at").alias("_i"), every.alias("_j"))
    right = dealt.select(group, F.col(member).alias("other"), F.col("_at").alias("_j"), every.alias("_i"))
    return left.join(right, [group, "_i", "_j"]).where(F.col(member) != F.col("other")).groupBy(member, "other").agg(F.count("*").alias("shared"))


def slot_pairs(df: DataFrame, group: str, position: str, member: str, first: int = 1, second: int = 2) -> DataFrame:
    """One row for each group that fills both positions: by conditional aggregation, without a self-join."""
    at = lambda p: F.max(F.when(F.col(position) == p, F.col(member)))
    return df.where(F.col(position).isin(first, second)).groupBy(group).agg(at(first).alias("a"), at(second).alias("b")).where("a is not null and b is not null")


def unordered(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The pair in canonical order."""
    return df.withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def either_column(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(name, other): the pairs looked up from either side."""
    return pairs.select(F.col(left).alias("name"), F.col(right).alias("other")).union(pairs.select(F.col(right).alias("name"), F.col(left).alias("other"))).distinct()


def any_key(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """(left id, right id) of rows that agree in at least one of the key pairs: an equi-join for each, united."""
    out = None
    for a, b in keys:
        one = left.select(left_id, F.col(a).cast("string").alias("_k")).join(right.select(right_id, F.col(b).cast("string").alias("_k")), "_k").select(left_id, right_id)
        out = one if out is None else out.union(one)
    return out.distinct()


def upsert(old: DataFrame, new: DataFrame, key: str, fill_only: bool = False) -> DataFrame:
    """Rows of both by key: the new value wins where it is not null, or with fill_only only where the old one is null."""
    names = [c for c in old.columns if c != key]
    o, n = old.select(key, F.struct(*names).alias("_o")), new.select(key, F.struct(*names).alias("_n"))
    pick = (lambda c: F.coalesce(f"_o.{c}", f"_n.{c}")) if fill_only else (lambda c: F.coalesce(f"_n.{c}", f"_o.{c}"))
    return o.join(n, key, "full_outer").select(key, *[pick(c).alias(c) for c in names])


def insert_ignore(old: DataFrame, new: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Keeps what is there; of new rows with one key the first in order (of all columns, if none is given), if the key is not there."""
    w = Window.partitionBy(key).orderBy(*(order or new.columns))
    first = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return old.unionByName(first.join(old.select(key), key, "left_anti").select(*old.columns))


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number`, from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
