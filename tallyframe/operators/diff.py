"""Two versions of a table, compared by checksums of key ranges: rows are read again only where ranges differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that a scan's filter names one by one; beyond that many it names the first and the last.
NAMED = 64


def checksums(df: DataFrame, key: str, width: int) -> DataFrame:
    """(range, n, sum, mix): order-free checksums of the rows of each key range of `width` keys; null keys are a range of their own."""
    h = F.xxhash64(*[F.col(c) for c in df.columns], *[F.col(c).isNull() for c in df.columns])
    return df.groupBy(F.floor(F.col(key) / width).alias("range")).agg(F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("mix"))


def differing_ranges(old: DataFrame, new: DataFrame, key: str, width: int) -> DataFrame:
    """The ranges whose rows differ. Each table is scanned once and shuffles one row a range."""
    a, b = checksums(old, key, width), checksums(new, key, width)
    both = a.join(b, a["range"].eqNullSafe(b["range"]), "full_outer")
    same = a["n"].eqNullSafe(b["n"]) & a["sum"].eqNullSafe(b["sum"]) & a["mix"].eqNullSafe(b["mix"])
    return both.where(~same).select(F.coalesce(a["range"], b["range"]).alias("range"))


def within(df: DataFrame, key: str, ranges: DataFrame, width: int) -> DataFrame:
    """The rows of df in these ranges. A few ranges become filters of the scan; many become its bounds and a semi-join."""
    some = [r.range for r in ranges.limit(NAMED + 1).collect()]
    if len(some) <= NAMED:
        keep = F.lit(False)
        for r in some:
            keep = keep | (F.col(key).isNull() if r is None else (F.col(key) >= r * width) & (F.col(key) < (r + 1) * width))
        return df.where(keep)
    low, high, nulls = ranges.agg(F.min("range"), F.max("range"), F.count_if(F.col("range").isNull())).first()
    inside = (F.col(key) >= low * width) & (F.col(key) < (high + 1) * width)
    held = df.where(inside | F.col(key).isNull() if nulls else inside).withColumn("_range", F.floor(F.col(key) / width))
    return held.join(ranges.withColumnRenamed("range", "_r"), F.col("_range").eqNullSafe(F.col("_r")), "left_semi").drop("_range")


def table_diff(old: DataFrame, new: DataFrame, key: str, width: int = 10_000) -> DataFrame:
    """(key, status, columns): rows added, removed or changed from old to new, with the names of the columns that changed.

    `key` is an integer that tells rows apart. Rows with a null key, and keys that are repeated, are compared as sets: status added or removed.
    Both tables have the same columns."""
    ranges = differing_ranges(old, new, key, width).persist()
    names = [c for c in old.columns if c != key]
    a, b = within(old, key, ranges, width), within(new, key, ranges, width)
    once = lambda d: d.groupBy(key).agg(F.count("*").alias("_k")).where("_k > 1").select(key)
    twice = once(a).union(once(b)).union(a.where(F.col(key).isNull()).select(key)).union(b.where(F.col(key).isNull()).select(key)).distinct().withColumnRenamed(key, "_t")
    mark = lambda d: d.join(twice, d[key].eqNullSafe(F.col("_t")), "left_semi")
    plain = lambda d: d.join(twice, d[key].eqNullSafe(F.col("_t")), "left_anti")
    x = plain(a).select(F.col(key), F.struct(*names).alias("_a"), F.lit(True).alias("_old"))
    y = plain(b).select(F.col(key), F.struct(*names).alias("_b"), F.lit(True).alias("_new"))
    both = x.join(y, key, "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in names]), lambda c: c.isNotNull())
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    found = both.select(key, status.alias("status"), F.when(status == "changed", F.array_join(changed, ",")).otherwise("").alias("columns")).where("status <> 'changed' or columns <> ''")
    gone, come = mark(a).exceptAll(mark(b)), mark(b).exceptAll(mark(a))
    return found.union(gone.select(key, F.lit("removed"), F.lit(""))).union(come.select(key, F.lit("added"), F.lit("")))


def parity(counts: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """(name, left_rows, right_rows, equal): whether a workbook's sheets have as many rows as the tables behind them."""
    out = None
    for name, left, right in counts:
        both = left.agg(F.count("*").alias("left_rows")).crossJoin(right.agg(F.count("*").alias("right_rows")))  # one row each
        one = both.select(F.lit(name).alias("name"), "left_rows", "right_rows", (F.col("left_rows") == F.col("right_rows")).alias("equal"))
        out = one if out is None else out.union(one)
    return out


def disagreements(df: DataFrame, key: str, source: str, value: str) -> DataFrame:
    """(key, sources, values, detail): keys to which sources give different values; a source that gives none has no say.

    Values are gathered by (key, source) first, so a key's group is no larger than its sources."""
    said = df.where(F.col(value).isNotNull()).select(key, source, F.col(value).cast("string").alias("_v")).distinct()
    per = said.groupBy(key, source).agg(F.array_join(F.array_sort(F.collect_set("_v")), "/").alias("_said"))
    values = said.groupBy(key).agg(F.countDistinct("_v").alias("values"))
    out = per.groupBy(key).agg(F.count("*").alias("sources"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", source, "_said"))), ";").alias("detail"))
    return out.join(values, key).where("sources > 1 and values > 1").select(key, "sources", "values", "detail")
