"""Validation: every check is a DataFrame of findings, and never an exception inside a job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finding(df: DataFrame, severity: str, check: str, table: str) -> DataFrame:
    """(severity, check_id, table_name, issues): how many rows of `df` there are."""
    return df.agg(F.count("*").alias("issues")).select(F.lit(severity).alias("severity"), F.lit(check).alias("check_id"), F.lit(table).alias("table_name"), "issues")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose non-null key the parent lacks."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def gate(findings: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def row_issues(df: DataFrame, key: str, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """(key, check_id, severity): a row for each rule that a row breaks."""
    found = F.array(*[F.when(broken, F.struct(F.lit(name).alias("check_id"), F.lit(severity).alias("severity"))) for name, (severity, broken) in rules.items()])
    return df.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select(key, "i.check_id", "i.severity")


def one_to_many(df: DataFrame, one: str, many: str) -> DataFrame:
    """Values of `one` that go with several values of `many`."""
    return df.groupBy(one).agg(F.countDistinct(many).alias("n")).where("n > 1")


def baseline_delta(current: DataFrame, baseline: DataFrame, key: str, count: str) -> DataFrame:
    """Both counts and their difference; what only one side has counts as 0 on the other."""
    c, b = current.select(key, F.col(count).alias("now")), baseline.select(key, F.col(count).alias("before"))
    return c.join(b, key, "full_outer").select(key, *[F.coalesce(x, F.lit(0)).alias(x) for x in ("now", "before")]).withColumn("delta", F.col("now") - F.col("before"))


def illegal_transitions(df: DataFrame, key: str, order: list[str], state: str, allowed: set[tuple[str, str]]) -> DataFrame:
    """(key, state before, state) of each step that is not allowed."""
    w = Window.partitionBy(key).orderBy(*order)
    steps = df.withColumn("before", F.lag(state).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(state)))
    pairs = [F.concat_ws(">", F.lit(a), F.lit(b)) for a, b in sorted(allowed)]
    return steps.where(~F.concat_ws(">", "before", state).isin(*pairs)).select(key, "before", F.col(state).alias("after"))


def floors(counts: dict[str, DataFrame], least: dict[str, int]) -> DataFrame:
    """(table_name, rows, least, ok)."""
    out = [counts[t].agg(F.count("*").alias("rows")).select(F.lit(t).alias("table_name"), "rows", F.lit(n).alias("least")) for t, n in least.items()]
    return gate(out).withColumn("ok", F.col("rows") >= F.col("least"))
