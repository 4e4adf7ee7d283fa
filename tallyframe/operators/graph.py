"""Connected components and the closure of merges: chains and cycles of 'this one is that one'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.tables import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for each end of a link the least node that it reaches, in either direction. Links with a null end are none.

    Each round hooks every node to its least neighbour, flattens the trees by pointer jumping and contracts the links to roots, so a
    chain of n links takes about log n rounds and no round looks at more than what is still open. Only counts come to the driver."""
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    live = written(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        up = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("p")), "hooks")
        flat = False
        while not flat:
            further = up.select(F.col("x").alias("p"), F.col("p").alias("q"))
            step = written(up.join(further, "p", "left").select("x", "p", F.coalesce("q", "p").alias("q")), "hooks")
            flat = step.where("p <> q").isEmpty()
            up = step.select("x", F.col("q").alias("p"))
        roots = written(roots.join(up.select(F.col("x").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "roots")
        left, right = up.select(F.col("x").alias("a"), F.col("p").alias("pa")), up.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        live = written(live.join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    return roots


def merge_targets(merges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(node, survivor) for each node of `merges` (source is merged into target): where its chain ends.

    The survivor of a component is its least node that is merged into nothing, or its least node of all if there is none, as in a cycle.
    With one target for each source, that is the end of the chain. A merge into itself or into null is none."""
    real = merges.where(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(source) != F.col(target)))
    roots = components(real, source, target)
    goes = real.select(F.col(source).alias("node"), F.lit(True).alias("goes")).distinct()
    ends = roots.join(goes, "node", "left").groupBy("root").agg(F.min(F.when(F.col("goes").isNull(), F.col("node"))).alias("end"))
    return roots.join(ends, "root").select("node", F.coalesce("end", "root").alias("survivor"))
