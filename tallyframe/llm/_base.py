"""What the operators share: written tables, running totals over hashed buckets, connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import string
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: What the operator at work remembers from task to task in this Python worker.
_REMEMBERED: dict[tuple, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of our own, but on one machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN.setdefault("dir", f"file://{tempfile.gettempdir()}/tallyframe-{uuid.uuid4().hex}")
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def app_dir(spark: SparkSession) -> str:
    """One folder for each application, removed when the driver's interpreter ends."""
    path = f"{shared_dir(spark)}/tallyframe/{spark.sparkContext.applicationId}"
    if _OWN.get("app") != path:
        _OWN["app"] = path

        def clean() -> None:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)

        atexit.register(clean)
    return path


class Written:
    """A table in the shared folder: it cuts lineage, outlives executors and reads the same each time."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{app_dir(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """For tables that nothing reads any more."""
        _remove(self.spark, self.path)


class Scope:
    """Within it, written tables are noted; at its end they are dropped, but for those that are to stay."""

    def __init__(self) -> None:
        self.tables: list[Written] = []

    def __enter__(self) -> Scope:
        _SCOPES.append(self)
        return self

    def __exit__(self, *_) -> None:
        _SCOPES.pop()
        for table in self.tables:
            table.drop()

    def stay(self, df: DataFrame) -> DataFrame:
        """`df`, a table written within, for a scope further out."""
        for table in [t for t in self.tables if t.df is df]:
            self.tables.remove(table)
            if len(_SCOPES) > 1:
                _SCOPES[-2].tables.append(table)
        return df


_SCOPES: list[Scope] = []


def written(df: DataFrame, name: str) -> DataFrame:
    table = Written(df, name)
    if _SCOPES:
        _SCOPES[-1].tables.append(table)
    return table.df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that `df` does not have, for helper columns beside all of its own."""
    own, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in own:
            name += "_"
        out.append(name)
    return out


def column(name: str) -> Column:
    """The column of just this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def only(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """The rows of `docs` whose `key`, a string, is in the one column of `kept`; of several with one key, the first by a hash of the row.

    The first row of each key is chosen before the join, so that each task hands on one row of a key at most, however many rows have
    it; texts are shuffled once, since the window and the join go by the same key."""
    k, nth, mark = fresh(docs, "_key", "_nth", "_mark")
    hashed = F.xxhash64(*[F.to_json(F.struct(column(f.name))) if "map<" in f.dataType.simpleString() else column(f.name) for f in docs.schema.fields])
    own = docs.withColumn(k, key).withColumn(mark, hashed)
    first = own.withColumn(nth, F.row_number().over(Window.partitionBy(k).orderBy(mark))).where(F.col(nth) == 1)
    return first.join(kept.select(F.col(kept.columns[0]).alias(k)), k, "left_semi").select(*[column(c) for c in docs.columns])


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def buckets_for(rows: int, per: int = 100_000, least: int = 64) -> int:
    """How many hashed buckets one hot group is dealt into: it grows with the rows, so that no bucket does."""
    return max(least, 1 << max(0, (rows // per - 1).bit_length()) if rows > per else least)


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column | str], value: Column, out: str) -> DataFrame:
    """Adds the sum of `value` over the rows before this one, within `keys`, in order of (`bucket`, *`order`).

    Two levels: totals of each (keys, bucket), pre-aggregated before the shuffle and summed over the few buckets of a key, plus a
    window inside each bucket. A key that holds a third of all rows is spread over its buckets. Keys and bucket must not be null."""
    w_keys = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    sums = sums.select(*keys, bucket, F.coalesce(F.sum("_sum").over(w_keys), F.lit(0)).alias("_before"))
    w = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_inner", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return inner.join(sums, [*keys, bucket]).withColumn(out, (F.col("_before") + F.col("_inner")).cast("long")).drop("_before", "_inner")


def ranked(df: DataFrame, order: list[Column | str], name: str) -> tuple[DataFrame, str]:
    """`df`, written, and a SQL expression of each row's place in `order`, from 0.

    One range-partitioned shuffle; ties are dealt out by Spark's bounds, so `order` should tell rows apart that are not alike. The
    places before each partition are a table of as many rows as there are partitions."""
    (at,) = fresh(df, "_at")
    parts = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), name)
    counts = parts.groupBy(F.shiftright(at, 33).alias("_part")).agg(F.count("*").alias("_n"))
    table = counts.select("_part", F.expr("coalesce(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding), 0)").alias("_before"))
    joined = parts.join(F.broadcast(table), F.shiftright(at, 33) == F.col("_part"))
    place = F.col("_before") + F.col(at).bitwiseAND((1 << 33) - 1)
    return joined.withColumn("_place", place).drop(at, "_part", "_before"), "_place"


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, label): the smallest node that each node of `edges` (a, b: long) reaches.

    Rounds of hooking to the smallest neighbour, pointer jumping until flat, and contraction; nothing is collected but counts."""
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = written(nodes.withColumn("label", F.col("node")), name)
    live = edges
    while not live.isEmpty():
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("p")), name)
        while True:
            up = parent.select(F.col("x").alias("p"), F.col("p").alias("q"))
            parent = written(parent.join(up, "p", "left").select("x", "p", F.coalesce("q", "p").alias("q")), name)
            moved = not parent.where("p <> q").isEmpty()
            parent = parent.select("x", F.col("q").alias("p"))
            if not moved:
                break
        to = parent.select(F.col("x").alias("label"), "p")
        labels = written(labels.join(to, "label", "left").select("node", F.coalesce("p", "label").alias("label")), name)
        left, right = parent.select(F.col("x").alias("a"), F.col("p").alias("pa")), parent.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        live = written(live.join(left, "a").join(right, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), name)
    return labels


def merged(labels: DataFrame, links: DataFrame, name: str = "cc") -> DataFrame:
    """`labels` (node, label) after more links (a, b); nodes without a label are their own."""
    named = lambda at: labels.select(F.col("node").alias(at), F.col("label").alias(f"l{at}"))
    ends = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    moved = components(ends, name).withColumnRenamed("node", "n").withColumnRenamed("label", "to")
    old = labels.join(moved, F.col("label") == F.col("n"), "left").select("node", F.coalesce("to", "label").alias("label"))
    new = moved.select(F.col("n").alias("node"), F.col("to").alias("label")).join(labels.select("node"), "node", "left_anti")
    return written(old.union(new), name)


def settle() -> None:
    """Python workers outlive their tasks: forgets what the operator before this one remembered, and gives freed memory back."""
    _REMEMBERED.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def remembered(key: tuple, build):
    """build(), once in each worker for as long as the same operator runs there."""
    if key not in _REMEMBERED:
        settle()
        _REMEMBERED[key] = build()
    return _REMEMBERED[key]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words, in place where it can."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Bounded(dict):
    """A memo of f(key) of at most `most` entries with keys up to 64 long; when full it starts anew. It only saves time, never changes a value."""

    def __init__(self, f, most: int = 400_000):
        super().__init__()
        self.f, self.most = f, most

    def __missing__(self, key):
        value = self.f(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
