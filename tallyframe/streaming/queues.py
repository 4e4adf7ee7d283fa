"""The queue worker and the rate limit as streams, and window counts over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def idempotent(events: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Each key once, within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def window_counts(events: DataFrame, time: str, key: str, value: str, length: str, delay: str) -> DataFrame:
    w = F.window(time, length)
    return events.withWatermark(time, delay).groupBy(w, key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total")


def rate_limit(hits: DataFrame, key: str, at: str, width: float, most: int) -> DataFrame:
    """(key, at, allowed): a window opens at a key's first hit, and the first hit `width` seconds or more later opens the next."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        for t in sorted(t for f in frames for t in f[at]):
            if start is None or t - start >= width:
                start, n = t, 0
            n += 1
            yield pd.DataFrame({key: [k[0]], "at": [t], "allowed": [n <= most]})
        state.update((start, n))

    kind = hits.schema[key].dataType.simpleString()
    return hits.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at double, allowed boolean", "start double, n long", "append", GroupStateTimeout.NoTimeout)


def drain(queue: DataFrame, state_path: str, send, batch: int = 10, retries: int = 5, now=F.current_timestamp) -> DataStreamWriter:
    """A worker on a stream of rows (id, due); rows without id are ticks, which only make it look again.

    All that was ever enqueued is in a state table (id, due, status, attempts), one version for each trigger under state_path, a folder that
    all machines share. A trigger adds the new rows (an id that is there stays as it is), takes the pending ones that are due, oldest
    first and `batch` at most, and writes the next version: sent, pending with one attempt more, or dead after `retries`. A trigger that
    is run again after a failure starts from the version before it. `send` adds `ok` to a DataFrame of the rows that it is given."""
    state = "id long, due timestamp, status string, attempts int"

    def work(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        old = versions(spark, state_path, epoch)
        table = spark.read.schema(state).parquet(f"{state_path}/epoch={old}") if old is not None else spark.createDataFrame([], state)
        new = rows.where("id is not null").groupBy("id").agg(F.min("due").alias("due")).join(table.select("id"), "id", "left_anti")
        table = table.unionByName(new.select("id", "due", F.lit("pending").alias("status"), F.lit(0).alias("attempts")))
        due = table.where((F.col("status") == "pending") & (F.col("due") <= now())).orderBy("due", "id").limit(batch)
        done = send(due).select("id", F.coalesce("ok", F.lit(False)).alias("_ok"))
        tries = F.col("attempts") + F.when(F.col("_ok") == F.lit(False), 1).otherwise(0)
        status = F.when(F.col("_ok").isNull(), F.col("status")).when(F.col("_ok"), "sent").when(tries >= retries, "dead").otherwise("pending")
        # At most `batch` rows: that is what is broadcast.
        table.join(F.broadcast(done), "id", "left").select("id", "due", status.alias("status"), tries.alias("attempts")).write.mode("overwrite").parquet(f"{state_path}/epoch={epoch}")

    return queue.writeStream.foreachBatch(work)


def versions(spark: SparkSession, path: str, before: int) -> int | None:
    """The last version below `before` that is written in full."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = [f.getPath().getName() for f in fs.listStatus(root)]
    whole = [int(n[6:]) for n in names if n.startswith("epoch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return max((n for n in whole if n < before), default=None)


def outcome(attempts: DataFrame, key: str, order: str, ok: str, retries: int = 5) -> DataFrame:
    """(key, status, tries): where the attempts of each queued row lead; what comes after an end is not looked at."""
    tries = attempts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, ok))).alias("a"))
    begin = F.struct(F.lit("pending").alias("status"), F.lit(0).alias("tries"))
    fold = lambda s, x: F.when(s["status"] != "pending", s).otherwise(F.struct(F.when(x[ok], F.lit("sent")).when(s["tries"] + 1 >= retries, F.lit("dead")).otherwise(F.lit("pending")).alias("status"), (s["tries"] + 1).alias("tries")))
    return tries.select(key, F.aggregate("a", begin, fold).alias("s")).select(key, "s.status", "s.tries")
