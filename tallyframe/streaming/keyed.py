"""Keyed state with lists, timers and times to live: the sliding guard and the outbox.

Both need the RocksDB state store, whose cost of a trigger follows the keys that have rows or due timers, not all that are known."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def rocks(spark: SparkSession, idle: bool = True) -> Iterator[None]:
    """Streams that are started within use the RocksDB state store. With idle=False they run no triggers without new rows: a stream in
    processing time, whose times to live ask for such triggers for ever, then ends when it is to read only what is there."""
    asked = {PROVIDER: ROCKS, "spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower()}
    held = {k: spark.conf.get(k) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def sliding_guard(hits: DataFrame, key: str, row: str, at: str, width: int, most: int) -> DataFrame:
    """(key, row, at, recent, allowed): how many hits of the key lie less than `width` before this one, and whether that is below `most`.

    `at` and width are integers of one unit; hits at the same moment do not count for each other. A RANGE frame over the interval: hits are
    dealt by key and bin of `width`, each to its own bin and the next one as what came before, so a key's window is no longer than
    two widths and a key with a third of all rows is spread over its bins. Rows without key or time give none."""
    h = hits.select(key, F.col(row), F.col(at).cast("long").alias("at")).where(f"{key} is not null and at is not null").withColumn("_home", F.floor(F.col("at") / width))
    dealt = h.withColumn("_bin", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
    frame = Window.partitionBy(key, "_bin").orderBy("at").rangeBetween(-(width - 1), -1)
    out = dealt.withColumn("recent", F.count("*").over(frame)).where("_bin = _home")
    return out.select(key, row, "at", "recent", (F.col("recent") < most).alias("allowed"))


class Guard(StatefulProcessor):
    """A key's hits of the last `width`, as a list; the list's rows end by themselves when a key is not seen again."""

    def __init__(self, row: str, width: int, most: int, live_ms: int):
        self.row, self.width, self.most, self.live_ms = row, width, most, live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hits = handle.getListState("hits", "at long", ttlDurationMs=self.live_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        new = pd.concat(list(rows)).sort_values(["at", self.row])
        held = sorted(x[0] for x in self.hits.get())
        out = []
        for row, at in zip(new[self.row].tolist(), new["at"].tolist(), strict=True):
            recent = sum(1 for h in held if at - self.width < h < at)
            out.append((key[0], row, at, recent, recent < self.most))
            held.append(at)
        newest = max(held)
        self.hits.clear()
        self.hits.put([(h,) for h in held if h > newest - self.width])
        yield pd.DataFrame(out, columns=["key", "row", "at", "recent", "allowed"])

    def close(self) -> None:
        pass


def guard_stream(hits: DataFrame, key: str, row: str, at: str, width: int, most: int, live_ms: int = 86_400_000) -> DataFrame:
    """sliding_guard over a stream: a hit counts those that have come before it. `live_ms` is how long a silent key's hits are held."""
    h = hits.select(F.col(key).alias("key"), F.col(row).alias("row"), F.col(at).cast("long").alias("at")).where("key is not null and at is not null")
    kinds = f"{key} {h.schema['key'].dataType.simpleString()}, {row} {h.schema['row'].dataType.simpleString()}, at long, recent long, allowed boolean"
    out = h.groupBy("key").transformWithStateInPandas(_Renamed(Guard("row", width, most, live_ms), key, row), kinds, "Append", "ProcessingTime")
    return out


class _Renamed(StatefulProcessor):
    """A processor whose output has the caller's names for key and row."""

    def __init__(self, inner: Guard, key: str, row: str):
        self.inner, self.names = inner, {"key": key, "row": row}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.inner.init(handle)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for f in self.inner.handleInputRows(key, rows, timerValues):
            yield f.rename(columns=self.names)

    def close(self) -> None:
        pass


class Outbox(StatefulProcessor):
    """One queued row: it is sent when its timer says so, tried again `backoff` later, and dead after `retries`.

    What is done is remembered for `keep` more, so that the same id is not queued twice in that time, and then forgotten."""

    def __init__(self, send: Callable[[int, int], bool], retries: int, backoff_ms: int, keep_ms: int):
        self.send, self.retries, self.backoff_ms, self.keep_ms = send, retries, backoff_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, attempts int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = min(int(f["due_ms"].min()) for f in rows)
        if not self.job.exists():
            self.job.update(("pending", 0))
            # A timer in the past would never ring: what is overdue rings next.
            self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"id": [], "attempt": [], "status": [], "at_ms": []}).astype({"id": "int64", "attempt": "int32", "status": "object", "at_ms": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = expiredTimerInfo.getExpiryTimeInMs()
        status, attempts = self.job.get()
        if status != "pending":
            self.job.clear()
            return
        attempts += 1
        status = "sent" if self.send(key[0], attempts) else "dead" if attempts >= self.retries else "pending"
        self.job.update((status, attempts))
        again = at + (self.backoff_ms if status == "pending" else self.keep_ms)
        self.handle.registerTimer(max(again, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"id": [key[0]], "attempt": [attempts], "status": [status], "at_ms": [at]})

    def close(self) -> None:
        pass


def outbox(queue: DataFrame, id_: str, due: str, send: Callable[[int, int], bool], retries: int = 5, backoff_ms: int = 60_000, keep_ms: int = 86_400_000, delay: str = "0 seconds") -> DataFrame:
    """(id, attempt, status, at_ms) for each attempt at a stream of queued rows: sent, pending (it will be tried again) or dead.

    An id that is queued again while it is known stays as it is. `due` is an event time: rows become due as the stream's watermark passes them.
    `send(id, attempt)` runs in the task and must bear to be called again for an attempt whose trigger failed. State is one value and one
    timer an id, so a trigger costs what is new or due; a restart from the checkpoint goes on where it stopped."""
    rows = queue.withWatermark(due, delay).select(F.col(id_).cast("long").alias("id"), F.col(due), F.unix_millis(due).alias("due_ms")).where("id is not null and due_ms is not null")
    return rows.groupBy("id").transformWithStateInPandas(Outbox(send, retries, backoff_ms, keep_ms), "id long, attempt int, status string, at_ms long", "Append", "EventTime")
