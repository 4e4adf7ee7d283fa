"""The queue worker, idempotent enqueueing, event-time counts and the rate limit, as streams over files."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tallyframe.streaming import queues as Q

NOW = dt.datetime(2020, 1, 2)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def run(writer, tmp):
    q = writer.option("checkpointLocation", str(tmp / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_worker_loses_nothing(spark, tmp_path):
    """25 rows and one not due in one file, then ticks; odd ids fail for ever, and are dead after two tries."""
    rows = [{"id": i, "due": f"2020-01-01T00:00:{i:02d}"} for i in range(25)] + [{"id": 99, "due": "2020-02-01T00:00:00"}, {"id": 3, "due": "2020-01-01T00:00:59"}]
    for n in range(6):
        put(tmp_path / "in", f"{n}.json", rows if n == 0 else [{"id": None, "due": None}])
        stream = spark.readStream.schema("id long, due timestamp").json(str(tmp_path / "in"))
        run(Q.drain(stream, str(tmp_path / "state"), lambda d: d.withColumn("ok", F.col("id") % 2 == 0), batch=10, retries=2, now=lambda: F.lit(NOW)), tmp_path)
        last = Q.versions(spark, str(tmp_path / "state"), 1000)
        state = {r.id: (r.status, r.attempts) for r in spark.read.parquet(str(tmp_path / "state" / f"epoch={last}")).collect()}
        assert len(state) == 26 and state[99] == ("pending", 0)
        if n == 0:
            assert [state[i] for i in range(12)] == [("sent", 0), ("pending", 1)] * 5 + [("pending", 0)] * 2
    assert all(state[i] == (("sent", 0) if i % 2 == 0 else ("dead", 2)) for i in range(25))


def test_idempotent_and_windows(spark, tmp_path):
    put(tmp_path / "in", "a.json", [{"k": "x", "t": "2020-01-01T00:00:10", "v": 1}, {"k": "x", "t": "2020-01-01T00:00:10", "v": 1}, {"k": "y", "t": "2020-01-01T00:01:10", "v": 5}])
    stream = lambda: spark.readStream.schema("k string, t timestamp, v long").json(str(tmp_path / "in"))
    q = Q.idempotent(stream(), "k", "t").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.k for r in spark.table("once").collect()) == ["x", "y"]
    q = Q.window_counts(stream(), "t", "k", "v", "1 minute", "0 seconds").writeStream.format("memory").outputMode("complete").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.n, r.total) for r in spark.table("counts").collect()) == [("x", 2, 2), ("y", 1, 5)]


def test_rate_limit(spark, tmp_path):
    """Two a minute: the window opens at the first hit."""
    put(tmp_path / "in", "a.json", [{"k": "x", "at": t} for t in (0.0, 10.0, 50.0, 61.0)])
    stream = spark.readStream.schema("k string, at double").json(str(tmp_path / "in"))
    q = Q.rate_limit(stream, "k", "at", 60, 2).writeStream.format("memory").queryName("limited").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.allowed for r in sorted(spark.table("limited").collect(), key=lambda r: r.at)] == [True, True, False, True]
