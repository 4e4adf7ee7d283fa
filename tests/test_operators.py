"""Operators on small hand-made tables."""

import uuid

from pyspark.sql import functions as F

from tallyframe.functions import text as X
from tallyframe.operators import identity, joins, windows
from tallyframe.sources import readers
from tallyframe.streaming import queues


def col(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_tie_rank(spark):
    df = spark.createDataFrame([(1, 9), (2, 7), (3, 7), (4, 5)], "id int, v int")
    assert col(windows.tie_rank(df, "v"), "id", "place") == [(1, "1"), (2, "T-2"), (3, "T-2"), (4, "4")]


def test_superseded_chain(spark):
    df = spark.createDataFrame([(i, "t", v) for i, v in enumerate([10, 15, 15, 20, 20])], "id int, k string, v int")
    assert col(windows.superseded_by(df, "k", "v"), "id", "next_value") == [(0, 15), (1, 20), (2, 20), (3, None), (4, None)]


def test_rate_limit_opens_at_first_hit(spark):
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate([0, 10, 50, 61])], "id int, k string, t int")
    assert [x[1] for x in col(windows.first_hit_windows(df, "k", "t", 60, 2), "at", "allowed")] == [True, True, False, True]


def test_date_ranges(spark):
    given = ["February 27-March 2, 1996", "May 11-14, 2007", "October 5, 1988", "to be told"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(given)], "id int, s string").select("id", X.date_range(F.col("s")).alias("r")).select("id", "r.start", "r.end")
    assert [x[1:] for x in col(df, "id", "start", "end")] == [("1996-02-27", "1996-03-02"), ("2007-05-11", "2007-05-14"), ("1988-10-05", "1988-10-05"), ("", "")]


def test_uuid5(spark):
    ns = uuid.NAMESPACE_DNS
    names = ["a", "Žofie", "x" * 100]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", X.uuid5(ns.hex, F.col("n")).alias("u"))
    assert {r.n: r.u for r in df.collect()} == {n: str(uuid.uuid5(ns, n)) for n in names}


def test_names(spark):
    df = spark.createDataFrame([("José-Luis  O'Neil, Jr.",)], "n string")
    assert df.select(X.normalise_name(F.col("n")), X.surname(F.col("n")), X.slugify(F.col("n"))).first() == ("jose luis oneil jr", "o'neil", "jos_luis_oneil_jr")
    assert [r[0] for r in spark.createDataFrame([("2008abc",), ("x",), ("-7",)], "n string").select(X.leading_int(F.col("n"))).collect()] == [2008, None, -7]


def test_match_passes(spark):
    people = spark.createDataFrame([(1, "Al Smith"), (2, "Ann Lee"), (3, "A Lee"), (4, "B Roe"), (5, "Zoe Q")], "id int, name string")
    known = spark.createDataFrame([("p1", "Alan Smith"), ("p2", "Ann Lee"), ("p3", "Bob Roe"), ("p4", "Bill Roe"), ("p5", "Abe Lee")], "pid string, name string")
    aliases = spark.createDataFrame([("Al Smith", "p1")], "alias string, pid string")
    assert col(identity.passes(people, known, aliases).select("id", "status", F.coalesce("match", F.lit("")).alias("match")), "id", "status", "match") == [(1, "ALIAS", "p1"), (2, "EXACT", "p2"), (3, "CONFLICT", ""), (4, "CONFLICT", ""), (5, "NONE", "")]


def test_merges(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, v string")
    assert col(joins.upsert(old, new, "k"), "k", "v") == [(1, "x"), (2, "y"), (3, "z")]
    assert col(joins.upsert(old, new, "k", fill_only=True), "k", "v") == [(1, "a"), (2, "y"), (3, "z")]
    assert [k for k, in col(joins.insert_ignore(old, new, "k"), "k")] == [1, 2, 3]


def test_placements(spark):
    text = "Open Doubles\n1. Ann Lee & Bo Ray\n2nd Cy Dee / Ed Foe\nOpen Singles:\n1) Gus Hay\n120 nobody"
    lines = readers.text_blocks(spark.createDataFrame([(7, text)], "k int, t string"), "k", "t", r"^[A-Z][A-Za-z ]+:?$")
    assert col(readers.parse_placements(lines, "k"), "line_no", "division", "place", "player1") == [(1, "Open Doubles", 1, "Ann Lee"), (2, "Open Doubles", 2, "Cy Dee"), (4, "Open Singles", 1, "Gus Hay")]


def test_csv_and_outcome(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x, ""y"""\n2,\n')
    assert col(readers.csv_strings(spark, f"file://{tmp_path}/a.csv", ["k", "v"]), "k", "v") == [("1", 'x, "y"'), ("2", "")]
    tries = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, False), *[("c", i, False) for i in range(6)]], "k string, n int, ok boolean")
    assert col(queues.outcome(tries, "k", "n", "ok"), "k", "status", "tries") == [("a", "sent", 2), ("b", "pending", 1), ("c", "dead", 5)]


def test_rate_limit_stream(spark, tmp_path):
    spark.createDataFrame([("k", float(t)) for t in (0, 10, 50, 61)], "k string, at double").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, at double").parquet(f"{tmp_path}/in")
    q = queues.rate_limit(stream, "k", "at", 60, 2).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [r.allowed for r in spark.table("limited").orderBy("at").collect()] == [True, True, False, True]
