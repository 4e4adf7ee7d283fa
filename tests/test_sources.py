"""Sources and sinks on small files: quoting, headers, encodings, overrides, order."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import joins as J
from tallyframe.operators import windows as V
from tallyframe.operators import writes as W
from tallyframe.sources import readers as R


def test_csv_is_all_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,note\n1,"Ruiz, Ana","said ""hi"""\n2,,\n3,"two\nlines",x\n')
    got = {r.id: (r.name, r.note) for r in R.csv_strings(spark, str(tmp_path / "a.csv"), ["id", "name", "note"]).collect()}
    assert got == {"1": ("Ruiz, Ana", 'said "hi"'), "2": ("", ""), "3": ("two\nlines", "x")}


def test_sources_merge(spark):
    a, b = (spark.createDataFrame(r, "id int, v string") for r in ([(1, "a"), (2, "b")], [(2, "c")]))
    both, shared = R.merge_sources([a, None, b], "id")
    assert both.count() == 3 and [(r.id, r.n) for r in shared.collect()] == [(2, 2)]
    for bad in ([a, b.withColumnRenamed("v", "w")], [None]):
        with pytest.raises(ValueError, match="header|no source"):
            R.merge_sources(bad, "id")
    extra = spark.createDataFrame([(2, "z"), (2, "y"), (3, "x")], "id int, v string")
    for n in (1, 4):
        assert sorted(map(tuple, R.override_merge(a, extra.repartition(n), "id").collect())) == [(1, "a"), (2, "y"), (3, "x")]
        assert sorted(map(tuple, J.insert_ignore(a, extra.repartition(n), "id").collect())) == [(1, "a"), (2, "b"), (3, "x")]


def test_json_lines_and_pages(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "x": "a"}\nnot json\n{"id": 2}\n')
    assert sorted((r.id or 0, r.x) for r in R.json_lines(spark, str(tmp_path / "a.jsonl"), "id int, x string").collect()) == [(0, None), (1, "a"), (2, None)]
    deep = tmp_path / "www" / "clubs" / "1"
    deep.mkdir(parents=True)
    (deep / "index.html").write_bytes("é".encode())
    (tmp_path / "www" / "old.html").write_bytes("é".encode("latin-1"))
    (tmp_path / "www" / "other.txt").write_bytes(b"x")
    assert [r.text for r in R.whole_texts(spark, str(tmp_path / "www")).orderBy("path").collect()] == ["é", "é"]


def test_sorted_sink(spark, tmp_path):
    df = spark.createDataFrame([(i * 7 % 10, str(i)) for i in range(10)], "k int, v string").repartition(3)
    for _ in range(2):  # what is there is replaced
        R.write_sorted(df, str(tmp_path / "out"), ["k"], "csv")
    lines = [line for f in sorted((tmp_path / "out").glob("*.csv")) for line in f.read_text().splitlines() if line != "k,v"]
    assert [int(x.split(",")[0]) for x in lines] == list(range(10))


def test_rate_limit_of_a_hot_key(spark):
    """One key with most of the hits; a null key and a null time have no window."""
    hits = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("hot").alias("k"), "id", F.col("id").cast("double").alias("at")).union(spark.createDataFrame([(None, 1, 1.0), ("x", 2, None)], "k string, id long, at double"))
    got = V.first_hit_windows(hits, "k", "at", 100, 5).toPandas()
    assert len(got) == 3000
    start, n = None, 0
    for at, allowed in got[got.k == "hot"].sort_values("at")[["at", "allowed"]].itertuples(index=False):
        if start is None or at - start >= 100:
            start, n = at, 0
        n += 1
        assert allowed == (n <= 5)


def test_writes_with_nulls(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, None, None), (None, "c", 3)], "id int, v string, n int")
    assert sorted(map(str, W.patch(df, F.col("n") > 0, v=F.lit("z")).select("v").toPandas().v)) == ["None", "z", "z"]
    assert W.delete(df, "id", spark.createDataFrame([(1,), (None,)], "id int")).count() == 2
    rows, facts = W.browse(df, [F.col("id")], limit=500, offset=1)
    assert rows.count() == 2 and facts.first() == (3, False)
    assert W.browse(df, [F.col("id")], limit=0)[0].count() == 0
    out = W.cascade({"p": df.where("id = 1"), "c": df}, [("c", "p", "id")])["c"]
    assert sorted(str(r.id) for r in out.collect()) == ["1", "None"]
    assert V.placed(df, ["v"], F.lit(0), ["n"], "k").count() == 3
