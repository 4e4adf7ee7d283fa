"""Joins, closures, terms, pages, loads and keyed streams against brute force."""

import random
import re
from collections import Counter, defaultdict
from datetime import timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import diff, graph, grains, intervals, joins, lexicon, variants
from tallyframe.plans import links
from tallyframe.plans.catalog import Tables
from tallyframe.sources import markup, parts
from tallyframe.streaming import keyed

DIR = "/root/testdata/sf0.001"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_similar_names_equal_all_pairs(spark, monkeypatch, edits):
    """Short and empty names, letters that repeat, grams that all names share; also where every gram is heavy."""
    rng = random.Random(edits)
    names = {"".join(rng.choice("abé") for _ in range(rng.randint(0, 7))) for _ in range(120)} | {f"Person#{i:04d}" for i in range(60)} | {"aaaaaaa", "aaaaaa", "aaaabaaa"}
    want = {(a, b) for a, b in combinations(sorted(names), 2) if levenshtein(a, b) <= edits}
    df = spark.createDataFrame([(n,) for n in names] + [(None,), ("aaaaaaa",)], "name string")
    for light in (64, 0, 5):
        monkeypatch.setattr(variants, "LIGHT", light)
        got = [tuple(sorted(r)) for r in variants.similar_names(df, edits=edits).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("edits", [1, 2])
def test_similar_names_broadcast_no_exploded_rows(spark, tmp_path, edits):
    """A small file's rows, exploded, are many: none may be broadcast for the file's size."""
    spark.range(300).selectExpr("concat('Person#', lpad(id, 9, '0')) AS name").write.parquet(f"{tmp_path}/names")
    names = spark.read.parquet(f"{tmp_path}/names")
    plan = variants.similar_names(names, edits=edits)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_variants_by_hand(spark):
    persons = spark.createDataFrame([(1, "p1", "Ana María Ruiz"), (2, "p2", "Bo Lind"), (3, "p3", "A. J. Smith"), (4, "p4", "Lind Bo"), (5, "", "No Id"), (6, "p6", "R2 D2"), (7, "p7", "Jo Freeman Genz")], "ord int, person_id string, name string")
    displays = spark.createDataFrame([(1, "RUIZ ANA", "p1", ""), (2, "Bo Lind", "p2", ""), (3, "Lind Bo", "p2", ""), (4, "Old Name", "gone", "New Name"), (5, "R2 D 2", "p6", ""), (6, "Ana", "p1", "")], "ord int, display_name string, person_id string, fallback string")
    rated = spark.createDataFrame([(1, "ana maria ruiz"), (2, "bo  LIND"), (3, "Nobody Here")], "ord int, name string")
    aliases = spark.createDataFrame([(1, "AJ Smith", "p3", ""), (2, "A J Smyth", "p3", "verified"), (3, "Ana Ruiz", "p1", None), (4, "Ana Ruis", "p1", ""), (5, "Smith A. J.", "p3", "rejected"), (6, "Jo Freeman-Genz", "p7", ""), (7, "Ana 'Mari' Ruiz", "p1", "")], "ord int, alias string, person_id string, status string")
    got = {tuple(r) for r in variants.mine_variants(persons, displays, rated, aliases).collect()}
    assert got == {
        ("Ruiz Ana", "Ana María Ruiz", "high", "display_name"), ("Old Name", "New Name", "high", "display_name"), ("Ana Maria Ruiz", "Ana María Ruiz", "high", "bap"), ("bo LIND", "Bo Lind", "high", "bap"),
        ("AJ Smith", "A. J. Smith", "medium", "alias"), ("Ana Ruiz", "Ana María Ruiz", "medium", "alias"), ("Jo Freeman-Genz", "Jo Freeman Genz", "high", "alias"),
    }


def scanned(text, terms):
    """Terms in a text's lines by regular expressions, longest first, with a mask."""
    out, no = set(), 0
    for raw in re.split(r"\r\n|\r|\n", text or ""):
        line = re.sub(r"\s+", " ", raw).strip(" ")
        if not line:
            continue
        no += 1
        low, mask = lexicon.folded(line), set()
        for term in sorted(terms, key=lambda x: (-len(x), x)):
            for m in re.finditer(rf"(?<![A-Za-z0-9]){re.escape(term)}(?![A-Za-z0-9])", low):
                span = range(m.start(), m.end())
                free = mask.isdisjoint(span)
                mask.update(span if free else ())
                out.add((no, term, m.start(), m.end(), free))
    return out


def test_terms_both_ways(spark):
    texts = spark.createDataFrame([(1, "Red Widget, red\nred-widget REDWIDGET İred x"), (2, "a b a b a\n\r\n  big  red   widget-x9"), (3, None), (4, ""), (5, "É red é.red_widget " * 50)], "id long, text string")
    terms = ["red widget", "red", "a b a", "widget", "-x9", "red widget-x9", "big red", "é"]
    lines, table = lexicon.lines_of(texts), spark.createDataFrame([(t, t) for t in terms], "term string, canon string")
    want = {(r.id, *x) for r in texts.collect() for x in scanned(r.text, [t for t in terms if t != "é"])}
    for most in (lexicon.AUTOMATON, 0):
        got = lexicon.masked(lexicon.occurrences(lines, lexicon.terms_of(table), most))
        assert {tuple(r) for r in got.collect()} == want
    assert lexicon.mine_terms(texts, table.limit(0)).count() == 0


def test_terms_in_documents(spark):
    t = Tables(spark, DIR)
    got = {(r.id, r.line_no, r.start, r.stop, r.kept) for r in links.terms_in_documents(t).collect()}
    texts = [(r.doc_id, r.text) for r in t.documents.collect()] + [(-(r.conv_id + 1) * 1_000_000 - r.turn, r.text) for r in t.conversations.collect()]
    said = {w for r in t.benchmark.collect() for w in re.split(r"[^\w]+|[\d_]+", r.text.lower()) if len(w) > 3} | {m.group(1) for r in t.benchmark.collect() if (m := re.match(r"([a-zA-Z0-9_]+ [a-zA-Z0-9_]+)", r.text.lower()))}
    names = {r.p_name for r in t.part.select("p_name").collect()}
    terms = {x.strip() for x in said | names | {n.split()[0] for n in names}}
    terms = {x for x in terms if re.search("[a-z0-9]", x) and x not in lexicon.GENERIC}
    machine = re.compile("|".join(rf"(?<![A-Za-z0-9]){re.escape(x)}(?![A-Za-z0-9])" for x in terms))
    checked = 0
    for at, text in texts[:60] + texts[-60:]:
        mine = {x[1:] for x in got if x[0] == at}
        want = {(no, a, b, free) for no, _, a, b, free in scanned(text, [x for x in terms if x in lexicon.folded(re.sub(r"\s+", " ", text or ""))])}
        assert mine <= want and all(machine.search(lexicon.folded(text)) for _ in mine)
        lines = {x[0] for x in mine}
        assert {x for x in want if x[0] in lines} == mine  # other lines are headers, addresses or blank
        checked += len(mine)
    assert checked > 500


@pytest.mark.parametrize(("line", "kind"), [("1. Ana Ruiz: 9.5 points", "result_score"), ("2) Bo Lind", "result_plain"), ("SICK 3 FINALS", "header"), ("-----", "header"), ("see www.x.org", "skip"), ("just words", "skip"), ("3 Cy Young", "result_plain"), ("", "skip")])
def test_line_classes(spark, line, kind):
    assert spark.range(1).select(lexicon.line_class(F.lit(line), F.lit(False))).first()[0] == kind


@pytest.mark.parametrize(("name", "score", "line", "kind"), [("Ana Ruiz", "9.5", "score", "freestyle_judging"), ("Ana Ruiz", "44.5", "score", "raw_integer"), ("Ana Ruiz", "150", "150 Kicks", "consecutive_count"), ("Ana Ruiz", "50", "distance", "distance_count"), ("Ana Ruiz", "50", "golf", "golf_score"), ("Ana Ruiz", "12", "x", "golf_score"), ("Ana Ruiz", "70", "x", "raw_integer"), ("Open Shred", "9.5", "x", "reject"), ("ANA RUIZ", "9.5", "x", "reject"), ("Ana Ruiz", "x", "x", "reject")])
def test_score_classes(spark, name, score, line, kind):
    assert spark.range(1).select(lexicon.score_class(F.lit(name), F.lit(score), F.lit(line), F.lit("result_score"))).first()[0] == kind


def test_components_and_merges(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    df = spark.createDataFrame(pairs, "a long, b long")
    assert {tuple(r) for r in graph.components(df).collect()} == {(n, find(n)) for n in root}
    assert graph.components(df.limit(0)).count() == 0
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "y"), ("s", "s"), ("n", None)], "source string, target string")
    assert {tuple(r) for r in graph.merge_targets(chain).collect()} == {("a", "c"), ("b", "c"), ("c", "c"), ("x", "x"), ("y", "x"), ("z", "x")}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_co_members_of_a_large_group(spark, block):
    """One group holds a third of the rows; small blocks give the same counts in many tasks."""
    rng = random.Random(block)
    rows = [(0, m) for m in range(40)] + [(rng.randrange(1, 20), rng.randrange(40)) for _ in range(80)] + [(None, 1), (1, None), (0, 3)]
    groups = defaultdict(set)
    for g, m in rows:
        if g is not None and m is not None:
            groups[g].add(m)
    want = Counter((a, b) for ms in groups.values() for a in ms for b in ms if a != b)
    got = joins.co_members(spark.createDataFrame(rows, "g long, m long"), "g", "m", block)
    assert {(r.m, r.other): r.shared for r in got.collect()} == want


def test_grains_read_once(spark):
    rows = spark.createDataFrame([(1, 2001, "e", v) for v in (5, 5, 40_000, 70_000)] + [(1, 2002, "e", 5), (2, 2002, "f", None)], "p long, y int, era string, v long")
    found = grains.distinct_by_grain(rows, "v", ["p", "y", "era"], {"year": ["p", "y", "era"], "era": ["p", "era"], "all": []})
    assert {tuple(r) for r in found.collect()} == {("year", 1, 2001, "e", 3), ("year", 1, 2002, "e", 1), ("era", 1, None, "e", 3), ("all", None, None, None, 3)}
    plan = links.persons_by_grain(Tables(spark, DIR))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_partners_by_hand(spark):
    seen = spark.createDataFrame([(1, 2, y) for y in (1990, 1999, 2000, 2001, 2001)] + [(1, 3, 2000)] * 5 + [(1, 4, 2005)] * 9, "person long, partner long, year int")
    asks = spark.createDataFrame([(10, 1, 2001), (11, 1, 1989), (12, 9, 2001)], "ask long, person long, year int")
    assert [tuple(r) for r in intervals.partners_as_of(asks, seen).orderBy("nth").collect()] == [(10, 3, 5, 2000, "HIGH", 1), (10, 2, 4, 2001, "MEDIUM", 2)]


@pytest.mark.parametrize("named", [64, 0])
def test_table_diff(spark, monkeypatch, named):
    monkeypatch.setattr(diff, "NAMED", named)
    old = spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(100)] + [(7, "twice", None), (None, "x", 1.0), (None, "x", 1.0)], "k long, name string, v double")
    new = spark.createDataFrame([(i, "N3" if i == 3 else f"n{i}", None if i in (3, 50) else float(i)) for i in range(100) if i != 9] + [(7, "twice", None), (7, "third", None), (None, "x", 1.0), (500, "new", None)], "k long, name string, v double")
    got = Counter(tuple(r) for r in diff.table_diff(old, new, "k", 10).collect())
    assert got == Counter({(3, "changed", "name,v"): 1, (50, "changed", "v"): 1, (9, "removed", ""): 1, (500, "added", ""): 1, (7, "added", ""): 1, (None, "removed", ""): 1})
    assert diff.differing_ranges(old, old.repartition(7), "k", 10).count() == 0


def test_loads_that_are_repeated(spark, tmp_path):
    path, table = f"file://{tmp_path}/t", lambda *rows: spark.createDataFrame(rows, "k long, v string")
    read = lambda: sorted(tuple(r) for r in parts.read_parts(spark, path, "k long, v string").collect())
    assert read() == [] and parts.load_part(table((1, "a"), (2, None)), path, "r1") and parts.load_part(table((1, "b")), path, "r2")
    assert not parts.load_part(table((2, None), (1, "a")), path, "r1")  # the same rows, in another order
    assert parts.load_part(table((1, "c")), path, "r2") and read() == [(1, "a", "r1"), (1, "c", "r2"), (2, None, "r1")]
    assert parts.load_part(spark.createDataFrame([], "k long, v string"), path, "r2") and read() == [(1, "a", "r1"), (2, None, "r1")]
    spark.createDataFrame([(9, "half", "r3")], "k long, v string, run string").write.mode("append").partitionBy("run").parquet(f"{path}/data")  # a load that never came to its manifest
    assert read() == [(1, "a", "r1"), (2, None, "r1")] and parts.load_part(table((3, "d")), path, "r3") and read()[-1] == (3, "d", "r3")


@pytest.mark.parametrize(
    ("page", "place", "host"),
    [
        ('<div class="where"><div>A <div>b</div></div> c</div><p><b>Host:</b> Ann &amp; <i>Bo</i><br>x', "A b c", "Ann & Bo"),
        ('<DIV CLASS=\'x where y\'>one<br>two<script>no</script></DIV><strong> host </strong>: me<b>Next</b>', "one two", "me"),
        ('<ul><li class="where">a<ul><li>b</ul>c<li>d</ul>', "a b c", ""),
        ('<table><tr><td class=where>1<td>2<tr><td>3</table>', "1", ""),
        ('<p class="where">un<b>closed <p>other', "unclosed", ""),
        ('<!-- <div class="where">no</div> --><div class="where"></div><div class="where">second</div>', "", ""),
        ("", "", ""), (None, "", ""), ("<div class='where'>" * 300 + "deep", "deep", ""),
    ],
)
def test_nested_fields(spark, page, place, host):
    df = spark.createDataFrame([(1, page)], "id long, html string")
    r = markup.fields(df, "id", "html", {"place": "where"}, {"host": "Host"}).first()
    assert (r.place, r.host) == (place, host)


def test_page_adverts_of_all_pages(spark):
    t = Tables(spark, DIR)
    e = {r.page_id: r for r in links.page_elements(t).collect()}
    for page in t.pages.collect():
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|title)[^>]*>.*?</\1>", lambda m: f"<{m.group(1)}>" if m.group(1) else "", page.html)
        assert e[page.page_id].elements == len(re.findall(r"<[a-zA-Z]", body)) and e[page.page_id].links == len(re.findall("<a ", body))


def test_guard_deals_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(1 if i % 3 else 2 + i % 7, i, rng.randrange(2_000)) for i in range(400)] + [(None, 900, 5), (1, 901, None)]
    got = {r.id: (r.recent, r.allowed) for r in keyed.sliding_guard(spark.createDataFrame(rows, "u long, id long, t long"), "u", "id", "t", 100, 4).collect()}
    want = {i: sum(1 for v, _, s in rows if v == u and s is not None and t - 100 < s < t) for u, i, t in rows if u is not None and t is not None}
    assert got == {i: (n, n < 4) for i, n in want.items()}


def test_outbox_resumes(spark, tmp_path):
    """Orders of events: due rows are sent in turn, tried again and given up; a second start goes on from the first one's state."""
    source, out, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    schema = "id long, due timestamp"
    events = spark.read.parquet(f"{DIR}/events.parquet").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("due")).orderBy("due").limit(40)
    first = events.collect()

    def start():
        with keyed.rocks(spark):
            queue = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            run = keyed.outbox(queue, "id", "due", lambda i, attempt: (i + attempt) % 4 == 0, retries=3, backoff_ms=1000).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            assert run.awaitTermination(100)

    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    later = lambda s: (-s, first[-1].due + timedelta(seconds=s))
    put([tuple(r) for r in first])
    start()
    for s in (60, 120, 180, 240):
        put([later(s), tuple(first[0])])  # ticks that move the watermark, and an id that is known
        start()
    got = defaultdict(list)
    for r in spark.read.parquet(out).collect():
        got[r.id].append((r.attempt, r.status))
    for r in first:
        want = []
        for attempt in (1, 2, 3):
            want.append((attempt, "sent" if (r.id + attempt) % 4 == 0 else "dead" if attempt == 3 else "pending"))
            if want[-1][1] == "sent":
                break
        assert sorted(got[r.id]) == want
