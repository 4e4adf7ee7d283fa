"""Registered queries over all rows, whole texts and all pairs, against brute force on small tables."""

import hashlib
import unicodedata

from pyspark.sql import functions as F

from tallyframe.operators import people as P
from tallyframe.plans import bound, catalog  # noqa: F401  bound registers its queries with the catalog


def put(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_folded_names_whole(spark, tmp_path):
    """Texts beyond 40 characters, with marks, digits, line breaks and other scripts; empty and null ones."""
    texts = {1: "É" * 60 + " Ünd", 2: "Smith, Zoë-Ann 2nd\nŽofie", 3: "  Ἀθῆναι ", 4: "", 5: None, 6: "Plain Name"}
    got = catalog.QUERIES["folded_names"](spark, put(spark, tmp_path, documents=(list(texts.items()), "doc_id long, text string"))).collect()
    fold = lambda x: "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower().strip(" ")
    assert {r.doc_id: r.name for r in got} == {i: None if x is None else fold(x) for i, x in texts.items()} and len(got) == len(texts)


def test_scored_matches_whole(spark, tmp_path):
    """Suppliers of the same nation in any residue, nations without suppliers or with one, null nations, a customer listed twice."""
    customers = [(1, 1), (2, 1), (3, 2), (4, 3), (5, None), (98, 2), (6, 2), (6, 4), (7, 4), (7, 4), (8, 3), (8, 2)]
    suppliers = [(1, 1), (2, 2), (3, 1), (99, None), (50, 4)]
    want = {}
    for c in {c for c, _ in customers}:
        scores = {s: max(100 if a is not None and a == b else 65 for x, a in customers if x == c for y, b in suppliers if y == s) for s, _ in suppliers}
        best = sorted(s for s, v in scores.items() if v == max(scores.values()))
        want[c] = (best[0] if len(best) == 1 else None, max(scores.values()), "MATCHED" if len(best) == 1 else "CONFLICT")
    folder = put(spark, tmp_path, customer=(customers, "c_custkey long, c_nationkey int"), supplier=(suppliers, "s_suppkey long, s_nationkey int"))
    got = catalog.QUERIES["scored_matches"](spark, folder).collect()
    assert {r.c_custkey: (r.match, r.score, r.status) for r in got} == want and len(got) == len(want)
    none = put(spark, tmp_path / "none", customer=(customers, "c_custkey long, c_nationkey int"), supplier=([], "s_suppkey long, s_nationkey int"))
    assert catalog.QUERIES["scored_matches"](spark, none).count() == 0


def test_provenance_grades_whole(spark, tmp_path):
    """Edges of any line count for the ends' degrees; repeated ones once."""
    lines = [(1, 10, 7), (1, 11, 2), (2, 20, 7), (3, 20, 1), (4, 40, 3), (4, 40, 7), (5, 50, 1)]
    edges = {(a, b) for a, b, _ in lines}
    want = set()
    for a, b in edges:
        left, right = sum(x == a for x, _ in edges), sum(y == b for _, y in edges)
        want.add((a, b, "HIGH" if left == right == 1 else "MEDIUM", "several_left" if right > 1 else "several_right" if left > 1 else "one_to_one"))
    folder = put(spark, tmp_path, lineitem=(lines, "l_partkey long, l_suppkey long, l_linenumber int"))
    got = [tuple(r) for r in catalog.QUERIES["provenance_grades"](spark, folder).select("l", "r", "grade", "reason").collect()]
    assert set(got) == want and len(got) == len(want)


def test_person_gate_whole(spark, tmp_path):
    """Every supplier in every form, by answers worked out by hand; a supplier without a number, one listed twice."""
    folder = put(spark, tmp_path, supplier=([(12, "Supplier#12"), (300, "Ana Ruiz"), (300, "Ana Ruiz"), (None, None)], "s_suppkey long, s_name string"))
    got = catalog.QUERIES["person_gate"](spark, folder).collect()
    of = lambda k: {r.name: r.person_like for r in got if r.s_suppkey == k}
    persons = {"Sam Qbc", "  Sam Qbc\t", "Éva Qbc", "Sam Qbc & Bo Dee", "Sam Qbc Orr", "Spinninger Sam Qbc", "Sam Qbc 12", "Theo Sam Qbc", "Sam\u00a0O'Dee Qbc"}
    others = {
        "Supplier#12", "Qbc", "S. Qbc", "S Qbc", "S. Q.", "Qbc Q", "SAM QBC", "sam qbc", "éva Qbc", "Sam Qbc, Lima", "Sam Qbc & Bo/Cy Dee", "Sam Qbc + Bo Dee", "Sam Qbc or Bo Dee", "Round Robin Sam Qbc results", "Round Robin Sam Qbc", "Highest-placed Sam Qbc",
        "Spinning Sam Qbc", "Sam Poe whirlwind", "Sam Qbc *", "Sam Qbc¿", "Sam Qbc José?", "Sam Qbc ??", "US 12", "Sam Qbc 123", "Sam Qbc $5", "Sam Qbc 3-2 over Bo", "Sam Qbc-Prizes", "Sam Qbc Prize", "Sam > Qbc", "Sam : Qbc", "Sam Qbc" + "x" * 21, "The Sam Qbc", 'Sam "Qbc"', "Sam\u00a0Qbc", "", None,
    }
    assert of(12) == dict.fromkeys(persons, True) | dict.fromkeys(others, False)
    assert of(300)["Ana Ruiz"] and of(300)["Sam Qdaa"] and not of(300)["US 300"] and not of(300)["Sam Poe smear"]
    assert of(None) == dict.fromkeys((None, "", "S. Q."), False) and len(got) == 4 * 45 and {r.form for r in got} == set(range(1, 46))


def test_person_gate_other_scripts(spark):
    """White space, digits, letters and marks of all scripts."""
    answers = {"Ana\u00a0Ruiz Bo": True, "\u2003 Bo": False, "Ana Ruiz\n": True, "\tana Ruiz": False, "Ana :\u00a0Bo": False, "Ana $\u0665": False, "Ana re\u017fults": False, "Ana éwhirl": True, "Ana whirl\u0301": False, "\u24d0na Ruiz": False, "Ana R\u00a0": False, "Ana \u0661\u0662\u0663": False, "Ana Ruiz\u00a0*": False}
    rows = spark.createDataFrame(list(answers.items()), "name string, want boolean")
    assert [r.name for r in rows.where(P.is_person_like(F.col("name")) != F.col("want")).collect()] == []


def test_token_subtraction_whole(spark, tmp_path):
    """Bases of several words, in another order, more often than the text has them, empty, in capitals, with hyphens, null; answers worked out by hand. A part listed twice, one without a name."""
    name = "Blurry whirl whirl"
    answers = [
        ("whirl whirl", "Blurry"), ("whirl whirl", "BLURRY"), ("blurry whirl", "WHIRL"), ("whirl blurry whirl whirl", "WHIRL WHIRL Blurry"), ("whirl", "Blurry whirl"), ("", f"{name} {name}"), ("blurry whirl whirl", ""), ("", name),
        ("blurry blurry", " whirl\t"), ("blurry-whirl", "whirl"), ("", "WHIRL BLURRY-WHIRL"), ("blurry whirls", "whirl"), (None, None), (None, name),
    ]
    key = lambda x: None if x is None else "k::" + hashlib.sha1(x.encode()).hexdigest()[:12]
    folder = put(spark, tmp_path, part=([(7, name, "WHIRL"), (7, name, "WHIRL"), (8, None, None)], "p_partkey long, p_name string, p_type string"))
    got = [tuple(r) for r in catalog.QUERIES["token_subtraction"](spark, folder).select("p_partkey", "form", "rest", "key").collect()]
    none = [(8, k, None, key("") if k == 7 else None) for k in range(1, 15)]
    want = 2 * [(7, k, rest, key(base)) for k, (rest, base) in enumerate(answers, 1)] + none
    assert sorted(got, key=str) == sorted(want, key=str)


def test_nested_results_whole(spark, tmp_path):
    """Neighbouring suppliers whose parts' keys are far apart; lines without a number, a supplier or a flag, an event of another flag."""
    lines = [(1, 3, 1_500_000, 2, "A"), (1, 4, 2, 2, "A"), (1, 3, 5, 1, "A"), (1, 9, 1, 7, "N"), (1, 8, 3_000_000_000, 7, "N"), (1, 7, 1, 3, "R"), (1, 5, 1, 3, None), (1, None, 1, 4, None), (2, None, 1, 1, "R"), (2, 6, 1, None, "R"), (3, 1, 1, 1, "X"), (3, 2, 1, 1, "R")]
    folder = put(spark, tmp_path, lineitem=(lines, "l_orderkey long, l_suppkey long, l_partkey long, l_linenumber int, l_returnflag string"))
    got = [tuple(r) for r in catalog.QUERIES["nested_results"](spark, folder).select("event", "nth", "discipline", "placements").collect()]
    assert sorted(got, key=str) == [(1, 1, "Masters Shred", "7:8,9"), (1, 2, "Open Net", "1:3;2:3,4"), (1, 3, "Women Golf", "3:7"), (1, 4, "Women Golf", "3:5"), (2, 1, "Women Golf", None), (3, 1, "Women Golf", "1:2"), (3, 2, "Women Golf", "1:1")]


def test_auto_link_tiers_whole(spark, tmp_path):
    """By answers worked out by hand: suppliers of one nation, of several, listed twice, of a nation that is not listed or null; a customer listed twice under two nations; a legacy account that is not there. 2,000 customers and as many suppliers of one nation are not paired."""
    customers = [(1, 1), (2, 2), (3, 3), (4, 4), (6, 6), (7, 1), (9, 77), (11, 77), (12, 5), (12, 7), (13, None), (14, 8), (5, 1)] + [(i, 20) for i in range(100_001, 102_001)]
    suppliers = [(1, 1), (2, 2), (102, 2), (3, 3), (3, 3), (4, 44), (6, 7), (9, 77), (12, 5), (112, 7), (13, None), (14, 9)] + [(i, 20) for i in range(100_001, 102_001)]
    folder = put(spark, tmp_path, customer=(customers, "c_custkey long, c_nationkey int"), supplier=(suppliers, "s_suppkey long, s_nationkey int"), nation=([(i,) for i in range(25)], "n_nationkey int"))
    df = catalog.QUERIES["auto_link_tiers"](spark, folder)
    got = [tuple(r) for r in df.select("id", "tier", "reason", "person_id").collect()]
    several, nobody, surname = ("tier3", "multiple_name_candidates", None), ("tier3", "no_hp_for_legacy_account", None), ("tier3", "hp_mismatch", None)
    want = [(1, "tier1", None, 1), (2, *several), (3, *surname), (4, "tier3", "no_name_candidate", None), (6, "tier3", "no_name_candidate", None), (7, *nobody), (9, *surname), (11, *nobody), (12, *several), (12, *several), (13, "tier3", "no_name_candidate", None), (14, "tier3", "no_name_candidate", None), (5, "none", None, None)]
    many = [(i, "none", None, None) if i % 5 == 0 else (i, *several) for i in range(100_001, 102_001)]
    assert sorted(got, key=str) == sorted(want + many, key=str)
    assert largest_join(spark, df) < 10_000


def test_membership_scores_whole(spark, tmp_path):
    """By answers worked out by hand: equal names, nicknames, several of either, nobody of the surname. 2,000 members and as many persons of one surname are not paired."""
    customers = [90 * i for i in range(1, 1000)] + [90 * i + 45 for i in range(1000)] + [1, 2, 3, 85, 91, 179]
    suppliers = [80 * i for i in range(3000, 5000)] + [1, 2, 3, 81]
    folder = put(spark, tmp_path, customer=([(i,) for i in customers], "c_custkey long"), supplier=([(i,) for i in suppliers], "s_suppkey long"))
    df = catalog.QUERIES["membership_scores"](spark, folder)
    got = [tuple(r) for r in df.select("id", "status", "person_id", "score").collect()]
    first = {True: min(i for i in suppliers if i % 80 == 0 and i % 3 == 0), False: min(i for i in suppliers if i % 80 == 0 and i % 3)}
    want = [(i, "CONFLICT", first[i % 2 == 0], 100) for i in customers if i % 90 == 0] + [(i, "NO_MATCH", None, 0) for i in customers if i % 90 == 45]
    # Persons 1 (Robert X1), 2 (Robert X2), 3 (Bob X3) and 81 (Bob X1): equal names go first.
    want += [(1, "MATCHED_STRONG", 1, 100), (2, "MATCHED_VARIANT", 2, 75), (3, "MATCHED_VARIANT", 3, 75), (85, "NO_MATCH", None, 0), (91, "MATCHED_STRONG", 1, 100), (179, "NO_MATCH", None, 0)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert largest_join(spark, df) < 10_000


def test_membership_matches_best_of_each(spark):
    """A person with several names counts once, at the best score; aliases beside names; a member listed twice; names without a surname."""
    members = spark.createDataFrame([(1, "Bob Lind"), (2, "Bob Lind"), (3, "Bob A. Lind"), (4, "Bob Lind"), (4, "Robert Lind"), (5, "."), (6, None), (7, "Steve Poe"), (8, "Dave Poe")], "id int, name string")
    persons = spark.createDataFrame([("p1", "Robert Lind"), ("p1", "bob  LIND"), ("p2", "Robert Lind"), ("p3", "Steven Poe"), ("p4", "Stephen Poe"), ("p5", None), ("p6", "Zed Zed")], "person_id string, person_name string")
    got = [tuple(r) for r in P.membership_matches(members, persons, spark.createDataFrame([(2, "p6"), (6, "p1"), (8, "gone")], "id int, person_id string")).collect()]
    want = [(1, "MATCHED_STRONG", "p1", 100), (2, "CONFLICT", "p6", 100), (3, "CONFLICT", "p1", 75), (4, "CONFLICT", "p1", 100), (4, "CONFLICT", "p1", 100), (5, "NO_MATCH", None, 0), (6, "MATCHED_STRONG", "p1", 100), (7, "CONFLICT", "p4", 75), (8, "NO_MATCH", None, 0)]
    assert sorted(got, key=str) == sorted(want, key=str)


def largest_join(spark, df):
    """The most rows that any join of a plan makes."""
    plan, out = df._jdf.queryExecution(), [0]
    plan.toRdd().count()
    todo = [plan.executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        todo += [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else []
        if "Join" in name:
            out.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return max(out)
