"""SimHash links, spelling variants and hard negatives against brute force, on given tables and on hostile rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyframe.llm import annulus_search, gray_simhash, queries, trie_join

DIR = "/root/testdata/sf0.001"
FOLD = {i: i + 32 for i in range(65, 91)}


def classes_of(n, near):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(n):
        for j in near(i):
            root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def linked(rows):
    """(id, fingerprint, component) of rows (id, text), in their order."""
    fp = np.array([simhash(t) for _, t in rows], np.uint64)
    of = classes_of(len(rows), lambda i: np.nonzero(np.bitwise_count(fp ^ fp[i]) <= 4)[0].tolist())
    least = {}
    for (i, _), c in zip(rows, of, strict=True):
        least[c] = min((x for x in (least.get(c), i) if x is not None), default=None)
    return [(i, f"{int(f):016x}", least[c]) for (i, _), f, c in zip(rows, fp, of, strict=True)]


def test_simhash_of_documents(spark):
    docs = pd.read_parquet(f"{DIR}/documents.parquet")
    got = {tuple(r) for r in queries.op11_near_simhash(spark, DIR).collect()}
    assert got == set(linked(list(zip(docs.doc_id.tolist(), docs.text, strict=True)))) and len(got) == len(docs)


@pytest.mark.parametrize("leaf", [16, 1024])
def test_simhash_hostile(spark, monkeypatch, leaf):
    """Nulls, empty and long texts, copies, near copies in a chain, repeated rows, clashing columns; small leaves make an index of several levels."""
    monkeypatch.setattr(gray_simhash, "LEAST_LEAF", leaf)
    monkeypatch.setattr(gray_simhash, "LEAVES", 32 if leaf == 1024 else 1 << 20)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    rows = [(1, None), (2, ""), (3, " \t"), (None, "one two"), (None, None), (4, "One\x0bTWO"), (5, "x " * 60_000), (5, "x " * 60_000)]
    for k in range(300):
        if k % 3 == 0:
            base = [rng.choice(words) for _ in range(rng.choice([2, 5, 300]))]
        else:
            base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((1000 - k, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit("x"), "label": F.lit(1), "component_id": F.lit(None)})
    got = Counter(tuple(r) for r in gray_simhash.near_duplicates(df).collect())
    assert got == Counter(linked(rows))
    assert gray_simhash.near_duplicates(df.limit(0)).count() == 0


def test_gray_forest_is_whole():
    """Every level of the index, leaves of all sizes: the forest connects just what links connect."""
    rng = np.random.default_rng(3)
    bit = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    for n in (1, 2, 15, 16, 17, 257, 1500):
        base = rng.integers(0, 2**63, max(1, n // 3), dtype=np.uint64)
        fp = np.unique(np.concatenate([base, base ^ bit(len(base)) ^ bit(len(base)), base[rng.integers(0, len(base), n)] ^ bit(n) ^ bit(n) ^ bit(n) ^ bit(n) ^ bit(n)]))
        rank = fp.copy()
        for k in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(k)
        rank = np.sort((rank ^ np.uint64(1 << 63)).view(np.int64))
        assert (np.sort(gray_simhash.from_rank(rank)) == fp).all()
        want = classes_of(len(fp), lambda i, fp=fp: np.nonzero(np.bitwise_count(fp ^ fp[i]) <= 4)[0].tolist())
        cut = len(rank) * 2 // 3
        for leaves in ([(rank, None)], [(rank[:cut], None), (rank[cut:], None), (rank[:cut], rank[cut:])]):
            links = defaultdict(list)
            for a, b in leaves:
                if len(a) and (b is None or len(b)):
                    x, y = gray_simhash.forest(a, b, 4)
                    assert len(x) <= len(a) + (0 if b is None else len(b))
                    for i, j in zip(np.searchsorted(fp, x.view(np.uint64)).tolist(), np.searchsorted(fp, y.view(np.uint64)).tolist(), strict=True):
                        links[i].append(j)
            got = classes_of(len(fp), links.__getitem__)
            same = lambda c: sorted(tuple(sorted(g)) for g in pd.Series(range(len(c))).groupby(c).apply(list))
            assert same(got) == same(want)


# Spelling.


def spelled(rows, least=7, count=2, times=10, every=31):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= least and k >= count}
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[i, w[:i] + w[i + 1 :]].add(w)
    for (_, rest), ws in holes.items():
        for w in ws:
            near[w] |= ws - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    form = {w: f for w in words if near[w] and words[f := min(near[w], key=lambda v: (-words[v], v))] >= times * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), k, len(near[w]), words[form[w]] if w in form else None) for w, k in words.items()}


def test_spelling_of_documents(spark):
    docs = pd.read_parquet(f"{DIR}/documents.parquet")
    got = [tuple(r) for r in queries.op12_spelling_variants(spark, DIR).collect()]
    assert len(got) == len(set(got)) and set(got) == spelled(list(zip(docs.doc_id.tolist(), docs.text, strict=True)))


@pytest.mark.parametrize("most", [1, 60, 100_000])
def test_spelling_hostile(spark, most):
    """Prefixes that all words share, chains of forms, very long words, null ids and texts, repeated rows, clashing columns; prefixes are
    taken apart in Spark to the last letter, partly, or not at all."""
    rng = random.Random(5)
    stems = ["prefixed" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(40)] + ["Éclairé", "éclairé", "eclaire", "a" * 3000, "a" * 3001, "a" * 2999 + "b", "wordone", "wordtwo", "abcdefg"]
    rows = [(k % 50, " ".join(rng.choice(stems) for _ in range(30))) for k in range(150)] + [(None, "abcdefg abcdefg abcdefh abcdefh"), (7, None), (8, ""), (9, "abcdefgh " * 200), (9, "abcdefgh " * 200), (10, "abcdefghi " * 2), (11, "12 3-4 __")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(1), "prefix": F.lit(None)})
    got = [tuple(r) for r in trie_join.variants(df, most=most).collect()]
    assert len(got) == len(set(got)) and set(got) == spelled(rows)
    assert trie_join.variants(df.limit(0)).count() == 0


def test_trie_equals_all_pairs():
    rng = random.Random(6)
    for _ in range(150):
        start, letters = rng.choice([0, 1, 2]), rng.choice(["ab", "abc", "abcd"])
        words = list({"xy"[:start] + "".join(rng.choice(letters) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 60))})

        def near(u, v):
            u, v = sorted((u, v), key=len)
            return u != v and (len(u) == len(v) and sum(a != b for a, b in zip(u, v, strict=True)) == 1 or len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v))))

        got = list(trie_join.near_pairs(words, start))
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, u in enumerate(words) for j, v in enumerate(words) if near(u, v)}


# Negatives.


def mined(rows, asks, positives=5, negatives=3):
    """Results for rows (id, label, integers) by trying all."""
    out, rows = [], [r for r in rows if None not in r and None not in r[2]]
    width = max((len(v) for *_, v in rows), default=0)
    rows = [(i, c, [*v, *[0] * (width - len(v))]) for i, c, v in rows]
    for k, (i, c, v) in enumerate(rows):
        if not asks(i):
            continue
        score = lambda w, v=v: max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True))))
        others = sorted(((-score(w), j, m, d) for m, (j, d, w) in enumerate(rows) if m != k), key=lambda x: x[:2])
        for p in [x for x in others if x[3] == c][:positives]:
            fits = [x for x in others if x[3] != c and 50 * -p[0] <= 100 * -x[0] <= 95 * -p[0]][:negatives]
            out += [(i, p[1], r, x[1], -p[0], -x[0]) for r, x in enumerate(fits, 1)]
    return Counter(out)


def test_negatives_of_embeddings(spark):
    """Recall 1 against brute force on the whole table."""
    e = pd.read_parquet(f"{DIR}/embeddings.parquet")
    rows = [(int(i), (int(c) + 1) % 10 if i % 7 == 0 else int(c), [int(np.floor(256 * float(x))) for x in v]) for i, v, c in zip(e.vec_id, e.embedding, e.label, strict=True)]
    got = Counter(tuple(r) for r in queries.op13_hard_negatives(spark, DIR).collect())
    assert got == mined(rows, lambda i: i % 50 == 0) and len(got) > 100


@pytest.mark.parametrize("block", [2, 1024])
def test_negatives_hostile(spark, monkeypatch, block):
    """Copies of one vector in a third of the rows, ties, zero, shorter and huge vectors, labels of one row, nulls, clashing columns."""
    monkeypatch.setattr(annulus_search, "BLOCK", block)
    rng = random.Random(block)
    rows = [(i, rng.randrange(3), [rng.randrange(-9, 10) for _ in range(4)]) for i in range(60)] + [(100 + i, i % 3, [5, 5, 5, 5]) for i in range(40)]
    rows += [(200, 1, []), (201, 2, [3]), (None, 1, [9] * 4), (202, None, [9] * 4), (203, 1, None), (204, 2, [1, None, 2, 3]), (205, 77, [4, 4, 4, 4]), (-10, 1, [4, 5, 5, 4])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<long>").withColumns({"row": F.lit(1), "id": F.lit("x"), "best": F.lit(None), "asks": F.lit(True)})
    assert Counter(tuple(r) for r in annulus_search.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()) == mined(rows, lambda i: i % 10 == 0)
    assert annulus_search.hard_negatives(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_negatives_of_large_numbers(spark):
    """Scores beyond 2**53 are exact, and beyond a long are held within it."""
    rows = [(0, 1, [2**40, 2**39 + 1]), (1, 1, [2**22 + 1, 2**21]), (2, 1, [2**22, 2**21]), (3, 2, [2**22, 3]), (4, 2, [2**22 - 1, 2**20 + 1]), (5, 1, [2**62, 0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<long>")
    assert Counter(tuple(r) for r in annulus_search.hard_negatives(df, F.col("vec_id") == 0).collect()) == mined(rows, lambda i: i == 0)


def test_query_drops_what_is_not_finite(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 0, [0.5, 0.25]), (50, 2, [0.5, nan]), (51, 1, [0.5, inf]), (52, 1, [0.4, None]), (53, 1, [0.5, 0.2]), (54, 2, [0.4, 0.0]), (55, None, [1.0, 1.0]), (56, 1, [0.3, 0.3])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    good = [(0, 1, [128, 64]), (53, 1, [128, 51]), (54, 2, [102, 0]), (56, 2, [76, 76])]
    assert Counter(tuple(r) for r in queries.op13_hard_negatives(spark, str(tmp_path)).collect()) == mined(good, lambda i: i % 50 == 0)


# The mix's schedule, and one row of each key.


def test_prefixes_of_the_mix_have_the_shares(spark):
    """Wherever the mix is cut, its slots have the sources in their shares; another step meets the documents in another order."""
    from tallyframe.llm import mixing

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    got = mixing.mix(docs).toPandas()
    slots = mixing.schedule(spark.createDataFrame([(1, 30), (2, 50), (3, 20)], "nth long, n long"), 100).toPandas().sort_values("slot")
    assert slots.nth.value_counts().to_dict() == {1: 30, 2: 50, 3: 20}
    for n in (10, 25, 50, 77):
        part = slots[:n].nth.value_counts()
        assert all(abs(part.get(k, 0) - n * share) <= 3 for k, share in ((1, 0.3), (2, 0.5), (3, 0.2)))
    taken = got[got.taken > 0].sort_values("first_slot")
    assert (taken.first_slot >= 0).all() and (got[got.taken == 0].first_slot == -1).all()
    # Early documents come from the sources in the shares of their targets, within what one document is.
    share = got.groupby("source", dropna=False).target.first() / got.groupby("source", dropna=False).target.first().sum()
    last = taken.first_slot.max()
    for cut in (0.25, 0.5):
        head = taken[taken.first_slot <= last * cut]
        assert set(head.source.dropna()) >= set(share[share > 0.05].dropna().index) - {None}
    keep = mixing.golden_step
    try:
        mixing.golden_step = lambda n: 1
        other = mixing.mix(docs).toPandas()
    finally:
        mixing.golden_step = keep
    both = got.merge(other, on="doc_id")
    assert (both.taken_x == both.taken_y).all() and (both.first_slot_x != both.first_slot_y).any()


def test_one_row_of_a_hot_key(spark):
    """A third of the rows have no id and one text; column names may hold dots and backticks."""
    from tallyframe.llm import _base

    rows = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("x").alias("a.b"), F.lit(1).alias("c`d"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    kept = spark.createDataFrame([("none",), ("1",), ("2",), ("9999",)], "k string")
    got = _base.only(rows, key, kept)
    assert got.columns == rows.columns and sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "None"]
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
