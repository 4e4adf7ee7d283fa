"""The registered queries against brute force, and the operators on hostile, skewed and empty tables."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import _base, exact_dedup, fast_minhash, hilbert_shards, html_blocks, language_id, mixing, ordinal_quality, packing, queries, rare_features, secret_scan

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DIR}/documents.parquet")


# Quality, languages, secrets.


def test_quality_by_hand(spark, docs):
    """Every document's expected grade and tail from the model's weights."""
    model = ordinal_quality.fit(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))
    got = {r.doc_id: r for r in queries.op4_quality(spark, DIR).collect()}
    assert len(got) == len(docs) and model.grades == [0, 1, 2]
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        words = (text or "").encode().split()
        pieces = lambda ws: [w[i : i + 16] for w in ws for i in range(0, len(w), 16)]
        every, distinct = pieces(words), pieces(set(words))
        z = sum(model.weights[ordinal_quality.shape_of(p)] for p in every) / len(every) + sum(model.weights[(1 << 14) + ordinal_quality.word_of(p)] for p in distinct) / math.sqrt(len(distinct)) if words else None
        tails = [1 / (1 + math.exp(t - z)) for t in model.thresholds] if words else [0, 0]
        assert abs(got[doc_id].tail_prob - tails[0]) < 1e-6 and abs(got[doc_id].expected_grade - sum(tails)) < 1e-6 and got[doc_id].kept == (got[doc_id].tail_prob >= 0.5)


def test_quality_columns_and_sample(spark):
    """All columns pass, whatever they are; few labels, labelled twice, an id with two texts; none at all."""
    rows = spark.createDataFrame([(i, "good clean words here" if i % 2 else "%% ## junk!! 99", {"k": i}, [i]) for i in range(40)] + [(None, None, {}, []), (3, "", {}, None)], "doc_id long, text string, kept map<string,long>, expected_grade array<long>")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(1, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    got = ordinal_quality.keep_good(rows, labels)
    assert got.columns == rows.columns and {r.doc_id for r in got.collect()} == set(range(1, 40, 2))
    assert ordinal_quality.keep_good(rows, labels.limit(0)).count() == 42 and ordinal_quality.keep_good(rows.limit(0), labels).count() == 0


def test_language_network_by_hand():
    """Pooled probabilities against the network read one byte at a time, within a lane and over several."""
    texts = [b"the cat", b"", b"x", bytes(range(97, 123)) * 60]
    net = language_id.train([("a", b"the cat sat on the mat " * 9), ("b", b"der hund lag im gras " * 9)], steps=20)
    soft = lambda x: x / (1 + abs(x))

    def states(raw, e, u):
        h, out, n = np.zeros(len(u)), [], len(u)
        for byte in raw:
            a, g = e[byte], h @ u
            z, r = 0.5 + 0.5 * soft((a + g)[:n] / 1), 0.5 + 0.5 * soft((a + g)[n : 2 * n])
            m = soft(a[2 * n :] + r * g[2 * n :])
            h = m + z * (h - m)
            out.append(h)
        return out

    def label(raw):
        ef, uf, eb, ub, w, b = (x.astype(float) for x in net.weights)
        both = [np.concatenate(x) for x in zip(states(raw, ef, uf), states(raw[::-1], eb, ub)[::-1], strict=True)]
        s = np.array(both) @ w + b
        p = np.exp(s - s.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    for raw, got in zip(texts, net.pooled(texts), strict=True):
        if not raw:
            assert not got.any()
            continue
        lane, context = language_id.LANE, language_id.CONTEXT
        parts = [label(raw[max(0, k - context) : k + lane + context])[min(k, context) :][:lane] for k in range(0, len(raw), lane)]
        assert np.allclose(got, np.concatenate(parts).mean(axis=0), atol=1e-4)


def test_secret_digests(spark, docs):
    rules = ((r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 6), (r"AKIA[A-Z0-9]+", 0, 0, 20), (r"[0-9a-f]+", 0, 0, 24))
    got = {r.doc_id: r for r in queries.op3_secret_scan(spark, DIR).collect()}
    for doc_id, text in zip(docs.doc_id, docs.text, strict=True):
        spans = sorted((m.start(), k, m.end()) for k, (p, f, g, n) in enumerate(rules) for m in re.finditer(p, text or "", f) if len(m[g]) >= n)
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        r = got[doc_id]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans == joined and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))


# Pages.


def test_words_and_links_decide():
    """Where tags say nothing, and within an article, what is kept hangs on words and links, also those of neighbours."""
    tree = html_blocks.grow(*html_blocks.examples())
    kept = lambda page: html_blocks.main_text(page, tree)[0].split("\n")
    story = "<p>" + "a sentence of some length that goes on for a while and then ends here " * 3 + "</p>"
    menu = "".join(f'<div><a href="/{w}">{w}</a></div>' for w in ("Home", "News", "Shop"))
    assert len(kept(menu + story)) == 1 < len(kept(menu.replace("<a", "<i").replace("</a", "</i") + story))
    assert kept(f"<article>{story}<p><a>Read on</a></p><p><a>Share</a></p></article>") == kept(f"<article>{story}</article>")
    assert kept(f"<article>{story}<p>Read on</p></article>")[-1] == "Read on"
    x, y = html_blocks.examples()
    flags = [html_blocks.FEATURES.index(f) for f in ("section", "article", "heading")]
    blind = x.copy()
    blind[:, [i for i in range(x.shape[1]) if i not in flags]] = 0
    assert sum(html_blocks.classify(tree, r) == c for r, c in zip(x, y, strict=True)) > sum(html_blocks.classify(html_blocks.grow(blind, y), r) == c for r, c in zip(blind, y, strict=True)) + 20


def test_pages_without_help(spark):
    """The article's blocks by hand; then the same pages with elements that say nothing, and no class names."""
    pages = pd.read_parquet(f"{DIR}/pages.parquet")
    tree = html_blocks.grow(*html_blocks.examples())
    got = {r.page_id: r for r in queries.op9_extract_text(spark, DIR).collect()}
    hits = size = want_size = 0
    for page_id, page in zip(pages.page_id, pages.html, strict=True):
        inner = page[page.index("<article>") : page.index("</article>")]
        blocks = [" ".join(html_blocks.html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:article|p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert got[page_id].text == want and got[page_id].n_chars == len(want)
        plain = html_blocks.main_text(re.sub("<(/?)(?:article|nav|footer)>", r"<\1div>", page).replace('class="ad"', 'class="x1"'), tree)[0]
        a, b = Counter(plain.split()), Counter(want.split())
        hits, size, want_size = hits + sum((a & b).values()), size + sum(a.values()), want_size + sum(b.values())
    assert hits / size > 0.97 and hits / want_size > 0.97


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<form><article><h1>A b</h1><p>one two three four<p>x</article></form>", "A b\none two three four\nx"),
        ("<article><p>&<b>amp;</b> &amp;lt; &nbsp; x</article>", "&amp; &lt; x"),
        ("<article><p>" + "İ" * 9 + "<SCRIPT>x</Script >Hello <style>p</style>world</article>", "İ" * 9 + "\nHello\nworld"),
        ('<div class="has-sidebar"><article><p>Hi there you<div class="share-price">Price is 4</div></article></div>', "Hi there you\nPrice is 4"),
        ('<article><p>some words <a href="x>linked</a> tail</article>', "some words linked tail"),
        ("<article><p>x <button>Share</button> y <math>a+b</math> <video>no film</video></article>", "x y a+b no film"),
        ("<main><p>Main text here<aside>side</aside><p>more</main><p>after", "Main text here\nmore"),
        ("<article><p>Story<article><p>A reader says so</article></article>", "Story"),
        ("a < b and 1 <2 " * 12, " ".join(["a < b and 1 <2"] * 12)),
        ("<!-- never closed <p>x", ""), ("", ""), (None, ""), ("<title>t", ""), ("<p", ""),
    ],
)
def test_odd_pages(page, text):
    assert html_blocks.main_text(page, html_blocks.grow(*html_blocks.examples()))[0] == text


def test_pages_are_read_in_linear_time():
    tree = html_blocks.grow(*html_blocks.examples())
    for unit in ('<a "', "<div>", "<b><p>x", "<", '<a href="x>', "<!", "&", """<a '"> """, "<script>", "<textarea>", "</p>", "<p>"):
        began = time.time()
        html_blocks.main_text(unit * (600_000 // len(unit)), tree)
        assert time.time() - began < 20, unit


def test_pages_table(spark):
    rows = [(1, "u", "<p>" + "word " * 60), (1, "u", "<p>" + "word " * 60), (None, None, None), (3, "", "")]
    got = html_blocks.extract_text(spark.createDataFrame([(*r, "t", 9) for r in rows], "page_id long, url string, html string, text string, blocks int"))
    assert sorted((str(r.page_id), r.n_chars, r.kept_blocks) for r in got.collect()) == [("1", 299, 1), ("1", 299, 1), ("3", 0, 0), ("None", 0, 0)]
    assert html_blocks.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# Shards, mix, packing.


def test_shards_by_hand(spark, docs):
    """Cells, order along the curve, shards and slots; and how many shards a lookup by source must open."""
    got = queries.op5_hilbert_shards(spark, DIR).toPandas().set_index("doc_id")
    d = docs.assign(size=[len((t or "").encode()) + 1 for t in docs.text], crc=[zlib.crc32((t or "").encode()) for t in docs.text])
    bits, n = hilbert_shards.bits_for(len(d)), len(d)
    key = {}
    for c in ("source", "lang", "size"):
        values = d[c].map(lambda v: (0, b"") if v is None else (1, v.encode() if isinstance(v, str) else v))
        below = {v: sum(x < v for x in values) for v in set(values)}
        d[f"{c}_cell"], key[c] = [min(2**bits - 1, int(below[v] * 2**bits / n)) for v in values], values
    d["h"] = [hilbert_shards.reference_index(list(x), bits) for x in zip(d.source_cell, d.lang_cell, d.size_cell, strict=True)]
    d["s"], d["l"] = key["source"], key["lang"]
    d = d.sort_values(["h", "s", "l", "size", "crc", "doc_id"]).reset_index(drop=True)
    each, more = divmod(n, 16)
    shards = [s for s in range(16) for _ in range(each + (s < more))]
    assert list(got.loc[d.doc_id, "shard"]) == shards and list(got.loc[d.doc_id, "slot"]) == [i for s in range(16) for i in range(each + (s < more))]
    assert list(got.loc[d.doc_id, "hilbert"]) == list(d.h) and list(got.loc[d.doc_id, "text_crc32"]) == list(d.crc) and set(got.law) == {"rows"}
    opened = d.assign(shard=shards).groupby("source").shard.nunique()
    assert opened.mean() < 9  # of 16; by chance nearly all of them


def test_long_common_prefixes_fall_in_many_cells(spark):
    rows = spark.createDataFrame([(i, "t", "en", f"https://site{i % 50:02d}") for i in range(500)], "doc_id long, text string, lang string, source string")
    found = hilbert_shards.hilbert_shards(rows)
    assert found.select("hilbert").distinct().count() >= 2 ** hilbert_shards.bits_for(500)


@pytest.mark.parametrize("n", [1, 2, 7, 100, 4097])
def test_schedule(spark, n):
    """Every point once, each source's slots exactly, and any run of slots near the shares."""
    sizes = {1: n - 2 * (n // 3) - (n > 9), 2: n // 3, 3: n // 3, 4: int(n > 9), 5: 0}
    plan = mixing.schedule(spark.createDataFrame(list(sizes.items()), "nth long, n long"), n).toPandas().sort_values("slot")
    assert list(plan.slot) == list(range(n)) and plan.nth.value_counts().to_dict() == {k: v for k, v in sizes.items() if v}
    for nth, g in plan.groupby("nth"):
        assert list(g["rank"]) == list(range(len(g)))
        ahead = (plan.nth == nth).cumsum().to_numpy() - sizes[nth] / n * np.arange(1, n + 1)
        assert np.abs(ahead).max() < 2 + math.log2(n + 1) / 2


def test_mix_hostile(spark):
    """Null and repeated rows, a lone long document, sources without words; rows keep their columns."""
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "d e", None), (None, "d e f g", None), (5, None, "y"), (6, "", "z"), (7, "w " * 5000, "long")]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, taken int")
    got = mixing.mix(docs).toPandas()
    assert len(got) == 7 and (got.taken <= 3 * got["size"]).all()
    by = got.fillna({"source": "?"}).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) <= 0.5).all()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixing.mixed_documents(docs.limit(0)).count() == 0
    times = Counter(r.taken for r in mixed.collect())
    assert times[0] == times[1] == 3 and times[2] == times[3] == 3 and times[4] == times[5] == 0


def test_sums_are_indexed():
    rng = np.random.default_rng(2)
    lengths = np.unique(rng.integers(1, 60, 25))
    sums, have = packing.Sums(lengths, 60), np.zeros(61, np.int64)
    have[lengths] = 1
    for total in range(61):
        assert sorted(map(tuple, sums.of_two(total, have))) == sorted((a, b) for a in lengths for b in lengths if b <= a and a + b == total)
        assert {tuple(sorted(x)) for x in sums.of_three(total, have)} == {tuple(sorted((a, b, c))) for a in lengths for b in lengths for c in lengths if a + b + c == total}


def test_plans_use_up_what_there_is():
    rng = np.random.default_rng(3)
    for most in (40, 3000, 4096):
        counts = dict(zip(*(x.tolist() for x in np.unique(rng.integers(1, most + 1, 5000), return_counts=True)), strict=True))
        out = packing.plan(counts)
        used = Counter()
        for use, times in out:
            assert sum(n * k for n, k in use.items()) <= 4096
            for n, k in use.items():
                used[n] += k * times
        assert used == counts and sum(t for _, t in out) <= -(-sum(n * k for n, k in counts.items()) // 4096) * 1.01 + 1


def test_runs_join_to_the_tokenizers_ids():
    rng = np.random.default_rng(4)
    signs = [*"abeAEst019.,*'\"<|> \n&;é", "́", "ß", "中", "’", "İ", "<|endoftext|>", "'s", "'ll", "...", "ﬁ"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 25))) for _ in range(3000)]
    runs = packing.Runs(packing.default_vocabulary())
    assert runs.divides and runs.plain
    for text, ids in zip(texts, packing.encode(texts, runs), strict=True):
        assert list(ids) == [*runs.known.encode(text, add_special_tokens=False).ids, 1], text


# Duplicates.


def test_hot_blocks_are_thinned(spark):
    """Blocks that come from several tasks go the way of hot ones, with the same names."""
    rows = spark.createDataFrame([(i, "abcdef" * (i % 4) + ("x" if i % 5 == 0 else "")) for i in range(60)], "doc_id long, text string").repartition(6)
    plain, thin = (exact_dedup.identities(rows, block=3, many=m).toPandas() for m in (1000, 1))
    groups = lambda t: sorted(sorted(g.doc_id) for _, g in t.groupby(["blocks", "name"]))
    assert groups(plain) == groups(thin) and len(groups(thin)) == 8


def test_keepers_are_the_same_each_time(spark):
    """Rows equal in id and text but not in others; null ids; words alike but not the text."""
    rows = [(1, "A b", "x", 1), (1, "a B", "y", 2), (None, "c d", "x", 3), (None, "c d", "y", 4), (2, "c  d", "x", 5), (3, None, "x", 6), (3, "", "y", 7), (None, "z z", "q", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int")
    once = [sorted(r.row for r in exact_dedup.keep_one(docs.repartition(n)).collect()) for n in (1, 5)]
    assert once[0] == once[1] and len(once[0]) == 5 and {5, 8} < set(once[0])
    near = [sorted(r.row for r in fast_minhash.keep_one(docs.repartition(n)).collect()) for n in (1, 5)]
    assert near[0] == near[1] and {5, 8} < set(near[0]) and not {3, 4} & set(near[0])
    for keep in (exact_dedup.keep_one, fast_minhash.keep_one):
        assert keep(docs.limit(0)).count() == 0 and keep(docs).columns == docs.columns


# Fingerprints.


def by_hand(texts: list[str], edits: list[str]) -> list[np.ndarray]:
    """Features, filters: window by window."""
    w, run, votes, least = rare_features.WIDTH, rare_features.RUN, rare_features.VOTES, rare_features.LEAST

    def windows(text):
        raw = text.encode().ljust(w, b"\0") if text else b""
        return [raw[i : i + w] for i in range(len(raw) - w + 1)]

    def entropy(win):
        s = sum(round(c * np.log2(c) * 4096) for c in Counter(win).values())
        top = round(w * np.log2(w) * 4096)
        return (top - s) * 1000 // top

    counts = Counter(entropy(x) for t in texts for x in windows(t))
    rank = {e: i for i, e in enumerate(sorted(range(1001), key=lambda e: (counts[e], e)))}
    out = []
    for text in [*texts, *edits]:
        wins = windows(text)
        got = Counter()
        for i in range(len(wins)):
            best = min(((rank[entropy(wins[j])], j) for j in range(i, min(i + run, len(wins))) if entropy(wins[j]) >= least), default=None)
            if best:
                got[best[1]] += 1
        chosen = [i for i in range(len(wins)) if got[i] >= votes] or [i for i in range(len(wins)) if got and got[i] == max(got.values())] or [0][: len(wins)]
        h = [int(rare_features.hashed(np.frombuffer(wins[i], np.uint8).reshape(1, -1))[0]) for i in chosen]
        h = list(dict.fromkeys(h))
        filters = np.zeros((-(-len(h) // 160), 2048), np.uint8)
        for i, x in enumerate(h):
            for k in range(5):
                filters[i // 160, x >> 11 * k & 2047] = 1
        out.append(np.packbits(filters, axis=1) if len(h) else np.zeros((0, 256), np.uint8))
    return out


def test_fingerprints_by_hand(spark):
    """Texts of all lengths, and ids that lie far apart, repeat or are null; blocks of a few rows each."""
    rng = np.random.default_rng(6)
    make = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))[:n]
    rows = [(2**62, make(3000)), (5, make(401)), (4, make(17)), (3, "ab"), (2, ""), (1, None), (0, "a" * 500), (-(2**40), make(60)), (None, make(90))]
    want_texts = [t or "" for _, t in rows]
    follow = want_texts[1:] + want_texts[:1]
    edits = [t[: len(t) - len(t) // 3] + f[: len(t) // 3] for t, f in zip(want_texts, follow, strict=True)]
    prints = by_hand(want_texts, edits)
    before, rare_features.PER_BLOCK = rare_features.PER_BLOCK, 600
    try:
        got = {r.doc_id: r for r in rare_features.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    finally:
        rare_features.PER_BLOCK = before
    assert len(got) == len(rows)
    for i, (doc_id, _) in enumerate(rows):
        own, edit, following = prints[i], prints[len(rows) + i], prints[(i + 1) % len(rows)]
        r = got[doc_id]
        assert r.edited_text == hashlib.sha256(edits[i].encode()).hexdigest() and r.n_chars == len(want_texts[i])
        assert r.fingerprint == rare_features.written_out(own) and r.edited_fingerprint == rare_features.written_out(edit)
        assert abs(r.near_edited - rare_features.likeness(own, edit)) < 1e-9 and abs(r.near_next - rare_features.likeness(own, following)) < 1e-9


def test_fingerprint_blocks_are_even(spark):
    rows = spark.range(3000).select((F.when(F.col("id") == 0, F.lit(2**62)).otherwise(F.col("id"))).alias("doc_id"), F.lit("some text of forty characters and more..").alias("text"))
    before, rare_features.PER_BLOCK = rare_features.PER_BLOCK, 30_000
    try:
        n = rare_features.in_blocks(rows).where("not extra").groupBy("block").count().toPandas()["count"]
    finally:
        rare_features.PER_BLOCK = before
    assert n.sum() == 3000 and len(n) >= 10 and n.max() < 600


# The pipeline.


@pytest.mark.parametrize("rows", ["hostile", "empty"])
def test_pipeline_on_hostile_rows(spark, tmp_path, rows):
    import corpus_pipeline

    good = "the quick brown fox jumps over a lazy dog and runs home again "
    table = [(1, good, "en", "a", 9), (2, good.upper(), "en", "a", 9), (3, good + "now", None, "b", None), (4, None, None, None, None), (5, "", "en", "a", 0), (None, good * 2000, "en", None, 1), (7, "%%%% #### 0000 !!!!", "en", "b", 1), (7, "%%%% #### 0000 !!!!", "en", "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(table if rows == "hostile" else [], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (7, 0, 1), (None, None, None), (99, 1, 1)] if rows == "hostile" else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = _base.written(stage(spark, frame, str(tmp_path)), "hostile")
        assert frame.columns == schema.replace(",", "").split()[::2], name
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(got) == 0 if rows == "empty" else 7 not in set(got.doc_id) and len(got) > 0


def test_shared_folder_is_asked_for(spark):
    class Cluster:
        conf = spark.conf

        class sparkContext:  # noqa: N801
            master = "spark://there:7077"
            getConf = staticmethod(spark.sparkContext.getConf)

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            _base.shared_dir(Cluster)


def test_rules_without_trigrams_scan_all():
    assert secret_scan.query_of("[0-9a-f]+") is True


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div><a href="/a">Home</a> <a href="/b">News</a> <a href="/c">Shop</a> <a href="/d">Help</a> <a href="/e">Jobs</a> <a href="/f">Press</a> <a href="/g">Maps</a></div>' + "<p>" + "some plain words of a story that goes on for a while " * 5 + "</p>", "some plain words of a story that goes on for a while " * 5),
        ('<div><a href="/a">Home</a> | <a href="/b">News</a> | <a href="/c">Shop</a> | <a href="/d">Help</a> | <a href="/e">Jobs</a></div>' + "<p>" + "some plain words of a story that goes on for a while " * 5 + "</p>", "some plain words of a story that goes on for a while " * 5),
        ('<article><h1>Head</h1><p>First words of it</p><div class="cookie-notice"><p>We use cookies here</p></div><div class=\'promo Advert\'>Buy our great shoes now</div><p>Last words of it</p><section id="comments"><p>A reader says so</p></section></article>', "Head\nFirst words of it\nLast words of it"),
        ('<article><p>Words <span class="ad">kept in line</span> here</p><div class="share-price">Price is 4</div></article>', "Words kept in line here\nPrice is 4"),
    ],
)
def test_menus_notices_adverts_comments(page, text):
    assert html_blocks.main_text(page, html_blocks.grow(*html_blocks.examples()))[0] == " \n".join(text.split(" \n")).strip()


def test_linked_words_are_counted_in_place():
    page = '<p><a href="#">one</a> <a href="#">two</a>, <a href="#">thr</a>ee four - five</p>'
    (block,) = html_blocks.blocks_of(page)
    assert block.words == 5 and block.density == 2 / 5
