"""The training-data operators against SQL or brute force, and on hostile rows."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import exact_dedup, fast_minhash, hilbert_shards, html_blocks, language_id, mixing, ordinal_quality, packing, queries, rare_features, secret_scan

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep long, block string, label string"
LONG = "word and another one " * 3000


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, LONG, "en", "a"), (4, LONG.upper(), "en", "a"), (5, "the cat sat on the mat", "en", None), (5, "the cat sat on the mat", "en", None), (None, "le chat noir dort", "fr", "b"), (7, "le chat noir dort", None, "b"), (8, "12 34 !!", "fr", "b"), (9, "x", "fr", "c")]
    return spark.createDataFrame([(*r, None, 1, "b", "l") for r in rows], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DIR}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_equals_sql(spark, name):
    got, want = queries.queries()[name](spark, DIR).toPandas(), duckdb.sql(queries.oracles()[name].replace("FROM documents", f"FROM '{DIR}/documents.parquet'").replace("FROM embeddings", f"FROM '{DIR}/embeddings.parquet'")).df()
    key = sorted(want.columns)
    assert got[key].sort_values(key).astype(str).values.tolist() == want[key].sort_values(key).astype(str).values.tolist()


def test_exact_dedup_small_blocks(spark, hostile):
    """Blocks of three bytes: several rounds of pair naming."""
    got = exact_dedup.exact_dedup(hostile.where("length(text) < 100 or text is null"), block=3).toPandas()
    assert len(got) == 8 and got.kept.sum() == got.text_sha256.nunique() == 5
    assert set(got[got.doc_id == 5].group_size) == {2} and got[got.doc_id == 5].kept.sum() == 1
    assert set(got[got.text_sha256 == hashlib.sha256(b"le chat noir dort").hexdigest()].keep_id) == {7}


def test_hostile_rows(spark, hostile, none):
    n = hostile.count()
    labels = spark.createDataFrame([(2, 0, 0), (3, 1, 0), (5, 1, 1), (9, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for f in (exact_dedup.exact_dedup, language_id.identify_languages, secret_scan.scan_secrets, lambda d: ordinal_quality.grade_documents(d, labels), hilbert_shards.hilbert_shards, mixing.mix, fast_minhash.near_duplicates, rare_features.fingerprints):
        assert f(hostile).count() == n
        assert f(none).count() == 0
    assert packing.pack(hostile).where("piece = 0").count() == n and packing.pack(none).count() == 0
    near = fast_minhash.near_duplicates(hostile).toPandas()
    assert set(near[near.doc_id.isin([3, 4])].component_id) == {3} and set(near[near.n_shingles == 0].doc_id) == {1, 2}


def test_near_common_passage(spark):
    """Many texts that share a passage, near copies among them: links equal those of all pairs."""
    rng = np.random.default_rng(5)
    passage, texts = [f"p{i}" for i in range(40)], []
    for _ in range(40):
        texts.append([*passage, *(f"w{i}" for i in rng.integers(0, 10**6, rng.integers(3, 40)))])
        if len(texts) % 3 == 0:
            copy = list(texts[-1])
            copy[int(rng.integers(len(copy)))] = "new"
            texts.append(copy)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    got = fast_minhash.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).toPandas().sort_values("doc_id")
    assert list(got.component_id) == group and list(got.n_shingles) == [len(x) for x in sets]
    assert 1 < len(set(group)) < len(group)


def test_languages(spark):
    got = queries.op2_language_id(spark, DIR).toPandas().merge(pd.read_parquet(f"{DIR}/documents.parquet"), on="doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()


def test_backpropagation():
    """Gradients against differences."""
    net = language_id.Network.fresh(["a", "b"], hidden=3)
    net.weights = [w.astype(np.float64) for w in net.weights]
    x, mask = language_id.padded([b"abc", b"z"])
    y = np.array([0, 1])
    _, grads = net.gradients(x, mask, y)
    for w, g, at in ((net.weights[0], grads[0], (97, 4)), (net.weights[1], grads[1], (1, 7)), (net.weights[3], grads[3], (2, 0)), (net.weights[4], grads[4], (5, 1))):
        w[at] += 1e-3
        up = net.gradients(x, mask, y)[0]
        w[at] -= 2e-3
        assert abs((up - net.gradients(x, mask, y)[0]) / 2e-3 - g[at]) < 1e-3
        w[at] += 1e-3


def test_secrets(docs):
    extra = ["passſword: abcdefg", "API-key", "Token='abc123X'", "AKIA" + "B" * 16 + "c", "f" * 30 + "é" + "0" * 23, "secret=abc secret: longenough=="]
    texts = [*docs.text, *extra]
    for text, found in zip(texts, secret_scan.scan_block(texts), strict=True):
        want = []
        for k, (pattern, flags, group, least) in enumerate(((secret_scan.RULES[0].pattern, re.I | re.A, 2, 6), (r"AKIA[A-Z0-9]+", 0, 0, 20), (r"[0-9a-f]+", 0, 0, 24))):
            want += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
        assert found == sorted(want)
    assert secret_scan.query_of(r"[0-9a-f]+") is True and b"aki" in secret_scan.asked(secret_scan.query_of(r"AKIA[A-Z]+"))


def test_quality(spark):
    got = queries.op4_quality(spark, "/root/testdata/sf0.01").toPandas().merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    assert (got.kept == (got.quality == 1)).mean() > 0.97


def test_hilbert(spark):
    grid = spark.range(256).select(F.col("id").bitwiseAND(15).alias("x"), F.shiftright("id", 4).alias("y"))
    rows = sorted((r.h, r.x, r.y) for r in grid.select("x", "y", hilbert_shards.hilbert_index([F.col("x"), F.col("y")], 4).alias("h")).collect())
    assert [r[0] for r in rows] == list(range(256)) and all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(rows, rows[1:], strict=False))
    assert all(h == hilbert_shards.reference_index([x, y], 4) for h, x, y in rows)
    got = queries.op5_hilbert_shards(spark, DIR).toPandas()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(packing.default_vocabulary())
    got = queries.op7_pack(spark, DIR).toPandas().sort_values(["doc_id", "piece"])
    for doc_id, g in got.groupby("doc_id"):
        ids = np.array([*known.encode(docs.set_index("doc_id").text[doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert list(g.start) == list(range(0, len(ids), 4096)) and list(g.ids_crc32) == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(g.start, g.length, strict=True)]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 2


def test_pages():
    tree = html_blocks.grow(*html_blocks.examples())
    x, y = html_blocks.examples()
    assert all(html_blocks.classify(tree, tuple(r)) == k for r, k in zip(x, y, strict=True))
    page = '<html><head><title>T</title><style>p{}</style></head><body><nav><a href="/">Home</a></nav><div class="cookie-notice">We use</div><article><h1>Head&amp;line</h1><p><b>One\n two<br><p>Be.<p>Three <a href=x>four</a></article><aside>side</aside><div id="comments"><p>A reader says a lot of words in this remark here</div><form>mail <input></form><footer>&copy; x</footer><script>var t="</p>";</script>'
    assert html_blocks.main_text(page, tree)[0] == "Head&line\nOne two\nBe.\nThree four"
    assert html_blocks.main_text(None, tree)[0] == ""


def test_fingerprints(spark, docs):
    got = queries.op10_fingerprints(spark, DIR).toPandas().sort_values("doc_id", ascending=False).reset_index(drop=True)
    text = docs.set_index("doc_id").text
    for i, r in got.iterrows():
        own, following = text[r.doc_id], text[got.doc_id[(i + 1) % len(got)]]
        k = len(own) // 3
        assert r.edited_sha256 == hashlib.sha256((own[: len(own) - k] + following[:k]).encode()).hexdigest()
    assert got.fingerprint.groupby(got.doc_id.map(text)).nunique().max() == 1
    assert got.near_edited.mean() > 0.5 > 0.05 > got.near_next.mean()


def test_entropy_is_exact():
    flat = np.frombuffer(np.random.default_rng(1).bytes(3000) + b"a" * 500, np.uint8)
    for i in (0, 5, 700, 2990, 3300):
        c = np.bincount(flat[i : i + 64], minlength=256)
        p = c[c > 0] / 64
        assert abs(rare_features.entropies(flat)[i] - 1000 * -(p * np.log2(p)).sum() / 6) < 1.5


def test_mix_near_targets(spark):
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas()
    assert (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (abs(by.taken - by.target) < 1100).all()


def test_clashing_columns(spark):
    """Helper columns keep out of the way of columns of the same names, whatever these hold."""
    names = ["_id", "_sha", "_own", "_nth", "_size", "_src", "_times", "_n", "_again"]
    docs = spark.createDataFrame([(i, t, "s", *(["x"] * len(names))) for i, t in enumerate(["a b c", "A b c", "d e f", None])], "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for f, ids in ((exact_dedup.keep_one, {1, 2, 3}), (fast_minhash.keep_one, {0, 2, 3}), (mixing.mixed_documents, {0, 1, 2})):
        got = f(docs)
        assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == ids and {r["_id"] for r in got.collect()} == {"x"}


def test_pipeline(spark):
    """Every stage on all that the one before it kept, against the model by hand, SQL, and the tokenizer called text by text."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from tallyframe.llm._base import written

    def sql(text, table):
        c = duckdb.connect()
        c.register("documents", table)
        return c.execute(text).df()

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = ordinal_quality.fit(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    outs, frame = [docs.toPandas()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = written(stage(spark, frame, DIR), "test-stage")
        assert frame.columns == docs.columns
        outs.append(frame.toPandas())
    everything, good, once, distinct, mixed = outs

    def tail(text):
        columns, values = ordinal_quality.features(text)
        return 1 / (1 + np.exp(model.thresholds[0] - (model.weights[columns] * values).sum())) if len(columns) else 0.0

    assert sorted(good.doc_id) == sorted(everything.doc_id[[tail(t) >= 0.5 for t in everything.text]]) and 0 < len(good) < len(everything)
    assert sorted(once.doc_id) == sorted(sql(queries.EXACT_SQL, good).query("kept").doc_id) and len(once) < len(good)
    assert sorted(distinct.doc_id) == sorted(sql(queries.NEAR_SQL, once).query("kept").doc_id) and len(distinct) < len(once)
    mix = sql(queries.MIX_SQL, distinct).query("size > 0")
    assert sorted(mixed.doc_id) == sorted(np.repeat(mix.doc_id, np.floor(mix.taken / mix["size"] + 0.5).astype(int)))
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, DIR).toPandas()
    known, want = Tokenizer.from_file(packing.default_vocabulary()), []
    for doc_id, text in zip(mixed.doc_id, mixed.text, strict=True):
        ids = np.array([*known.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want += [(doc_id, at // 4096, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for at in range(0, len(ids), 4096)]
    assert sorted(want) == sorted(packed[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    assert corpus_pipeline.run(spark, DIR).count() == len(packed)
