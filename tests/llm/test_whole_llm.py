"""The training-data operators on small sources, lengths at both sides of a limit, and page layouts."""

import numpy as np

from tallyframe.llm import mixing, rare_features


def test_mix_small_sources(spark):
    """Sources of 10 to 300 words beside a large one: each takes its target to the word, and so do whole documents."""
    rows, at = [], 0
    for name, sizes in {"a": [10], "b": [20], "c": [64], "d": [40, 60], "e": [100] * 3, "f": [7] * 9, "g": [0, 1], "z": [500] * 40}.items():
        for n in sizes:
            rows.append((at, " ".join(f"w{i}" for i in range(n)), name))
            at += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    by = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert (abs(by.taken - by.target) <= 0.5).all() and (by.target[:-1] == 3 * by["size"][:-1]).all()
    whole = mixing.mixed_documents(docs).groupBy("source").count().toPandas().set_index("source")["count"]
    assert [whole[s] for s in "abcdefg"] == [3, 3, 3, 6, 9, 27, 3]


def test_fingerprints_across_the_limit(spark):
    """Near copies at both sides of SHORT, texts that the edit takes below it, and unlike texts of both kinds."""
    rng = np.random.default_rng(3)
    make = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n))[:n]
    base, other, long = make(405), make(420), make(3000)
    texts = {9: base, 8: base[:395], 7: other, 6: make(60), 5: long, 4: long[1000:1300]}
    got = {r.doc_id: r for r in rare_features.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[9].near_next > 0.9 and got[5].near_next > 0.5
    assert got[7].near_edited > 0.5  # 280 of its 420 characters and 60 others
    assert got[8].near_next < 0.1 and got[7].near_next < 0.1 and got[6].near_next < 0.1
