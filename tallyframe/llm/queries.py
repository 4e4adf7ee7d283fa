"""The registered queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import annulus_search, exact_dedup, fast_minhash, gray_simhash, hilbert_shards, html_blocks, language_id, mixing, ordinal_quality, packing, rare_features, secret_scan, trie_join


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.encode("joined", "UTF-8"), 256).alias("base_sha256"), F.col("joined").alias("spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality.grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text")


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.hilbert_shards(table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fast_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rare_features.fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("edited_text", "edited_sha256")


def op11_near_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gray_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_join.variants(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table(spark, sf_dir, "embeddings").where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = rows.select("vec_id", label.alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("embedding"))
    return annulus_search.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_language_id, op3_secret_scan, op4_quality, op5_hilbert_shards, op6_mix_sources, op7_pack, op8_near_dedup, op9_extract_text, op10_fingerprints, op11_near_simhash, op12_spelling_variants, op13_hard_negatives)}


EXACT_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""

NEAR_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END) AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""

# Targets by water level; slots of about 256 words, dealt to sources by a golden-ratio lattice; blocks of a source's shuffled documents,
# laid end to end until its target is reached.
MIX_SQL = r"""
WITH r AS (SELECT row_number() OVER () AS rid, doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM r GROUP BY source),
s AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS nth FROM s0),
sw AS (SELECT *, CAST((nth - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
      sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unfilled, (SELECT sum(source_size) FROM s) AS everything,
      row_number() OVER (ORDER BY cap / weight, nth) AS place FROM sw),
l AS (SELECT arg_min((everything - filled) / unfilled, place) AS level FROM f WHERE (everything - filled) / unfilled * weight <= cap),
t AS (SELECT source, nth, source_size, least(cap, level * weight) AS target, least(CAST(round(least(cap, level * weight)) AS BIGINT), source_size * 3) AS words FROM f, l),
b AS (SELECT *, CASE WHEN words > 0 THEN greatest(1, CAST(round(words / 256) AS BIGINT)) ELSE 0 END AS n FROM t),
e AS (SELECT *, CASE WHEN n > 0 THEN words // n ELSE 0 END AS each, CASE WHEN n > 0 THEN words % n ELSE 0 END AS more, coalesce(sum(n) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM b),
g AS (SELECT sum(n)::BIGINT AS slots FROM b),
p AS (SELECT slots, (SELECT min(x) FROM range(greatest(1, CAST(round(slots * 0.6180339887498949) AS BIGINT)), greatest(1, CAST(round(slots * 0.6180339887498949) AS BIGINT)) + 10000) q(x) WHERE gcd(x, slots) = 1) AS step FROM g),
k AS (SELECT slot, slot * step % slots AS point FROM p, range((SELECT slots FROM g)) q(slot)),
plan AS (SELECT nth, slot, row_number() OVER (PARTITION BY nth ORDER BY slot) - 1 AS rank FROM k JOIN e ON point >= lo AND point < lo + n),
o AS (SELECT r.rid, r.doc_id, r.size, e.*, sum(r.size) OVER (PARTITION BY e.nth ORDER BY CAST('0x' || substr(md5('mix:' || coalesce(r.doc_id, -1)), 1, 15) AS BIGINT), r.doc_id, r.size ROWS UNBOUNDED PRECEDING) - r.size AS pt
      FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source),
c AS (SELECT rid, nth, each, more, pt + z * source_size AS begin, least(pt + z * source_size + size, words) AS finish FROM o, range(4) q(z) WHERE size > 0 AND pt + z * source_size < words),
w AS (SELECT rid, nth, CASE WHEN begin < more * (each + 1) THEN begin // (each + 1) ELSE more + (begin - more * (each + 1)) // each END AS first,
      CASE WHEN finish - 1 < more * (each + 1) THEN (finish - 1) // (each + 1) ELSE more + (finish - 1 - more * (each + 1)) // each END AS last, finish - begin AS part FROM c),
m AS (SELECT rid, min(slot) AS first_slot FROM w JOIN plan ON plan.nth = w.nth AND rank BETWEEN first AND last GROUP BY rid),
h AS (SELECT rid, sum(part)::BIGINT AS taken FROM w GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(first_slot, -1)::BIGINT AS first_slot FROM o LEFT JOIN m USING (rid) LEFT JOIN h USING (rid)
"""

NEGATIVES_SQL = """
WITH f AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(e, lambda x: floor(256 * x::DOUBLE)) AS x FROM f),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS own, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b, score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INT AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.own AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""


def oracles() -> dict[str, str]:
    return {"op1_exact_dedup": EXACT_SQL, "op6_mix_sources": MIX_SQL, "op8_near_dedup": NEAR_SQL, "op13_hard_negatives": NEGATIVES_SQL}
