"""Registered queries on names, merges, terms in text, pairs, grains, collations, guards, loads and differences of whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyframe.operators import canonical as C
from tallyframe.operators import collation as O
from tallyframe.operators import diff as D
from tallyframe.operators import graph as G
from tallyframe.operators import grains as N
from tallyframe.operators import intervals as I  # noqa: E741
from tallyframe.operators import joins as J
from tallyframe.operators import lexicon as L
from tallyframe.operators import variants as V
from tallyframe.operators.tables import shared_dir
from tallyframe.plans.catalog import query
from tallyframe.sources import markup, parts
from tallyframe.streaming import keyed

# Names.


@query("""WITH n AS (SELECT s_name AS name FROM supplier UNION SELECT c_name FROM customer UNION SELECT p_name FROM part UNION SELECT p_name || ' ' || lower(p_type) FROM part)
 SELECT x.name AS a, y.name AS b FROM n x JOIN n y ON x.name < y.name AND abs(length(x.name) - length(y.name)) <= 1 AND levenshtein(x.name, y.name) = 1""")
def similar_names(t):
    names = t.supplier.select(F.col("s_name").alias("name")).union(t.customer.select("c_name")).union(t.part.select("p_name")).union(t.part.select(F.concat_ws(" ", "p_name", F.lower("p_type"))))
    return V.similar_names(names)


VARIANTS_SQL = r"""
WITH q AS (SELECT p_partkey AS k, p_size AS z, string_split(p_name, ' ') AS w, lower(p_type) AS l FROM part),
q2 AS (SELECT k, z, upper(left(w[1], 1)) || w[1][2:] AS a, upper(left(w[-1], 1)) || w[-1][2:] AS b, upper(left(l, 1)) || l[2:] AS c FROM q),
q3 AS (SELECT k, z, a, CASE WHEN k % 11 = 0 THEN replace(b, 'e', 'é') ELSE b END AS b, c FROM q2),
person AS (SELECT k AS ord, 'p' || k AS id, a || ' ' || b || ' ' || c AS canonical, a, b, c, z FROM q3),
key AS (SELECT *, trim(regexp_replace(lower(strip_accents(canonical)), '[^\p{L}\p{N}]+', ' ', 'g')) AS ckey FROM person),
owner AS (SELECT ckey AS key, arg_min(canonical, ord) AS owner FROM key GROUP BY 1),
display AS (SELECT ord, CASE WHEN ord % 3 = 0 THEN c || ' ' || a || ' ' || b WHEN ord % 3 = 1 THEN upper(canonical) ELSE a || ' ' || c END AS variant, canonical, ckey FROM key WHERE z % 2 = 0),
rated AS (SELECT ord, CASE WHEN ord % 5 = 0 THEN a || '-' || b || ' ' || c WHEN ord % 5 = 1 THEN lower(canonical) ELSE c || '.' END AS variant FROM key),
alias AS (SELECT ord, CASE z % 7 WHEN 0 THEN b || ' ' || a || ' ' || c WHEN 1 THEN upper(canonical) WHEN 2 THEN a || ' ' || c WHEN 3 THEN a[2:] || ' ' || b || ' ' || c WHEN 4 THEN a || ' ' || b || ' Zyx' WHEN 5 THEN b || ' ' || a || ' ' || c || '*' ELSE b || ' ' || c END AS variant,
  CASE ord % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'verified' ELSE '' END AS status, canonical, ckey FROM key),
nk AS (SELECT 1 AS turn, ord, variant, canonical, ckey, 'display_name' AS source FROM display
  UNION ALL SELECT 4, ord, variant, canonical, ckey, 'alias' FROM alias WHERE status <> 'rejected' AND NOT contains(variant, '*')
  UNION ALL SELECT 3, ord, strip_accents(canonical), canonical, ckey, 'manual' FROM key WHERE strip_accents(canonical) <> canonical),
rk AS (SELECT 2 AS turn, ord, variant, owner AS canonical, key AS ckey, 'bap' AS source FROM (SELECT *, trim(regexp_replace(lower(strip_accents(variant)), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM rated) JOIN owner USING (key) WHERE variant <> owner),
every AS (SELECT *, trim(regexp_replace(lower(strip_accents(variant)), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM (SELECT * FROM nk UNION ALL SELECT * FROM rk)),
f AS (SELECT e.*, string_split(key, ' ') AS v, string_split(ckey, ' ') AS c, owner FROM every e LEFT JOIN owner USING (key)),
g AS (SELECT *, CASE WHEN turn < 4 OR (list_sort(list_distinct(v)) = list_sort(list_distinct(c)) AND len(v) = len(c)) THEN 'high' ELSE 'medium' END AS confidence FROM f
  WHERE len(v) >= 2 AND variant <> canonical AND coalesce(owner, canonical) = canonical AND (turn < 4 OR (len(v) <= 4 AND lower(strip_accents(variant)) <> lower(strip_accents(canonical)) AND (v[-1] = c[-1]
    OR (abs(length(v[-1]) - length(c[-1])) <= 2 AND 10 * len(list_intersect(list_distinct(string_split(v[-1], '')), list_distinct(string_split(c[-1], '')))) >= 7 * least(len(list_distinct(string_split(v[-1], ''))), len(list_distinct(string_split(c[-1], '')))))
    OR starts_with(v[-1], c[-1]) OR starts_with(c[-1], v[-1]) OR (least(length(v[-1]), length(c[-1])) >= 4 AND (contains(v[-1], c[-1]) OR contains(c[-1], v[-1]))))))),
h AS (SELECT *, CASE WHEN turn = 3 OR NOT (variant = upper(variant) OR variant = lower(variant)) THEN variant ELSE array_to_string([upper(left(x, 1)) || lower(x[2:]) FOR x IN string_split(variant, ' ')], ' ') END AS final FROM g
  WHERE confidence = 'high' OR (len(list_intersect(list_distinct(v), list_distinct(c))) = least(len(list_distinct(v)), len(list_distinct(c))) AND abs(len(list_distinct(v)) - len(list_distinct(c))) = 1 AND least(len(list_distinct(v)), len(list_distinct(c))) >= 2))
SELECT final AS variant_name, canonical AS canonical_name, confidence, source FROM h WHERE turn = 3 OR final <> canonical QUALIFY row_number() OVER (PARTITION BY key, canonical ORDER BY turn, ord, variant) = 1
"""


@query(VARIANTS_SQL)
def name_variants(t):
    # Persons are the parts, named by their words and kind, some with marks; the lists that name them otherwise are made of the same rows.
    words = F.split("p_name", " ")
    big = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1000))
    p = t.part.select(F.col("p_partkey").alias("ord"), F.col("p_size").alias("z"), big(F.element_at(words, 1)).alias("a"), big(F.element_at(words, -1)).alias("b"), big(F.lower("p_type")).alias("c"))
    p = p.withColumn("b", F.when(F.col("ord") % 11 == 0, F.replace("b", F.lit("e"), F.lit("é"))).otherwise(F.col("b"))).withColumn("name", F.concat_ws(" ", "a", "b", "c")).withColumn("person_id", F.concat(F.lit("p"), "ord"))
    third, fifth, seventh, fourth = F.col("ord") % 3, F.col("ord") % 5, F.col("z") % 7, F.col("ord") % 4
    displays = p.where("z % 2 = 0").select("ord", F.when(third == 0, F.concat_ws(" ", "c", "a", "b")).when(third == 1, F.upper("name")).otherwise(F.concat_ws(" ", "a", "c")).alias("display_name"), "person_id", F.lit("").alias("fallback"))
    rated = p.select("ord", F.when(fifth == 0, F.concat("a", F.lit("-"), "b", F.lit(" "), "c")).when(fifth == 1, F.lower("name")).otherwise(F.concat("c", F.lit("."))).alias("name"))
    alias = F.when(seventh == 0, F.concat_ws(" ", "b", "a", "c")).when(seventh == 1, F.upper("name")).when(seventh == 2, F.concat_ws(" ", "a", "c")).when(seventh == 3, F.concat_ws(" ", F.substring("a", 2, 1000), "b", "c"))
    alias = alias.when(seventh == 4, F.concat_ws(" ", "a", "b", F.lit("Zyx"))).when(seventh == 5, F.concat(F.concat_ws(" ", "b", "a", "c"), F.lit("*"))).otherwise(F.concat_ws(" ", "b", "c"))
    aliases = p.select("ord", alias.alias("alias"), "person_id", F.when(fourth == 0, "rejected").when(fourth == 1, "verified").otherwise("").alias("status"))
    return V.mine_variants(p.select("ord", "person_id", "name"), displays, rated, aliases)


# Terms.

TERMS_SQL = """
WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, p_name, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, p_name, l_quantity) AS no FROM lineitem JOIN part ON l_partkey = p_partkey),
w AS (SELECT l_orderkey AS id, no::INT AS line_no, length(l_linenumber::VARCHAR) + 2 AS lead, l_suppkey % 26 AS letter, p_name, string_split(p_name, ' ')[1] AS first FROM s)
SELECT id, line_no, 'result_trick' AS line_class, (lead + 9)::INT AS start, (lead + 9 + length(p_name))::INT AS stop, p_name AS raw, p_name AS canon, true AS kept FROM w
UNION ALL SELECT id, line_no, 'result_trick', (lead + 9)::INT, (lead + 9 + length(first))::INT, first, 'the ' || first, false FROM w WHERE first <> p_name
"""


def order_lines(t):
    """A text for each order: one line a placement, with a name, a part's name and a score."""
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(". Ab Cdef: "), F.col("p_name"), F.lit(" score "), F.col("l_quantity").cast("int").cast("string"))
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.struct("l_linenumber", "l_suppkey", "p_name", "l_quantity", line.alias("line")).alias("r"))
    return rows.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["line"]), "\n").alias("text"))


def part_terms(t):
    first = F.element_at(F.split("p_name", " "), 1)
    return t.part.select(F.col("p_name").alias("term"), F.lit(None).cast("string").alias("canon")).union(t.part.select(first, F.concat(F.lit("the "), first))).distinct()


@query(TERMS_SQL)
def mined_terms(t):
    return L.mine_terms(order_lines(t), part_terms(t))


@query()
def terms_in_documents(t):
    # Words that many texts have stand for terms beside the parts' names; a brute-force test holds the result.
    turns = t.conversations.select((-(F.col("conv_id") + 1) * 1_000_000 - F.col("turn")).alias("id"), "text")
    texts = t.documents.select(F.col("doc_id").alias("id"), "text").union(turns)
    said = t.benchmark.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("term")).where("char_length(term) > 3").distinct()
    pair = t.benchmark.select(F.regexp_extract(F.lower("text"), r"^(\w+ \w+)", 1).alias("term")).where("term <> ''").distinct()
    lexicon = part_terms(t).union(said.select("term", F.lit(None).cast("string"))).union(pair.select("term", F.lit("opening")))
    return L.mine_terms(texts, lexicon)


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, p_name, l_quantity) AS no FROM lineitem JOIN part ON l_partkey = p_partkey)
 SELECT l_orderkey AS id, no::INT AS line_no, 'Ab Cdef' AS name, q::VARCHAR AS score, CASE WHEN q < 30 THEN 'golf_score' ELSE 'raw_integer' END AS score_class FROM s""")
def scored_lines(t):
    return L.scored_lines(order_lines(t))


# Merges.

MERGES = """m AS (SELECT o_orderkey AS source, o_orderkey - 1 AS target FROM orders WHERE o_orderkey % 10 IN (1, 2, 3) UNION ALL SELECT o_orderkey, o_orderkey + 1 FROM orders WHERE o_orderkey % 100 = 50),
 e AS (SELECT source AS a, target AS b FROM m UNION SELECT target, source FROM m), r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
 s AS (SELECT a AS node, coalesce(min(b) FILTER (b NOT IN (SELECT source FROM m)), min(b)) AS survivor FROM r GROUP BY 1)"""


def merges(t):
    """Orders that are others: chains of three, and two that are each other."""
    key = F.col("o_orderkey")
    return t.orders.where((key % 10).isin(1, 2, 3)).select(key.alias("source"), (key - 1).alias("target")).union(t.orders.where(key % 100 == 50).select(key, key + 1))


@query(f"WITH RECURSIVE {MERGES} SELECT node, survivor FROM s")
def closed_merges(t):
    return G.merge_targets(merges(t))


@query(f"""WITH RECURSIVE {MERGES}, gone AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 97 = 5),
 d AS (SELECT DISTINCT coalesce(survivor, l_orderkey) AS event, l_returnflag AS discipline, l_linenumber AS placement, l_suppkey AS name FROM lineitem LEFT JOIN s ON node = l_orderkey WHERE l_orderkey NOT IN (SELECT k FROM gone) AND coalesce(survivor, l_orderkey) NOT IN (SELECT k FROM gone))
 SELECT event, discipline, placement, name, count(*) OVER (PARTITION BY event, discipline, placement) > 1 AS conflict FROM d""")
def adjudicated_orders(t):
    gone = t.orders.where("o_orderkey % 97 = 5").select(F.col("o_orderkey").alias("event"), F.lit(None).cast("long").alias("target"), F.lit("suppress").alias("action"))
    decisions = merges(t).select(F.col("source").alias("event"), "target", F.lit("merge").alias("action")).union(gone)
    results = t.lineitem.select(F.col("l_orderkey").alias("event"), F.col("l_returnflag").alias("discipline"), F.col("l_linenumber").alias("placement"), F.col("l_suppkey").alias("name"))
    return C.adjudicate(t.orders.select(F.col("o_orderkey").alias("event")), decisions, results)[1]


# Grains and collations.


@query("""WITH l AS (SELECT l_returnflag AS flag, year(l_shipdate) AS year, CASE WHEN year(l_shipdate) < 1996 THEN 'early' ELSE 'late' END AS era, l_suppkey AS k FROM lineitem)
 SELECT 'year' AS grain, flag, year, era, count(DISTINCT k) AS n FROM l GROUP BY flag, year, era UNION ALL SELECT 'era', flag, NULL, era, count(DISTINCT k) FROM l GROUP BY flag, era
 UNION ALL SELECT 'career', flag, NULL, NULL, count(DISTINCT k) FROM l GROUP BY flag UNION ALL SELECT 'all', NULL, NULL, NULL, count(DISTINCT k) FROM l""")
def persons_by_grain(t):
    y = F.year("l_shipdate")
    rows = t.lineitem.select(F.col("l_returnflag").alias("flag"), y.alias("year"), F.when(y < 1996, "early").otherwise("late").alias("era"), "l_suppkey")
    return N.distinct_by_grain(rows, "l_suppkey", ["flag", "year", "era"], {"year": ["flag", "year", "era"], "era": ["flag", "era"], "career": ["flag"], "all": []})


@query("""WITH l AS (SELECT l_suppkey AS person, year(o_orderdate) AS year, CASE WHEN year(o_orderdate) < 1995 THEN 'early' ELSE 'late' END AS era, l_orderkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
 SELECT 'year' AS grain, person, year, era, count(DISTINCT k) AS events FROM l GROUP BY person, year, era UNION ALL SELECT 'era', person, NULL, era, count(DISTINCT k) FROM l GROUP BY person, era
 UNION ALL SELECT 'career', person, NULL, NULL, count(DISTINCT k) FROM l GROUP BY person""")
def events_by_grain(t):
    y = F.year("o_orderdate")
    rows = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("person")).join(t.orders.select("o_orderkey", y.alias("year"), F.when(y < 1995, "early").otherwise("late").alias("era")), F.col("l_orderkey") == F.col("o_orderkey"))
    return N.distinct_by_grain(rows, "l_orderkey", ["person", "year", "era"], {"year": ["person", "year", "era"], "era": ["person", "era"], "career": ["person"]}, "events")


def spelt(column: str, key: str):
    return F.when(F.col(key) % 3 == 0, F.lower(column)).when(F.col(key) % 3 == 1, F.upper(column)).otherwise(F.initcap(F.lower(column)))


@query("""WITH c AS (SELECT CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN upper(c_mktsegment) ELSE upper(left(c_mktsegment, 1)) || lower(c_mktsegment[2:]) END AS segment FROM customer)
 SELECT min(segment) AS segment, count(DISTINCT segment) AS spellings, count(*) AS n FROM c GROUP BY lower(segment)""")
def collated_groups(t):
    return O.groups(t.customer.select(spelt("c_mktsegment", "c_custkey").alias("segment")), "segment")


@query("""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 2 = 0 THEN upper(replace(p_name, 'e', 'é')) ELSE p_name END AS name FROM part)
 SELECT p_partkey, p_brand, name, row_number() OVER (PARTITION BY p_brand ORDER BY lower(strip_accents(name)), p_partkey) AS nth FROM p""")
def collated_order(t):
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper(F.replace("p_name", F.lit("e"), F.lit("é")))).otherwise(F.col("p_name"))
    p = t.part.select("p_partkey", "p_brand", name.alias("name")).withColumn("_c", O.collated("name", "base"))
    return p.withColumn("nth", F.expr("row_number() over (partition by p_brand order by _c, p_partkey)")).drop("_c")


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lower(p_name) WHEN 1 THEN upper(p_name) ELSE p_name END AS name FROM part), d AS (SELECT upper(p_name) AS other, count(*) AS parts FROM part GROUP BY 1)
 SELECT p_partkey, name, other, parts FROM p JOIN d ON lower(name) = lower(other)""")
def collated_join(t):
    third = F.col("p_partkey") % 3
    p = t.part.select("p_partkey", F.when(third == 0, F.lower("p_name")).when(third == 1, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"))
    d = t.part.groupBy(F.upper("p_name").alias("other")).agg(F.count("*").alias("parts"))
    return O.join(p, d, "name", "other")


# Guards.

GUARD_SQL = """WITH h AS (SELECT user_id, event_id, epoch_us(ts) AS "at" FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
 g AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY "at" RANGE BETWEEN 86399999999 PRECEDING AND 1 PRECEDING) AS recent FROM h) SELECT user_id, event_id, "at", recent, recent < 3 AS allowed FROM g"""
DAY = 86_400_000_000


@query(GUARD_SQL)
def sliding_guard(t):
    return keyed.sliding_guard(t.events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))), "user_id", "event_id", "at", DAY, 3)


@query(GUARD_SQL)
def sliding_guard_stream(t):
    spark, path = t._spark, f"{shared_dir(t._spark)}/tallyframe-core/{t._spark.sparkContext.applicationId}/guard-{uuid.uuid4().hex[:12]}"
    source = spark.readStream.schema(t.events.schema).parquet(f"{t._dir}/events.parque[t]").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    with keyed.rocks(spark, idle=False):
        run = keyed.guard_stream(source, "user_id", "event_id", "at", DAY, 3).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.schema("user_id long, event_id long, at long, recent long, allowed boolean").parquet(f"{path}/out")


# Pages, loads, differences.


@query(r"""SELECT page_id, coalesce(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')), '') AS advert FROM pages""")
def nested_fields(t):
    return markup.fields(t.pages, "page_id", "html", {"advert": "ad"})


@query()
def page_elements(t):
    e = markup.elements(t.pages, "page_id", "html")
    return e.groupBy("page_id").agg(F.count("*").alias("elements"), F.max("depth").alias("deepest"), F.count_if(F.col("tag") == "a").alias("links"), F.count_if(F.col("tag") == "p").alias("paragraphs"))


@query("SELECT l_returnflag AS run, count(*) AS n, sum(l_orderkey)::BIGINT AS keys, sum(l_suppkey)::BIGINT AS persons FROM lineitem GROUP BY 1")
def idempotent_load(t):
    # Each run is loaded; one has first failed half way, one comes twice.
    spark, path = t._spark, f"{shared_dir(t._spark)}/tallyframe-core/{t._spark.sparkContext.applicationId}/load-{uuid.uuid4().hex[:12]}"
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_suppkey")
    runs = [r[0] for r in rows.select("l_returnflag").distinct().orderBy("l_returnflag").collect()]  # a few runs
    part = lambda run: rows.where(F.col("l_returnflag") == run).drop("l_returnflag")
    if runs:
        parts.load_part(part(runs[-1]).where("l_orderkey % 2 = 0"), path, runs[-1])
    for run in [*runs, *runs[:1]]:
        parts.load_part(part(run), path, run)
    table = parts.read_parts(spark, path, "l_orderkey long, l_suppkey long")
    return table.groupBy("run").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"), F.sum("l_suppkey").alias("persons"))


def second_version(t):
    """customer after some changes."""
    c = t.customer.where("c_custkey % 101 <> 0")
    c = c.withColumn("c_acctbal", F.when(F.col("c_custkey") % 97 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal"))).withColumn("c_name", F.when(F.col("c_custkey") % 193 == 0, F.upper("c_name")).otherwise(F.col("c_name")))
    new = t.supplier.where("s_suppkey % 50 = 0").select((F.col("s_suppkey") + 100_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    return c.unionByName(new.select(c.columns))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 101 = 0 THEN 'removed' ELSE 'changed' END AS status,
 CASE WHEN c_custkey % 101 = 0 THEN '' WHEN c_custkey % 97 = 0 AND c_custkey % 193 = 0 AND c_name <> upper(c_name) THEN 'c_name,c_acctbal' WHEN c_custkey % 97 = 0 THEN 'c_acctbal' ELSE 'c_name' END AS columns
 FROM customer WHERE c_custkey % 101 = 0 OR c_custkey % 97 = 0 OR (c_custkey % 193 = 0 AND c_name <> upper(c_name)) UNION ALL SELECT s_suppkey + 100000000, 'added', '' FROM supplier WHERE s_suppkey % 50 = 0""")
def table_differences(t):
    return D.table_diff(t.customer, second_version(t), "c_custkey", 500)


@query("""WITH s AS (SELECT l_partkey, l_returnflag, max(l_linenumber) AS v FROM lineitem GROUP BY 1, 2)
 SELECT l_partkey, count(*) AS sources, count(DISTINCT v) AS values, string_agg(l_returnflag || '=' || v, ';' ORDER BY l_returnflag) AS detail FROM s GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT v) > 1""")
def source_disagreements(t):
    said = t.lineitem.groupBy("l_partkey", "l_returnflag").agg(F.max("l_linenumber").alias("v"))
    return D.disagreements(said, "l_partkey", "l_returnflag", "v")


@query("""SELECT 'events' AS name, (SELECT count(*) FROM orders) AS left_rows, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS right_rows, (SELECT count(*) FROM orders) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS equal
 UNION ALL SELECT 'persons', (SELECT count(*) FROM supplier), (SELECT count(DISTINCT l_suppkey) FROM lineitem), (SELECT count(*) FROM supplier) = (SELECT count(DISTINCT l_suppkey) FROM lineitem)""")
def sheet_parity(t):
    return D.parity([("events", t.orders.select("o_orderkey"), t.lineitem.select("l_orderkey").distinct()), ("persons", t.supplier.select("s_suppkey"), t.lineitem.select("l_suppkey").distinct())])


# Partners.


@query("""WITH s AS (SELECT l_orderkey, max(l_suppkey) FILTER (l_linenumber = 1) AS x, max(l_suppkey) FILTER (l_linenumber = 2) AS y FROM lineitem GROUP BY 1),
 u AS (SELECT x, y, year(o_orderdate) AS year FROM s JOIN orders ON l_orderkey = o_orderkey WHERE x IS NOT NULL AND y IS NOT NULL AND x <> y), p AS (SELECT x AS person, y AS partner, year FROM u UNION ALL SELECT y, x, year FROM u),
 a AS (SELECT DISTINCT person, year, person * 10000 + year AS ask FROM p),
 n AS (SELECT ask, partner, count(*) AS n, max(p.year) AS last_year FROM a JOIN p ON p.person = a.person AND p.year BETWEEN a.year - 2 AND a.year GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY n DESC, last_year DESC, partner) AS nth FROM n)
 SELECT ask, partner, n, last_year, CASE WHEN n >= 5 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, nth FROM r WHERE nth <= 5 AND n >= 3""")
def partners_as_of(t):
    pairs = J.slot_pairs(t.lineitem, "l_orderkey", "l_linenumber", "l_suppkey").where("a <> b").join(t.orders.select("o_orderkey", F.year("o_orderdate").alias("year")), F.col("l_orderkey") == F.col("o_orderkey"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("person"), F.col("b").alias("partner")), F.struct(F.col("b").alias("person"), F.col("a").alias("partner")))).alias("p"), "year").select("p.person", "p.partner", "year")
    asks = both.select((F.col("person") * 10000 + F.col("year")).alias("ask"), "person", "year").distinct()
    return I.partners_as_of(asks, both, reach=2)
