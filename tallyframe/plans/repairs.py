"""Registered queries of the repair operators; they join those of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import text as X
from tallyframe.operators import repair as R
from tallyframe.plans.catalog import query

LEXICON = [["A", "N", "R"], ["A", "N"], ["N", "N"], ["R", "A", "R"]]


@query("""WITH f AS (SELECT l_orderkey, l_returnflag, l_suppkey, l_tax >= 0.04 AS has, CASE WHEN l_tax >= 0.04 THEN 4 ELSE 0 END + CASE WHEN l_quantity >= 25 THEN 2 ELSE 0 END + 1 AS score,
 row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem WHERE l_linenumber <> 3 AND l_discount <> 0),
 p AS (SELECT l_orderkey, l_returnflag, count(*) AS n, count(*) FILTER (has) AS ids, max(score) AS hi, min(score) AS lo, arg_max(l_suppkey, score) AS best FROM f WHERE nth <= 2 GROUP BY 1, 2),
 s AS (SELECT l_orderkey, l_returnflag, best, CASE WHEN n IS NULL THEN 'EMPTY' WHEN n = 1 THEN 'SOLE' WHEN ids = 1 THEN 'ID' WHEN hi > lo THEN 'SCORE' ELSE 'AMBIGUOUS' END AS status
 FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) LEFT JOIN p USING (l_orderkey, l_returnflag))
 SELECT l_orderkey, l_returnflag, status, CASE WHEN status <> 'AMBIGUOUS' THEN best END AS pick FROM s""")
def reshaped_singles(t):
    return R.pick_one(t.lineitem, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_suppkey", F.col("l_linenumber") == 3, F.col("l_discount") == 0, F.col("l_tax") >= 0.04, F.col("l_quantity") >= 25)


@query("""WITH m AS (SELECT o_orderkey AS doomed, o_orderkey - 1 AS survivor FROM orders WHERE o_orderkey % 10 = 1),
 b AS (SELECT coalesce(survivor, l_orderkey) AS g, l_orderkey AS was, l_linenumber, l_suppkey FROM lineitem LEFT JOIN m ON l_orderkey = doomed)
 SELECT g AS l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (was <> g) AS moved, count(DISTINCT was) > 1 AND count(DISTINCT l_suppkey) > 1 AS conflict FROM b GROUP BY 1, 2""")
def merged_events(t):
    remap = t.orders.where("o_orderkey % 10 = 1").select(F.col("o_orderkey").alias("doomed"), (F.col("o_orderkey") - 1).alias("survivor"))
    return R.merge_groups(t.lineitem, "l_orderkey", "l_linenumber", "l_suppkey", remap)


@query("""WITH d AS (SELECT l_orderkey, CASE WHEN l_linenumber = 5 THEN 'A_net' ELSE l_returnflag END AS label, count(*) AS n FROM lineitem GROUP BY 1, 2)
 SELECT l_orderkey, label, n, CASE WHEN label IN ('A', 'R') AND EXISTS (SELECT 1 FROM d e WHERE e.l_orderkey = d.l_orderkey AND e.label = 'N')
 AND NOT EXISTS (SELECT 1 FROM d e WHERE e.l_orderkey = d.l_orderkey AND e.label = d.label || '_net') THEN label || '_net' ELSE label END AS new_label FROM d""")
def qualified_labels(t):
    label = F.when(F.col("l_linenumber") == 5, "A_net").otherwise(F.col("l_returnflag"))
    d = t.lineitem.groupBy("l_orderkey", label.alias("label")).agg(F.count("*").alias("n"))
    return R.qualify_bare(d, "l_orderkey", "label", F.col("label").isin("A", "R"), F.col("label") == "N", "_net")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN s_suppkey IS NULL THEN l_suppkey ELSE l_suppkey + 1 END AS id FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_suppkey % 7 = 0)
 SELECT l_orderkey, string_agg(CAST(id AS VARCHAR), '|' ORDER BY l_linenumber, l_suppkey) AS team_key, count(*) FILTER (id <> l_suppkey) AS changed FROM r GROUP BY 1""")
def patched_team_keys(t):
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey")))
    teams = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(listed, lambda x: x["l_suppkey"].cast("string")), "|").alias("team_key"))
    remap = t.supplier.where("s_suppkey % 7 = 0").select(F.col("s_suppkey").cast("string").alias("old"), (F.col("s_suppkey") + 1).cast("string").alias("new"))
    return R.remap_members(teams, "l_orderkey", "team_key", remap)


@query("""WITH n AS (SELECT p_brand, p_size, p_partkey, trim(lower(p_name)) AS n FROM part),
 k AS (SELECT p_brand, p_size, p_partkey, unnest([n, string_split(n, ' ')[1], string_split(n, ' ')[-1], array_to_string([left(w, 1) FOR w IN string_split(n, ' ')], ''), left(n, 3)]) AS token, unnest([1, 2, 3, 4, 5]) AS kind FROM n),
 u AS (SELECT p_brand, p_size, token, kind, min(p_partkey) AS m FROM k GROUP BY ALL HAVING min(p_partkey) = max(p_partkey))
 SELECT p_brand, p_size, token, min(kind) AS kind, arg_min(m, kind) AS p_partkey FROM u GROUP BY 1, 2, 3""")
def mentions(t):
    return R.local_aliases(t.part, ["p_brand", "p_size"], "p_name", "p_partkey")


@query("""WITH w AS (SELECT p_brand, string_split(p_name, ' ')[1] AS w FROM part UNION SELECT p_brand, string_split(p_name, ' ')[-1] FROM part UNION SELECT p_brand, lower(p_type) FROM part),
 p AS (SELECT x.p_brand, x.w AS a, y.w AS b, len(list_intersect(list_distinct(string_split(x.w, '')), list_distinct(string_split(y.w, '')))) AS common,
 least(len(list_distinct(string_split(x.w, ''))), len(list_distinct(string_split(y.w, '')))) AS letters FROM w x JOIN w y ON x.p_brand = y.p_brand AND x.w < y.w)
 SELECT p_brand, a, b, abs(length(a) - length(b)) <= 2 AND 10 * common >= 7 * letters OR starts_with(a, b) OR starts_with(b, a) OR least(length(a), length(b)) >= 4 AND (contains(a, b) OR contains(b, a)) AS family FROM p""")
def surname_families(t):
    words = F.split("p_name", " ")
    w = t.part.select("p_brand", F.explode(F.array(F.element_at(words, 1), F.element_at(words, -1), F.lower("p_type"))).alias("a")).distinct()
    pairs = w.join(w.withColumnRenamed("a", "b"), "p_brand").where("a < b")
    return pairs.select("p_brand", "a", "b", X.surname_family(F.col("a"), F.col("b")).alias("family"))


@query("""WITH p AS (SELECT DISTINCT p_name AS name, string_split(p_name, ' ')[1] AS f, string_split(p_name, ' ')[-1] AS l FROM part),
 d AS (SELECT name, min(s) AS score FROM (SELECT p_name AS name, p_size AS s FROM part WHERE p_name < 'm' UNION ALL SELECT string_split(p_name, ' ')[-1], p_size FROM part) GROUP BY 1),
 m AS (SELECT DISTINCT f AS word, length(f) AS plus FROM p WHERE length(f) >= 4),
 r AS (SELECT p.name, coalesce(d1.score, d2.score, d3.score + m.plus) AS score FROM p LEFT JOIN d d1 ON d1.name = p.name LEFT JOIN d d2 ON p.name LIKE 's%' AND d2.name = 'cold ' || p.l LEFT JOIN m ON m.word = p.f LEFT JOIN d d3 ON d3.name = p.l)
 SELECT l_orderkey, count(*) AS items, count(score) AS resolved, round(sum(coalesce(score, 0)) / count(*), 6) AS mean FROM lineitem JOIN part ON l_partkey = p_partkey JOIN r ON name = p_name GROUP BY 1""")
def sequence_scores(t):
    words = F.split("p_name", " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    direct = t.part.where("p_name < 'm'").select(F.col("p_name").alias("name"), "p_size").union(t.part.select(last, "p_size")).groupBy("name").agg(F.min("p_size").alias("score"))
    aliases = t.part.where("p_name like 's%'").select(F.col("p_name").alias("alias"), F.concat(F.lit("cold "), last).alias("name")).distinct()
    modifiers = t.part.select(first.alias("word"), F.length(first).alias("plus")).where("plus >= 4").distinct()
    items = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_name")
    return R.sequence_scores(items, "l_orderkey", "p_name", direct, aliases, modifiers)


@query("""WITH c AS (SELECT l_orderkey, string_agg('<' || l_returnflag || '>', '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS s FROM lineitem GROUP BY 1)
 SELECT l_orderkey, array_to_string([replace(replace(replace(x, '><', ' '), '<', ''), '>', '') FOR x IN regexp_extract_all(s, '<A><N><R>|<R><A><R>|<A><N>|<N><N>|<[^>]*>')], '|') AS sequence FROM c""")
def merged_sequences(t):
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")))
    c = t.lineitem.groupBy("l_orderkey").agg(F.transform(listed, lambda x: x["l_returnflag"]).alias("tokens"))
    return c.select("l_orderkey", F.array_join(R.merge_longest(F.col("tokens"), LEXICON), "|").alias("sequence"))


@query("""WITH l AS (SELECT user_id, event_id, ts, event_type = 'error' AS bought, CASE event_id % 3 WHEN 0 THEN 'tier1_lifetime' WHEN 1 THEN 'tier0' ELSE 'guest' END AS fallback,
 CASE event_type WHEN 'purchase' THEN 'tier2_annual' WHEN 'signup' THEN 'tier1_annual' WHEN 'click' THEN 'tier2_lifetime' ELSE 'tier0' END AS tier,
 CASE WHEN event_type IN ('purchase', 'signup') THEN ts + INTERVAL 5 DAY END AS expires FROM events WHERE ts <= TIMESTAMP '2024-01-20'),
 x AS (SELECT *, bool_or(bought) OVER (PARTITION BY user_id) AS ever, coalesce(expires <= TIMESTAMP '2024-01-20', false) AS is_over, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM l),
 y AS (SELECT user_id, ever, CASE WHEN NOT is_over THEN tier WHEN fallback LIKE 'tier1%' THEN fallback ELSE 'tier0' END AS tier, CASE WHEN NOT is_over THEN expires END AS expires FROM x WHERE nth = 1),
 z AS (SELECT user_id, ever AND tier IN ('tier0', 'tier1_annual') AS up, tier, expires FROM y)
 SELECT c_custkey AS member, CASE WHEN up THEN 'tier1_lifetime' ELSE coalesce(tier, 'tier0') END AS tier, CASE WHEN NOT up THEN CAST(expires AS DATE) END AS expires FROM customer LEFT JOIN z ON user_id = c_custkey""")
def tiers_in_force(t):
    kind = F.col("event_type")
    tier = F.when(kind == "purchase", "tier2_annual").when(kind == "signup", "tier1_annual").when(kind == "click", "tier2_lifetime").otherwise("tier0")
    nth = F.col("event_id") % 3
    fallback = F.when(nth == 0, "tier1_lifetime").when(nth == 1, "tier0").otherwise("guest")
    expires = F.when(kind.isin("purchase", "signup"), F.col("ts") + F.expr("INTERVAL 5 DAY"))
    ledger = t.events.select(F.col("user_id").alias("member"), F.col("event_id").alias("id"), F.col("ts").alias("at"), tier.alias("tier"), expires.alias("expires"), fallback.alias("fallback"), (kind == "error").alias("bought"))
    return R.tiers_in_force(ledger, t.customer.select(F.col("c_custkey").alias("member")), F.lit("2024-01-20").cast("timestamp")).withColumn("expires", F.col("expires").cast("date"))
