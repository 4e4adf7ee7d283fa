"""Registered queries of the canonical tables, their repairs and audits, over whole tables: an order's lines are its placements, return flags its
disciplines (N is doubles), suppliers its persons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.operators import audits as A
from tallyframe.operators import canonical as C
from tallyframe.operators import people as P
from tallyframe.operators import shaping as S
from tallyframe.operators import teams as T
from tallyframe.operators import windows as V
from tallyframe.plans.bound import SPELT, spelt
from tallyframe.plans.catalog import query

PART = f"""p AS (SELECT l_orderkey AS event, l_returnflag AS discipline, l_linenumber AS placement, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linenumber ORDER BY l_suppkey, l_partkey, l_quantity) AS participant_order,
 {SPELT.format('l_suppkey')} AS display_name, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 's' || l_suppkey END AS person_id FROM lineitem)"""


def participants(t):
    nth = F.expr("row_number() over (partition by l_orderkey, l_returnflag, l_linenumber order by l_suppkey, l_partkey, l_quantity)")
    p = t.lineitem.select("l_orderkey", "l_returnflag", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity").withColumn("participant_order", nth)
    own = F.when(F.col("l_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("s"), "l_suppkey"))
    return p.select(F.col("l_orderkey").alias("event"), F.col("l_returnflag").alias("discipline"), F.col("l_linenumber").alias("placement"), "participant_order", spelt("l_suppkey").alias("display_name"), own.alias("person_id"))


def disciplines(t):
    return t.lineitem.select(F.col("l_orderkey").alias("event"), F.col("l_returnflag").alias("discipline")).distinct().withColumn("team_type", F.when(F.col("discipline") == "N", "doubles").otherwise("singles"))


@query("""WITH r AS (SELECT l_orderkey AS event, l_returnflag AS name, ((l_linenumber * 1000000 + l_suppkey) * 1000000 + l_partkey) * 4 + ascii(l_returnflag) % 4 AS ord, l_quantity > 25 AS team FROM lineitem),
 d AS (SELECT event, name, min(ord) AS ord, CASE WHEN count(*) FILTER (team) > count(*) FILTER (NOT team) THEN 'doubles' ELSE 'singles' END AS team_type FROM r GROUP BY 1, 2)
 SELECT event, lower(name) AS discipline, name, team_type, row_number() OVER (PARTITION BY event ORDER BY ord) AS sort_order FROM d""")
def discipline_keys(t):
    ord_ = ((F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")) * 1_000_000 + F.col("l_partkey")) * 4 + F.ascii("l_returnflag") % 4
    return C.discipline_table(t.lineitem.select(ord_.alias("ord"), F.col("l_orderkey").alias("event"), F.col("l_returnflag").alias("division"), F.when(F.col("l_quantity") > 25, "team").otherwise("player").alias("competitor_type")))


@query(f"""WITH r AS (SELECT l_orderkey AS event, l_returnflag AS division, l_linenumber AS placement, l_suppkey, l_partkey, l_suppkey * 1000000 + l_partkey AS ord FROM lineitem),
 n AS (SELECT *, unnest([1, 2]) AS pos FROM r), q AS (SELECT event, division, placement, ord, pos, CASE WHEN pos = 1 THEN {SPELT.format('l_suppkey')} WHEN l_partkey % 3 = 0 THEN '' ELSE {SPELT.format('l_partkey')} END AS display_name FROM n)
 SELECT event, division, placement, row_number() OVER (PARTITION BY event, division, placement ORDER BY ord, pos) AS participant_order, display_name FROM q WHERE display_name <> ''""")
def participant_orders(t):
    second = F.when(F.col("l_partkey") % 3 == 0, "").otherwise(spelt("l_partkey"))
    return C.participant_table(t.lineitem.select((F.col("l_suppkey") * 1_000_000 + F.col("l_partkey")).alias("ord"), F.col("l_orderkey").alias("event"), F.col("l_returnflag").alias("division"), F.col("l_linenumber").alias("place"), spelt("l_suppkey").alias("player1"), second.alias("player2")))


@query(f"""WITH {PART} SELECT person_id, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year, count(DISTINCT event) AS event_count, count(*) AS placement_count, count(*) FILTER (placement = 1 AND participant_order = 1) AS wins
 FROM p JOIN orders ON event = o_orderkey WHERE person_id <> '' GROUP BY 1""")
def canonical_person_stats(t):
    return C.person_stats(participants(t), t.orders.select(F.col("o_orderkey").alias("event"), F.year("o_orderdate").alias("year")))


@query(f"""WITH {PART} SELECT * FROM p UNION ALL SELECT event, discipline, placement, 2, '__UNKNOWN_PARTNER__', '' FROM p WHERE discipline = 'N' GROUP BY 1, 2, 3 HAVING count(*) = 1""")
def ghosts_added(t):
    return C.ghost_partners(disciplines(t), participants(t))


@query(f"""WITH {PART}, odd AS (SELECT event, discipline FROM (SELECT event, discipline, placement, count(*) AS n FROM p WHERE discipline = 'N' GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING bool_or(n <> 2)),
 d AS (SELECT p.*, odd.event IS NOT NULL AS deal, row_number() OVER (PARTITION BY p.event, p.discipline ORDER BY placement, participant_order) - 1 AS i FROM p LEFT JOIN odd ON odd.event = p.event AND odd.discipline = p.discipline),
 o AS (SELECT event, discipline, CASE WHEN deal THEN i // 2 + 1 ELSE placement END AS placement, CASE WHEN deal THEN i % 2 + 1 ELSE participant_order END AS participant_order, display_name, CASE WHEN deal AND i // 2 + 1 <> placement THEN 'seq_from:' || placement ELSE '' END AS note, deal FROM d)
 SELECT event, discipline, placement, participant_order, display_name, note FROM o UNION ALL SELECT event, discipline, max(placement), 2, '__UNKNOWN_PARTNER__', 'auto:ghost_partner' FROM o WHERE deal GROUP BY 1, 2 HAVING count(*) % 2 = 1""")
def pairs_in_sequence(t):
    return C.sequential_pairs(disciplines(t), participants(t).drop("person_id"))


@query(f"""WITH {PART}, one AS (SELECT {SPELT.format('s_suppkey // 2')} AS name, min(s_suppkey) AS k FROM supplier GROUP BY 1 HAVING count(*) = 1), s AS (SELECT s_suppkey AS k FROM supplier)
 SELECT event, discipline, placement, participant_order, display_name, CASE WHEN person_id <> '' THEN person_id WHEN one.k IS NOT NULL THEN 's' || one.k END AS person_id FROM p LEFT JOIN one ON one.name = display_name""")
def exact_name_fill(t):
    persons = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("person_id"), spelt(F.floor(F.col("s_suppkey") / 2)).alias("person_name"))
    return C.exact_names(participants(t), persons)


@query("""SELECT o_orderkey AS event, CASE WHEN o_orderkey % 7 = 1 THEN NULL WHEN o_orderkey % 7 = 2 THEN 'net' ELSE o_orderpriority END AS kind, CASE WHEN o_orderkey % 7 = 3 THEN 'moved' ELSE o_orderstatus END AS place FROM orders WHERE o_orderkey % 7 <> 0""")
def event_overrides(t):
    k = F.col("o_orderkey") % 7
    events = t.orders.select(F.col("o_orderkey").alias("event"), F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("place"))
    changes = t.orders.where(k < 4).select(F.col("o_orderkey").alias("event"), (k == 0).alias("exclude"), k.isin(1, 2).alias("has_kind"), F.when(k == 2, "net").alias("kind"), (k == 3).alias("has_place"), F.when(k == 3, "moved").alias("place"))
    return C.overrides(events, changes, ["kind", "place"])


@query(f"""WITH u AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT s_suppkey AS k, lower({SPELT.format('s_suppkey // 3')}) AS name, coalesce(n, 0) AS n FROM supplier LEFT JOIN u ON k = s_suppkey),
 f AS (SELECT k, first_value(k) OVER (PARTITION BY name ORDER BY n DESC, k) AS kept FROM p) SELECT kept AS person_id, count(*) AS placements, count(DISTINCT k) AS merged FROM lineitem JOIN f ON f.k = l_suppkey GROUP BY 1""")
def persons_merged(t):
    persons = t.supplier.select(F.col("s_suppkey").alias("person_id"), F.when(F.col("s_suppkey") % 2 == 0, F.upper(spelt(F.floor(F.col("s_suppkey") / 3)))).otherwise(spelt(F.floor(F.col("s_suppkey") / 3))).alias("person_name"))
    rows = t.lineitem.select(F.col("l_suppkey").alias("person_id"), F.col("l_suppkey").alias("was"))
    kept, moved = C.merge_by_name(persons, rows)
    return moved.join(kept.select("person_id"), "person_id").groupBy("person_id").agg(F.count("*").alias("placements"), F.countDistinct("was").alias("merged"))


@query("""WITH s AS (SELECT DISTINCT l_partkey, l_suppkey, l_quantity FROM lineitem), n AS (SELECT *, lead(l_quantity) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_quantity) AS next_value FROM s)
 SELECT l.l_partkey, l.l_suppkey, l.l_orderkey, l.l_quantity, next_value FROM lineitem l JOIN n ON n.l_partkey = l.l_partkey AND n.l_suppkey = l.l_suppkey AND n.l_quantity = l.l_quantity""")
def record_progression(t):
    return V.progression(t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity"), ["l_partkey", "l_suppkey"], "l_quantity")


@query("""WITH r AS (SELECT o_orderkey, year(o_orderdate) AS year, o_orderpriority AS name, (o_custkey % 20)::VARCHAR AS location, coalesce(n, 0) AS placements, o_orderstatus = 'F' AS dated FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1) ON l_orderkey = o_orderkey)
 SELECT o_orderkey AS id, year, name, location, placements FROM r QUALIFY row_number() OVER (PARTITION BY year, name, location ORDER BY placements > 0 DESC, placements DESC, dated DESC, o_orderkey) = 1""")
def best_of_events(t):
    n = t.lineitem.where("l_linenumber <= 2").groupBy("l_orderkey").agg(F.count("*").alias("placements"))
    rows = t.orders.join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").cast("string").alias("id"), F.year("o_orderdate").alias("year"), F.concat(F.lit(" "), F.upper("o_orderpriority")).alias("name"), (F.col("o_custkey") % 20).cast("string").alias("location"), F.when(F.col("o_orderstatus") == "F", "May 4").otherwise("TBA").alias("date"), "placements")
    return P.best_event(rows).select(F.col("id").cast("long").alias("id"), "year", F.trim("name").alias("name"), "location", F.coalesce("placements", F.lit(0)).alias("placements"))


@query(f"""WITH p AS (SELECT lower({SPELT.format('s_suppkey * 2 // 3')}) AS k, min(s_suppkey) AS pid, count(*) AS n FROM supplier GROUP BY 1), r AS (SELECT DISTINCT c_mktsegment AS club, {SPELT.format('c_custkey % 90')} AS name FROM customer)
 SELECT club, name, CASE WHEN n = 1 THEN pid END AS person_id, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous' ELSE 'none' END AS how FROM r LEFT JOIN p ON p.k = lower(name)""")
def club_person_links(t):
    rows = t.customer.select(F.col("c_mktsegment").alias("club"), F.concat(F.lit(" "), spelt(F.col("c_custkey") % 90)).alias("name"))
    return P.club_links(rows, t.supplier.select(F.col("s_suppkey").alias("person_id"), F.upper(spelt(F.floor(F.col("s_suppkey") * 2 / 3))).alias("person_name")))


@query("""WITH r AS (SELECT l_orderkey AS event, l_returnflag AS d, l_linenumber AS place, l_suppkey AS k, min(l_partkey) AS ord FROM lineitem GROUP BY 1, 2, 3, 4), mine AS (SELECT event, d, place FROM r WHERE k = 3)
 SELECT event, d AS discipline, place AS placement, CASE WHEN count(*) FILTER (k <> 3) = 0 THEN '' WHEN d = 'A' THEN 'Tied with: ' WHEN count(*) FILTER (k <> 3) > 1 THEN 'With partners: ' ELSE 'With partner: ' END AS prefix,
 coalesce(string_agg(k::VARCHAR, ', ' ORDER BY ord, k::VARCHAR) FILTER (k <> 3), '') AS mates FROM r JOIN mine USING (event, d, place) GROUP BY 1, 2, 3""")
def teammates_of(t):
    keys = ["l_orderkey", "l_returnflag", "l_linenumber"]
    rows = t.lineitem.join(t.lineitem.where("l_suppkey = 3").select(*keys).distinct(), keys)
    rows = rows.select(F.col("l_partkey").alias("ord"), F.col("l_orderkey").alias("event"), F.col("l_returnflag").alias("discipline"), F.when(F.col("l_returnflag") == "A", "singles").otherwise("doubles").alias("team_type"), F.col("l_linenumber").alias("placement"), F.col("l_suppkey").cast("string").alias("person_id"), F.col("l_suppkey").cast("string").alias("name"))
    return S.teammates(rows, "3")


@query("""WITH n AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN 'Kim' ELSE 'K.' END AS f, 'Qerson' || (s_suppkey // 4) AS l FROM supplier)
 SELECT a.k AS stub, b.k AS likely FROM n a JOIN n b ON a.l = b.l AND a.k % 2 = 1 AND b.k % 2 = 0 WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = b.k)""")
def abbreviation_clusters(t):
    n = t.lineitem.groupBy("l_suppkey").agg(F.countDistinct("l_orderkey").alias("event_count"))
    name = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "Kim ").otherwise("K. "), F.lit("Qerson"), F.floor(F.col("s_suppkey") / 4).cast("string"))
    p = t.supplier.join(n, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(F.col("s_suppkey").alias("person_id"), name.alias("person_name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("event_count")).alias("event_count"))
    return P.abbreviations(p)


@query(f"""WITH {PART}, r AS (SELECT event, placement, count(*) FILTER (participant_order <= 2 AND NOT (participant_order = 2 AND placement = 2)) AS real, count(*) FILTER (participant_order = 2 AND placement = 2) AS nobody, max(display_name) FILTER (NOT (participant_order = 2 AND placement = 2)) AS name FROM p WHERE discipline = 'N' AND participant_order <= 2 GROUP BY 1, 2)
 SELECT event, 'N' AS discipline, placement, 'MISSING_PARTNER' AS anomaly, name FROM r WHERE real = 1 AND nobody >= 1""")
def doubles_audit(t):
    unknown = (F.col("participant_order") == 2) & (F.col("placement") == 2)
    p = participants(t).where("participant_order <= 2").withColumn("display_name", F.when(unknown, " Unknown").otherwise(F.col("display_name")))
    return T.doubles_anomalies(disciplines(t), p, ["unknown"])


@query(f"""WITH {PART}, two AS (SELECT event, discipline, placement, year(o_orderdate) AS year, min(display_name) AS x, max(display_name) AS y FROM p JOIN orders ON event = o_orderkey GROUP BY 1, 2, 3, 4 HAVING count(*) = 2 AND count(DISTINCT display_name) = 2),
 q AS (SELECT x AS name, y AS partner, year FROM two UNION ALL SELECT y, x, year FROM two), n AS (SELECT name, partner, count(*) AS n, max(year) AS last_year FROM q GROUP BY 1, 2)
 SELECT name, partner, n, last_year, row_number() OVER (PARTITION BY name ORDER BY n DESC, partner) AS nth FROM n QUALIFY nth <= 3""")
def usual_partners(t):
    years = t.orders.select(F.col("o_orderkey").alias("event"), F.year("o_orderdate").alias("year"))
    return T.partners(participants(t).join(years, "event"), ["unknown"])


@query("""WITH e AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'worlds' WHEN 1 THEN 'net' WHEN 2 THEN 'freestyle' ELSE 'mixed' END AS kind, year(o_orderdate) AS year, lower(o_orderpriority) AS name, (o_custkey % 50)::VARCHAR AS location FROM orders),
 k AS (SELECT l_orderkey AS id, max(l_returnflag = 'A') AS net, max(l_returnflag = 'R') AS free, bool_and(l_returnflag = 'N') AS unknown FROM lineitem WHERE l_orderkey % 11 <> 0 GROUP BY 1), j AS (SELECT e.id, kind, net, free, unknown FROM e LEFT JOIN k USING (id))
 SELECT 'worlds_multiple_per_year' AS check_id, year::VARCHAR AS subject FROM e WHERE kind = 'worlds' GROUP BY year HAVING count(*) > 1
 UNION ALL SELECT 'duplicate_event', name FROM e GROUP BY year, name, location HAVING count(*) > 1
 UNION ALL SELECT 'net_without_net', id::VARCHAR FROM j WHERE kind = 'net' AND NOT net UNION ALL SELECT 'freestyle_without_freestyle', id::VARCHAR FROM j WHERE kind = 'freestyle' AND NOT free
 UNION ALL SELECT 'worlds_without_net', id::VARCHAR FROM j WHERE kind = 'worlds' AND NOT net UNION ALL SELECT 'worlds_without_freestyle', id::VARCHAR FROM j WHERE kind = 'worlds' AND NOT free
 UNION ALL SELECT 'all_unknown_divisions', id::VARCHAR FROM j WHERE unknown UNION ALL SELECT 'no_results', id::VARCHAR FROM j WHERE unknown IS NULL""")
def cross_record_checks(t):
    kind = F.element_at(F.array(*map(F.lit, ("worlds", "net", "freestyle", "mixed"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    events = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), kind.alias("event_type"), (F.col("o_custkey") % 50).cast("string").alias("location"), F.year("o_orderdate").alias("year"))
    category = F.when(F.col("l_returnflag") == "A", "net").when(F.col("l_returnflag") == "R", "freestyle").otherwise("unknown")
    return A.cross_record(events, t.lineitem.where("l_orderkey % 11 <> 0").select(F.col("l_orderkey").alias("event"), category.alias("category")))


@query(f"""WITH a AS (SELECT c_custkey AS line, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'a' || (c_custkey % 700) END AS alias, c_custkey % 130 AS k FROM customer), m AS (SELECT alias FROM a WHERE alias <> '' GROUP BY 1 HAVING count(DISTINCT k) > 1),
 f AS (SELECT alias, k, min(line) AS first FROM a GROUP BY 1, 2)
 SELECT line, check_id, severity FROM (SELECT line, 'blank_alias' AS check_id, 'hard' AS severity FROM a WHERE alias = '' UNION ALL SELECT line, 'duplicate_row', 'warn' FROM a JOIN f USING (alias, k) WHERE line > first
 UNION ALL SELECT line, 'alias_conflict', 'hard' FROM a JOIN m USING (alias) UNION ALL SELECT line, 'missing_canonical_pid', 'hard' FROM a WHERE k NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 <> 0) AND k NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 0)
 UNION ALL SELECT line, 'stale_pid_canon_resolves', 'warn' FROM a WHERE k IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 0))""")
def alias_registry_checks(t):
    # Ids of every fifth supplier are gone; of these, every second one's name is still a person's.
    uuid = lambda k: F.concat(F.lit("00000000-0000-5000-8000-"), F.lpad(k.cast("string"), 12, "0"))
    k = F.col("c_custkey") % 130
    aliases = t.customer.select(F.col("c_custkey").alias("line"), F.when(F.col("c_custkey") % 9 == 0, "").otherwise(F.concat(F.lit("a"), F.col("c_custkey") % 700)).alias("alias"), uuid(k).alias("person_id"), spelt(k).alias("person_canon"))
    s = F.col("s_suppkey")
    persons = t.supplier.where(s % 5 != 0).select(uuid(s).alias("person_id"), F.lit("Own Name").alias("person_name")).union(t.supplier.where(s % 10 == 0).select(uuid(s + 1_000_000), spelt("s_suppkey")))
    return A.alias_registry(aliases, persons)
