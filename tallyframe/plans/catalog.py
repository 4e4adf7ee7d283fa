"""Registered queries over the star schema: orders stand for events, their lines for results, suppliers and customers for persons.

Each is (DataFrame function, the same in SQL). Sums of doubles are rounded where their order could show."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import text as X
from tallyframe.operators import canonical as C
from tallyframe.operators import careers as Y
from tallyframe.operators import clubs as K
from tallyframe.operators import identity as I  # noqa: E741
from tallyframe.operators import joins as J
from tallyframe.operators import quality as Q
from tallyframe.operators import windows as V
from tallyframe.operators import writes as W

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def event_year():
    return F.year("o_orderdate")


class Tables:
    """The tables of one folder, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add




@query("SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate >= TIMESTAMP '1997-01-01'")
def visible_events(t):
    return t.orders.where(F.col("o_orderstatus").isin("O", "P") & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp"))).select("o_orderkey", "o_orderdate", "o_orderpriority")


@query("SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(lower(p_name), 'green|blue|red') AND p_type IS NOT NULL AND p_size BETWEEN 5 AND 40")
def excluded_patterns(t):
    return t.part.where(~F.lower("p_name").rlike("green|blue|red") & F.col("p_type").isNotNull() & F.col("p_size").between(5, 40)).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00099') OR c_name ILIKE '%#0000000_1' OR c_name ILIKE '%\\_%' ESCAPE '\\'")
def contains_search(t):
    # Wildcards of the pattern stand for any, those of a user's text for themselves.
    return t.customer.where(X.contains_text(F.col("c_name"), "00099") | F.col("c_name").ilike("%#0000000_1") | F.col("c_name").ilike("%" + X.like_literal("_") + "%")).select("c_custkey", "c_name")


@query("""SELECT CASE WHEN year(o_orderdate) < 1994 THEN 'early' WHEN year(o_orderdate) < 1997 THEN 'middle' ELSE 'late' END AS era, count(*) AS n,
 count(DISTINCT o_custkey) AS persons FROM orders GROUP BY 1""")
def era_counts(t):
    era = F.when(event_year() < 1994, "early").when(event_year() < 1997, "middle").otherwise("late")
    return t.orders.groupBy(era.alias("era")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("persons"))


@query("""SELECT CASE WHEN l_discount >= 0.08 THEN 'high' WHEN l_discount >= 0.04 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, round(avg(l_quantity), 6) AS mean
 FROM lineitem GROUP BY 1""")
def confidence_bands(t):
    band = F.when(F.col("l_discount") >= 0.08, "high").when(F.col("l_discount") >= 0.04, "medium").otherwise("low")
    return t.lineitem.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("""SELECT r_name, n_name, count(*) AS entries, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def star_chain(t):
    people = t.customer.join(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name", "n_name")
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("k"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    both = lines.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    return both.groupBy("r_name", "n_name").agg(F.sum("k").alias("entries"), F.round(F.sum("v"), 2).alias("revenue"))


@query("""SELECT c_custkey, count(o_orderkey) AS open_events FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'O' GROUP BY 1""")
def left_with_on_filter(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'O'"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("open_events"))


@query("""SELECT n_nationkey, coalesce(s.k, c.k, -1) AS key FROM nation LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS k FROM supplier WHERE s_acctbal > 9000 GROUP BY 1) s ON s_nationkey = n_nationkey
 LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS k FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey""")
def precedence_of_two(t):
    s = t.supplier.where("s_acctbal > 9000").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s"))
    c = t.customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("c"))
    n = t.nation.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return n.select("n_nationkey", F.coalesce("s", "c", F.lit(-1)).alias("key"))


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey, b.l_suppkey AS other, count(*) AS shared FROM d a JOIN d b USING (l_orderkey)
 WHERE a.l_suppkey <> b.l_suppkey GROUP BY 1, 2""")
def co_participants(t):
    return J.co_members(t.lineitem, "l_orderkey", "l_suppkey")


@query("""WITH s AS (SELECT l_orderkey AS o, max(l_suppkey) FILTER (l_linenumber = 1) AS x, max(l_suppkey) FILTER (l_linenumber = 2) AS y FROM lineitem GROUP BY 1),
 p AS (SELECT o, least(x, y) AS a, greatest(x, y) AS b FROM s WHERE x IS NOT NULL AND y IS NOT NULL)
 SELECT a, b, count(DISTINCT o) AS appearances, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year FROM p JOIN orders ON o = o_orderkey GROUP BY 1, 2""")
def partnerships(t):
    p = J.unordered(J.slot_pairs(t.lineitem, "l_orderkey", "l_linenumber", "l_suppkey")).join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return p.groupBy("a", "b").agg(F.countDistinct("l_orderkey").alias("appearances"), F.min(event_year()).alias("first_year"), F.max(event_year()).alias("last_year"))


@query("""WITH p AS (SELECT n_name AS x, r_name AS y FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT x AS name, y AS other FROM p UNION SELECT y, x FROM p""")
def either_side(t):
    return J.either_column(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "r_name")


@query("""SELECT DISTINCT s_suppkey, c_custkey FROM supplier JOIN customer ON s_suppkey = c_custkey OR right(s_name, 4) = right(c_name, 4)""")
def any_of_two_keys(t):
    s, c = t.supplier.withColumn("s4", F.expr("right(s_name, 4)")), t.customer.withColumn("c4", F.expr("right(c_name, 4)"))
    return J.any_key(s, c, [("s_suppkey", "c_custkey"), ("s4", "c4")], "s_suppkey", "c_custkey")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_results FROM customer")
def exists_flag(t):
    k = t.orders.where("o_orderstatus = 'F'").select("o_custkey").distinct()
    return t.customer.join(k, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_custkey").isNotNull().alias("has_results"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def without_events(t):
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def latest_event(t):
    return J.latest_per_key(t.orders.select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("""SELECT e.event_id, (SELECT max(v.event_id) FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'purchase' AND v.ts = (SELECT max(w.ts) FROM events w WHERE w.user_id = e.user_id
 AND w.event_type = 'purchase' AND w.ts <= e.ts)) AS last_id FROM events e WHERE e.event_type = 'click'""")
def asof_last_purchase(t):
    e = t.events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    v = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("last_id"))
    return J.asof_join(e, v, "user_id", "ts", "at", ["last_id"]).select("event_id", "last_id")


@query("""SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year
 FROM orders GROUP BY 1 HAVING count(*) > 1""")
def summary_by_type(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.min(event_year()).alias("first_year"), F.max(event_year()).alias("last_year")).where("n > 1")


@query("""SELECT l_suppkey, CAST(sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(sum(CASE WHEN l_linenumber <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS podiums, count(DISTINCT l_orderkey) AS events,
 count(DISTINCT (l_returnflag, l_linestatus)) AS kinds, min(year(l_shipdate)) AS first_year, max(year(l_shipdate)) - min(year(l_shipdate)) + 1 AS span FROM lineitem GROUP BY 1""")
def career_stats(t):
    kind = F.when(F.col("l_returnflag").isNotNull() | F.col("l_linestatus").isNotNull(), F.struct("l_returnflag", "l_linestatus"))
    return Y.careers(t.lineitem, "l_suppkey", "l_orderkey", kind, "l_linenumber", F.year("l_shipdate"))


@query("""WITH b AS (SELECT l_suppkey, l_linenumber, l_partkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_partkey DESC) AS r FROM lineitem)
 SELECT l_suppkey, max(l_partkey) AS best_part FROM b WHERE r = 1 GROUP BY 1""")
def arg_max(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.max(F.struct("l_quantity", "l_partkey")).alias("m")).select("l_suppkey", F.col("m.l_partkey").alias("best_part"))


@query("SELECT o_custkey, string_agg(DISTINCT CAST(year(o_orderdate) AS VARCHAR), ',' ORDER BY CAST(year(o_orderdate) AS VARCHAR)) AS years FROM orders GROUP BY 1")
def years_list(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(event_year().cast("string"))), ",").alias("years"))


@query("SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), '|' ORDER BY l_linenumber, l_suppkey) AS team_key FROM lineitem GROUP BY 1")
def ordered_team_key(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("a")).select("l_orderkey", F.array_join(F.transform("a", lambda x: x["l_suppkey"].cast("string")), "|").alias("team_key"))


@query("""SELECT * FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS nth FROM customer GROUP BY 1, 2) WHERE nth <= 3""")
def most_common(t):
    return V.top_per_key(t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")), ["c_nationkey"], [F.desc("n"), F.asc("c_mktsegment")], 3)


@query("""SELECT * FROM (SELECT (year(l_shipdate) // 3) * 3 AS era, l_suppkey, count(*) AS podiums, row_number() OVER (PARTITION BY (year(l_shipdate) // 3) * 3 ORDER BY count(*) DESC, l_suppkey) AS nth
 FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2) WHERE nth <= 10""")
def era_leaders(t):
    era = (F.floor(F.year("l_shipdate") / 3) * 3).alias("era")
    return V.top_per_key(t.lineitem.where("l_linenumber <= 3").groupBy(era, "l_suppkey").agg(F.count("*").alias("podiums")), ["era"], [F.desc("podiums"), F.asc("l_suppkey")], 10)


@query("""WITH c AS (SELECT o_orderkey, count(l_orderkey) AS lines, count(DISTINCT l_returnflag || coalesce(l_linestatus, '')) AS kinds FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
 SELECT o_orderkey, CASE WHEN lines = 0 THEN 'NO RESULTS' WHEN lines >= 5 AND kinds >= 2 THEN 'FULL' WHEN lines >= 3 THEN 'PARTIAL' ELSE 'SPARSE' END AS coverage, kinds < 2 OR lines < 3 AS sparse FROM c""")
def coverage_level(t):
    kind = F.concat("l_returnflag", F.coalesce("l_linestatus", F.lit("")))
    n = t.lineitem.groupBy("l_orderkey", kind.alias("kind")).agg(F.count("*").alias("n")).groupBy("l_orderkey").agg(F.sum("n").alias("lines"), F.count("kind").alias("kinds"))
    c = t.orders.select("o_orderkey").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").na.fill(0, ["lines", "kinds"])
    level = F.when(F.col("lines") == 0, "NO RESULTS").when((F.col("lines") >= 5) & (F.col("kinds") >= 2), "FULL").when(F.col("lines") >= 3, "PARTIAL").otherwise("SPARSE")
    return c.select("o_orderkey", level.alias("coverage"), ((F.col("kinds") < 2) | (F.col("lines") < 3)).alias("sparse"))


@query("""WITH p AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_linenumber = 1 GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 25)
 SELECT l_suppkey, n, CASE WHEN count(*) OVER (PARTITION BY n) > 1 THEN 'T-' ELSE '' END || rank() OVER (ORDER BY n DESC) AS place FROM p""")
def tied_top25(t):
    top = t.lineitem.where("l_linenumber = 1").groupBy("l_suppkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(25)
    return V.tie_rank(top, "n")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, nth = 1 AS kept FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_suppkey, l_partkey) AS nth FROM lineitem)""")
def best_placement(t):
    return V.best_of(t.lineitem, ["l_orderkey", "l_returnflag"], ["l_linenumber", "l_suppkey", "l_partkey"]).select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("nth") == 1).alias("kept"))


@query("""SELECT o_orderkey, o_custkey, (SELECT min(n.o_totalprice) FROM orders n WHERE n.o_custkey = o.o_custkey AND n.o_totalprice > o.o_totalprice) AS next_value FROM orders o""")
def record_chain(t):
    return V.superseded_by(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_custkey", "o_totalprice").select("o_orderkey", "o_custkey", "next_value")


@query("SELECT year, lag(year) OVER (ORDER BY year) AS previous, lead(year) OVER (ORDER BY year) AS next FROM (SELECT DISTINCT year(o_orderdate) AS year FROM orders)")
def year_navigation(t):
    return V.neighbours(t.orders.select(event_year().alias("year")), "year")


@query("""WITH a AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 b AS (SELECT a.*, sum(c) OVER (PARTITION BY a.user_id ORDER BY e.ts, a.event_id) AS run FROM a JOIN events e USING (event_id)) SELECT user_id, event_type, CAST(run AS BIGINT) AS run, count(*) AS n FROM b GROUP BY 1, 2, 3""")
def event_runs(t):
    return V.runs(t.events.select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"], "event_type").groupBy("user_id", "event_type", "run").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, count(l_linenumber) AS n, count(DISTINCT l_linenumber) AS n_distinct, max(l_linenumber) AS highest, max(l_linenumber) = count(DISTINCT l_linenumber) AS gapless,
 count(l_linenumber) > count(DISTINCT l_linenumber) AS tied FROM lineitem GROUP BY 1""")
def placement_gaps(t):
    return V.gaps(t.lineitem, ["l_orderkey"], "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, CAST((n - 1) // 2 + 1 AS INT) AS slot, CAST((n - 1) % 2 + 1 AS INT) AS slot_order FROM
 (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)""")
def sequential_pairs(t):
    return V.pair_up(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "slot", "slot_order")


@query("""WITH p AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (l_linenumber = 1) AS wins FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 100)
 (SELECT 'entries' AS bucket, l_suppkey FROM p ORDER BY n DESC, l_suppkey LIMIT 5) UNION ALL (SELECT 'wins', l_suppkey FROM p ORDER BY wins DESC, l_suppkey LIMIT 5)
 UNION ALL (SELECT 'share', l_suppkey FROM p ORDER BY wins / n DESC, l_suppkey LIMIT 5)""")
def shared_pool(t):
    p = t.lineitem.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linenumber") == 1).alias("wins")).orderBy(F.desc("n"), "l_suppkey").limit(100)
    part = lambda name, by: p.orderBy(F.desc(by), "l_suppkey").limit(5).select(F.lit(name).alias("bucket"), "l_suppkey")
    return part("entries", F.col("n")).union(part("wins", F.col("wins"))).union(part("share", F.col("wins") / F.col("n")))


@query("SELECT c_name, c_acctbal FROM customer ORDER BY lower(c_name), c_custkey LIMIT 20 OFFSET 40")
def browse_page(t):
    return J.page(t.customer, [W.nocase(F.col("c_name")), F.col("c_custkey")], 3, 20).select("c_name", "c_acctbal")


@query("SELECT c_nationkey AS nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def distinct_union(t):
    return t.customer.select(F.col("c_nationkey").alias("nationkey")).union(t.supplier.select("s_nationkey")).distinct()


@query("""SELECT c_custkey, max(CASE WHEN o_totalprice > 300000 THEN 2 ELSE 1 END) AS tier FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1
 UNION ALL SELECT c_custkey, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def tier_with_complement(t):
    has = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_totalprice") > 300000, 2).otherwise(1)).alias("tier"))
    return t.customer.select("c_custkey").join(has, "c_custkey").union(t.customer.join(has, "c_custkey", "left_anti").select("c_custkey", F.lit(0)))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part")
def slugs(t):
    return t.part.select("p_partkey", X.slugify(F.col("p_name")).alias("slug"))


@query("SELECT doc_id, trim(lower(strip_accents(text)), ' ') AS name FROM documents")
def folded_names(t):
    return t.documents.select("doc_id", F.trim(F.lower(X.fold_marks(F.col("text")))).alias("name"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE WHEN p_size % 100 BETWEEN 11 AND 13 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS label FROM part")
def ordinal_labels(t):
    return t.part.select("p_partkey", X.place_suffix(F.col("p_size")).alias("label"))


@query("SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS edits FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def name_distance(t):
    a, b = t.nation.select(F.col("n_name").alias("a"), F.col("n_nationkey").alias("ka"), "n_regionkey"), t.nation.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("kb"), "n_regionkey")
    return a.join(b, "n_regionkey").where("ka < kb").select("a", "b", F.levenshtein("a", "b").cast("long").alias("edits"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS members, max(ts) AS last_used, count(DISTINCT user_id) >= 2 AS community FROM events GROUP BY 1")
def tag_stats(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("members"), F.max("ts").alias("last_used")).withColumn("community", F.col("members") >= 2)


@query("""SELECT 'hard' AS severity, 'dup_key' AS check_id, 'orders' AS table_name, count(*) AS issues FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT 'hard', 'orphan_event', 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
 UNION ALL SELECT 'hard', 'orphan_person', 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
 UNION ALL SELECT 'warn', 'gap_groups', 'lineitem', count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(l_linenumber) <> count(DISTINCT l_linenumber))
 UNION ALL SELECT 'info', 'negative_balance', 'customer', count(*) FROM customer WHERE c_acctbal < 0""")
def qc_gate(t):
    # Lines and orders are counted by key once; what a key lacks, has twice or skips is read from the counts.
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("k")).groupBy("l_orderkey").agg(F.sum("k").alias("n"), F.count("l_linenumber").alias("d"), F.max("l_linenumber").alias("hi"))
    keys = t.orders.groupBy("o_orderkey").agg(F.count("*").alias("o"))
    both = lines.join(keys, F.col("l_orderkey") == F.col("o_orderkey"), "full_outer").agg(
        F.count_if(F.col("o") > 1).alias("dup"), F.coalesce(F.sum(F.when(F.col("o").isNull() & F.col("l_orderkey").isNotNull(), F.col("n"))), F.lit(0)).alias("orphan"), F.count_if(F.col("n").isNotNull() & (F.col("hi") != F.col("d"))).alias("gaps"))
    row = lambda s, c, n, v: F.struct(F.lit(s).alias("severity"), F.lit(c).alias("check_id"), F.lit(n).alias("table_name"), F.col(v).alias("issues"))
    counted = both.select(F.inline(F.array(row("hard", "dup_key", "orders", "dup"), row("hard", "orphan_event", "lineitem", "orphan"), row("warn", "gap_groups", "lineitem", "gaps"))))
    return Q.gate([counted, Q.finding(Q.orphans(t.orders, t.customer, "o_custkey", "c_custkey"), "hard", "orphan_person", "orders"), Q.finding(t.customer.where("c_acctbal < 0"), "info", "negative_balance", "customer")])


@query("""SELECT p_partkey, 'short_name' AS check_id, 'warn' AS severity FROM part WHERE length(p_name) < 12 UNION ALL SELECT p_partkey, 'digits', 'info' FROM part WHERE regexp_matches(p_brand, '[0-9]')
 UNION ALL SELECT p_partkey, 'large', 'hard' FROM part WHERE p_size > 45""")
def row_checks(t):
    return Q.row_issues(t.part, "p_partkey", {"short_name": ("warn", F.length("p_name") < 12), "digits": ("info", F.col("p_brand").rlike("[0-9]")), "large": ("hard", F.col("p_size") > 45)})


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def one_id_many_names(t):
    return Q.one_to_many(t.lineitem, "l_partkey", "l_suppkey")


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1)
 SELECT coalesce(a.k, b.k) AS key, coalesce(a.n, 0) AS now, coalesce(b.n, 0) AS before, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM a FULL JOIN b ON a.k = b.k""")
def baseline_delta(t):
    a = t.orders.groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("n"))
    return Q.baseline_delta(a, t.events.groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("n")), "key", "n")


@query("""SELECT user_id, before, event_type AS after FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
 WHERE before IS NOT NULL AND before <> event_type AND before || '>' || event_type NOT IN ('view>click', 'click>purchase')""")
def transition_audit(t):
    return Q.illegal_transitions(t.events, "user_id", ["ts", "event_id"], "event_type", {("view", "click"), ("click", "purchase")})


@query("SELECT 'orders' AS table_name, count(*) AS rows, 100 AS least, count(*) >= 100 AS ok FROM orders UNION ALL SELECT 'nation', count(*), 30, count(*) >= 30 FROM nation")
def row_floors(t):
    return Q.floors({"orders": t.orders, "nation": t.nation}, {"orders": 100, "nation": 30})


@query("""WITH e AS (SELECT DISTINCT l_partkey AS l, l_suppkey AS r FROM lineitem), d AS (SELECT *, count(*) OVER (PARTITION BY l) AS dl, count(*) OVER (PARTITION BY r) AS dr FROM e)
 SELECT l, r, CASE WHEN dl = 1 AND dr = 1 THEN 'HIGH' ELSE 'MEDIUM' END AS grade, CASE WHEN dr > 1 THEN 'several_left' WHEN dl > 1 THEN 'several_right' ELSE 'one_to_one' END AS reason FROM d""")
def provenance_grades(t):
    return I.graded_edges(t.lineitem.select(F.col("l_partkey").alias("l"), F.col("l_suppkey").alias("r")))


@query("""WITH c AS (SELECT c_custkey, s_suppkey, max(CASE WHEN c_nationkey = s_nationkey THEN 100 ELSE 65 END) AS score FROM customer, supplier GROUP BY 1, 2),
 b AS (SELECT c_custkey, max(score) AS score FROM c GROUP BY 1)
 SELECT c_custkey, CASE WHEN count(*) = 1 THEN min(s_suppkey) END AS match, b.score, CASE WHEN count(*) = 1 THEN 'MATCHED' ELSE 'CONFLICT' END AS status FROM c JOIN b USING (c_custkey) WHERE c.score = b.score GROUP BY c_custkey, b.score""")
def scored_matches(t):
    return I.scored_by_group(t.customer, "c_custkey", "c_nationkey", t.supplier, "s_suppkey", "s_nationkey", 100, 65)


@query("""WITH n AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, first(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) AS kept FROM n""")
def most_referenced_id(t):
    return I.most_referenced(t.lineitem, "l_partkey", "l_suppkey")


@query("""SELECT o_orderkey, base || CASE WHEN n = 1 THEN '' ELSE '_' || n END AS key FROM (SELECT o_orderkey, year(o_orderdate) || '_' || lower(o_orderstatus) AS base,
 row_number() OVER (PARTITION BY year(o_orderdate) || '_' || lower(o_orderstatus) ORDER BY o_orderdate, o_orderkey) AS n FROM orders)""")
def event_keys(t):
    base = F.concat_ws("_", event_year().cast("string"), F.lower("o_orderstatus"))
    return I.unique_keys(t.orders.withColumn("base", base), "base", ["o_orderdate", "o_orderkey"], F.dayofyear("o_orderdate")).select("o_orderkey", "key")


@query("""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderpriority < '3' THEN 'doubles' ELSE 'singles' END AS was, o_orderstatus = 'P' AS keep, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS people,
 (SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) AS places FROM orders)
 SELECT o_orderkey, was, CASE WHEN was = 'doubles' AND NOT keep AND people > 0 AND people / places = 1.0 THEN 'singles' ELSE was END AS team_type FROM d""")
def density_retag(t):
    d = t.orders.select(F.col("o_orderkey").alias("event"), F.when(F.col("o_orderstatus") == "P", "kept").otherwise("other").alias("discipline"), F.when(F.col("o_orderpriority") < "3", "doubles").otherwise("singles").alias("team_type"))
    p = t.lineitem.select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("placement")).join(d.select("event", "discipline"), "event")
    return C.density_retag(d.withColumn("was", F.col("team_type")), p, ["kept"]).select(F.col("event").alias("o_orderkey"), "was", "team_type")


@query("""SELECT l_orderkey, 2 AS slot, '__UNKNOWN_PARTNER__' AS partner FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber = 1) > 0 AND count(*) FILTER (l_linenumber = 2) = 0""")
def ghost_partners(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_linenumber") == 1).alias("a"), F.count_if(F.col("l_linenumber") == 2).alias("b")).where("a > 0 and b = 0").select("l_orderkey", F.lit(2).alias("slot"), F.lit("__UNKNOWN_PARTNER__").alias("partner"))


@query("""WITH y AS (SELECT l_suppkey, max(year(l_shipdate)) + 20 AS hosted, min(year(l_shipdate)) + 20 AS made, count(DISTINCT l_partkey) AS members, max(CASE WHEN l_linenumber = 7 THEN year(l_shipdate) + 20 END) AS edited FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
 f AS (SELECT s_suppkey, s_acctbal > 0 AS text, coalesce(hosted >= 2020, false) AS r1, hosted IS NOT NULL AS r6, coalesce(edited >= 2020, false) AS up, coalesce(edited >= 2016 AND edited > made, false) AS r7, coalesce(made >= 2022, false) AS r9, coalesce(members >= 10, false) AS r10
 FROM supplier LEFT JOIN y ON l_suppkey = s_suppkey)
 SELECT s_suppkey, CASE WHEN r1 OR (up AND r6) THEN 'pre_populate' WHEN r6 OR r7 OR r9 OR r10 THEN 'onboarding_visible' WHEN text THEN 'dormant' ELSE 'junk' END AS class FROM f""")
def club_classes(t):
    # Suppliers as clubs, returned shipments as events hosted; years are moved to those that the rules speak of.
    y = F.year("l_shipdate") + 20
    facts = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max(y).alias("last_hosted_year"), F.min(y).alias("created_year"), F.countDistinct("l_partkey").alias("unique_members"), F.max(F.when(F.col("l_linenumber") == 7, y)).alias("last_updated_year"), F.lit(1).alias("ever_hosted"))
    none = {c: F.lit(None).cast("int") for c in ("contact_member_last_year", "max_member_last_year", "linkable_members")}
    clubs = t.supplier.join(facts, "s_suppkey", "left").withColumns({**none, "contact_member_id": F.lit(""), "has_description": F.col("s_acctbal") > 0})
    return K.classify_clubs(clubs).select("s_suppkey", F.col("category").alias("class"))


@query("""SELECT o_custkey, round(avg(o_totalprice), 2) AS mean, max(o_totalprice) AS highest, round(avg(CASE WHEN o_totalprice >= 200000 THEN 1.0 ELSE 0 END), 3) AS share FROM orders GROUP BY 1 HAVING count(*) >= 3""")
def difficulty_index(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean"), F.max("o_totalprice").alias("highest"), F.round(F.avg(F.when(F.col("o_totalprice") >= 200000, 1.0).otherwise(0.0)), 3).alias("share")).where("n >= 3").drop("n")


@query("""WITH o AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN upper(c_name) END AS name, -c_acctbal AS bal FROM customer WHERE c_custkey % 5 <> 0)
 SELECT coalesce(o.id, n.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.bal, o.bal) AS bal FROM o FULL JOIN n ON o.id = n.id""")
def upserted(t):
    c = t.customer.withColumnRenamed("c_custkey", "id")
    old = c.where("id % 3 <> 0").select("id", F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    return J.upsert(old, c.where("id % 5 <> 0").select("id", F.when(F.col("id") % 2 == 0, F.upper("c_name")).alias("name"), (-F.col("c_acctbal")).alias("bal")), "id")


@query("""SELECT o_custkey, o_orderstatus, string_agg(o_orderkey || ':' || year(o_orderdate), ',' ORDER BY o_orderkey) AS entries FROM orders GROUP BY 1, 2""")
def nested_sections(t):
    o = t.orders.groupBy("o_custkey", "o_orderstatus").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", event_year().alias("y")))).alias("a"))
    return o.select("o_custkey", "o_orderstatus", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["y"].cast("string"))), ",").alias("entries"))


@query("""WITH RECURSIVE h AS (SELECT user_id, event_id, epoch(ts) AS sec, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts), event_id) AS k FROM events),
 r AS (SELECT user_id, event_id, sec, k, sec AS start, 1 AS n FROM h WHERE k = 1 UNION ALL SELECT h.user_id, h.event_id, h.sec, h.k, CASE WHEN h.sec - r.start >= 86400 THEN h.sec ELSE r.start END,
 CASE WHEN h.sec - r.start >= 86400 THEN 1 ELSE r.n + 1 END FROM r JOIN h ON h.user_id = r.user_id AND h.k = r.k + 1) SELECT user_id, event_id AS id, n <= 2 AS allowed FROM r""")
def rate_limited(t):
    return V.first_hit_windows(t.events.select("user_id", F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")), "user_id", "at", 86400, 2).select("user_id", "id", "allowed")


# Writes and pages.


@query("""SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 AND c_custkey % 2 = 0 THEN 'closed' ELSE c_mktsegment END AS segment, CASE WHEN c_acctbal < 0 AND c_custkey % 2 = 0 THEN 0.0 ELSE c_acctbal END AS bal, c_acctbal < 0 AND c_custkey % 2 = 0 AS changed FROM customer
 WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)""")
def claimed_rows(t):
    # Claims on even ids take effect where the balance is negative; rows with a very large order are deleted.
    c = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("bal"))
    c = W.compare_and_set(c, "id", c.where("id % 2 = 0"), F.col("bal") < 0, segment=F.lit("closed"), bal=F.lit(0.0))
    return W.delete(c, "id", t.orders.where("o_totalprice > 480000").select(F.col("o_custkey").alias("id")))


@query("""WITH k AS (SELECT l_suppkey AS id, l_partkey AS v FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r = 1)
 SELECT s_suppkey AS id, -1 AS v FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT id, v FROM k WHERE id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def first_inserts(t):
    old = t.supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("id"), F.lit(-1).cast("long").alias("v"), F.lit(0).cast("long").alias("l_orderkey"), F.lit(0).alias("l_linenumber"))
    new = t.lineitem.select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("v"), "l_orderkey", "l_linenumber")
    return W.insert_first(old, new, "id", ["l_orderkey", "l_linenumber", "v"]).select("id", "v")


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN coalesce(n_name, '') ELSE c_mktsegment END AS segment, CASE WHEN n_nationkey IS NULL THEN CAST(c_acctbal > 0 AS INT) WHEN c_nationkey % 5 = 0 THEN NULL ELSE greatest(CAST(c_acctbal > 0 AS INT), CAST(n_regionkey > 2 AS INT)) END AS flag
 FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 1""")
def filled_rows(t):
    c = t.customer.select("c_custkey", "c_nationkey", F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("segment"), (F.col("c_acctbal") > 0).cast("int").alias("flag"))
    n = t.nation.where("n_regionkey <> 1").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("segment"), F.when(F.col("n_nationkey") % 5 != 0, (F.col("n_regionkey") > 2).cast("int")).alias("flag"))
    return W.fill_empty(c, n, "c_nationkey", ["segment"], ["flag"]).drop("c_nationkey")


@query("""WITH f AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_size >= 10 AND p_name LIKE '%r%'), p AS (SELECT * FROM f ORDER BY p_name, p_partkey LIMIT 20 OFFSET 10)
 SELECT p_partkey, p_name, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 30 AS has_more FROM p""")
def filtered_page(t):
    rows, facts = W.browse(t.part.select("p_partkey", "p_name", "p_size"), [F.col("p_name"), F.col("p_partkey")], [F.col("p_size") >= 10, None, F.col("p_name").contains("r")], limit=20, offset=10)
    return rows.drop("p_size").crossJoin(F.broadcast(facts))  # one row of facts


@query("""SELECT name, part FROM (SELECT name, part, row_number() OVER (PARTITION BY name ORDER BY part, k) AS n FROM (SELECT p_brand AS name, 0 AS part, p_partkey AS k FROM part WHERE p_size > 30 UNION ALL SELECT p_brand, 1, p_partkey FROM part UNION ALL SELECT n_name, 2, n_nationkey FROM nation)) WHERE n = 1""")
def kept_first(t):
    a = t.part.where("p_size > 30").select(F.col("p_brand").alias("name"), F.lit(0).alias("part"), F.col("p_partkey").alias("k"))
    b = t.part.select(F.col("p_brand").alias("name"), F.lit(1).alias("part"), F.col("p_partkey").alias("k"))
    return W.keep_first([a, b, t.nation.select(F.col("n_name").alias("name"), F.lit(2).alias("part"), F.col("n_nationkey").cast("long").alias("k"))], ["name"], ["k"]).select("name", "part")


@query("""WITH o AS (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0) SELECT 'orders' AS table_name, count(*) AS rows FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""")
def cascaded(t):
    tables = {"customer": t.customer.where("c_acctbal > 0").withColumnRenamed("c_custkey", "o_custkey"), "orders": t.orders.withColumnRenamed("o_orderkey", "l_orderkey"), "lineitem": t.lineitem}
    out = W.cascade(tables, [("orders", "customer", "o_custkey"), ("lineitem", "orders", "l_orderkey")])
    return out["orders"].agg(F.count("*").alias("rows")).select(F.lit("orders").alias("table_name"), "rows").union(out["lineitem"].agg(F.count("*").alias("rows")).select(F.lit("lineitem"), "rows"))


@query("""SELECT p_partkey, row_number() OVER (ORDER BY p_partkey % 7 = 0, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE lower(p_name) END, p_partkey) AS place FROM part""")
def blanks_last(t):
    # Places are counted in two levels: by leading letters, and within these.
    blank, name = W.blank_last(F.col("n"))
    p = t.part.select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "").otherwise(W.nocase(F.col("p_name"))).alias("n")).withColumn("b", blank)
    return V.placed(p, [], F.concat(F.col("b").cast("string"), F.substring(name, 1, 2)), ["b", "n", "p_partkey"], "place").select("p_partkey", "place")


@query("""SELECT o_orderkey, count(DISTINCT l_suppkey) AS people, max(l_shipdate) AS last FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linestatus = 'O' WHERE o_orderpriority NOT IN ('3-MEDIUM', '5-LOW') AND (o_totalprice IS NULL OR o_totalprice > 100000) AND o_orderpriority LIKE '1-%' GROUP BY 1""")
def sentinel_filters(t):
    o = t.orders.where(~F.col("o_orderpriority").isin("3-MEDIUM", "5-LOW") & (F.col("o_totalprice").isNull() | (F.col("o_totalprice") > 100000)) & F.startswith("o_orderpriority", F.lit("1-")))
    return o.join(t.lineitem.where("l_linestatus = 'O'"), F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy("o_orderkey").agg(F.countDistinct("l_suppkey").alias("people"), F.max("l_shipdate").alias("last"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_suppkey = 1) SELECT l_orderkey, l_linenumber, l_suppkey, l_suppkey = 1 AS self FROM lineitem JOIN m USING (l_orderkey)""")
def entries_with_self(t):
    # All rows of the entries that one person is in, its own too.
    mine = t.lineitem.where("l_suppkey = 1").select("l_orderkey").distinct()
    return t.lineitem.join(mine, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_suppkey") == 1).alias("self"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (SELECT count(DISTINCT x.l_suppkey) FROM lineitem x WHERE x.l_orderkey = l.l_orderkey AND x.l_returnflag = l.l_returnflag) AS people FROM lineitem l""")
def group_transform(t):
    # The number of different persons of a row's group, on every row of it.
    n = t.lineitem.groupBy("l_orderkey", "l_returnflag").agg(F.countDistinct("l_suppkey").alias("people"))
    return t.lineitem.join(n, ["l_orderkey", "l_returnflag"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "people")


@query("""SELECT l_suppkey, min(l_linenumber) AS best, round(avg(l_linenumber), 4) AS mean, count(*) FILTER (l_linenumber <= 3) AS podiums, count(DISTINCT l_partkey) AS different, round(count(DISTINCT l_partkey) / count(*), 4) AS diversity FROM lineitem GROUP BY 1""")
def placement_profiles(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.min("l_linenumber").alias("best"), F.round(F.avg("l_linenumber"), 4).alias("mean"), F.count_if(F.col("l_linenumber") <= 3).alias("podiums"), F.countDistinct("l_partkey").alias("different"), F.round(F.countDistinct("l_partkey") / F.count("*"), 4).alias("diversity"))


@query("""SELECT o_orderkey, max(l_returnflag) AS flag, max(c_name) AS name FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def fanout_collapsed(t):
    # Lines are collapsed before they are joined: the join fans out nothing.
    n = t.lineitem.groupBy("l_orderkey").agg(F.max("l_returnflag").alias("flag"))
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("l_orderkey") == F.col("o_orderkey"))
    return o.select("o_orderkey", "flag", F.col("c_name").alias("name"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS place FROM orders""")
def custom_order(t):
    state = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    return V.best_of(t.orders, ["o_custkey"], [state, F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_orderkey", F.col("nth").alias("place"))


@query("""SELECT c_mktsegment, n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance, count(*) FILTER (c_acctbal < 0) AS negative FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def candidate_groups(t):
    c = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.count_if(F.col("c_acctbal") < 0).alias("negative"))
    return c.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_mktsegment", "n_name", "n", "balance", "negative")


@query("""SELECT l_suppkey, l_returnflag, count(*) AS entries, count(*) FILTER (l_linenumber = 1) AS wins, count(DISTINCT l_orderkey) AS events FROM lineitem GROUP BY 1, 2""")
def stats_per_category(t):
    per = t.lineitem.groupBy("l_suppkey", "l_returnflag", "l_orderkey").agg(F.count("*").alias("k"), F.count_if(F.col("l_linenumber") == 1).alias("w"))
    return per.groupBy("l_suppkey", "l_returnflag").agg(F.sum("k").alias("entries"), F.sum("w").alias("wins"), F.count("*").alias("events"))


@query("""WITH k AS (SELECT l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS r FROM lineitem) WHERE r = 1)
 SELECT p_partkey, s_name AS first_seller FROM part LEFT JOIN k ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def first_wins_lookup(t):
    first = J.latest_per_key(t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"), ["l_partkey"], [F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_suppkey")])
    return t.part.join(first, F.col("l_partkey") == F.col("p_partkey"), "left").join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left").select("p_partkey", F.col("s_name").alias("first_seller"))


@query("""SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON lower(c_mktsegment) || c_nationkey = lower(CASE WHEN s_acctbal > 0 THEN 'Building' ELSE 'machinery' END) || s_nationkey AND s_acctbal < c_acctbal""")
def folded_key_join(t):
    # An equi-join on an expression, without regard to case, and what is left of the condition behind it.
    s = t.supplier.select("s_suppkey", "s_acctbal", F.concat(F.lower(F.when(F.col("s_acctbal") > 0, "Building").otherwise("machinery")), F.col("s_nationkey").cast("string")).alias("k"))
    c = t.customer.select("c_custkey", "c_acctbal", F.concat(F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("k"))
    return c.join(s, "k").where("s_acctbal < c_acctbal").select("c_custkey", "s_suppkey")
