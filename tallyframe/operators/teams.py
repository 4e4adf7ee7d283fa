"""Teams of two: who they are, what is odd about them, who a missing partner may be, and matches told in free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import text as X

# Levels of disciplines in order of priority, and names too vague to trust.
LEVELS = (
    (r"(?U)\bnovice\b|\bbeginner", "novice"), (r"(?U)\bintermediate\b|\binterm\b|interméd", "intermediate"), (r"(?U)\bmaster", "masters"), (r"(?U)\bpro\b", "other"), (r"(?U)\badvanced\b|\badvance\b|\bamateur\b|\bultra\b", "other"),
    (r"(?U)women'?s?\b|womens?\b|féminin", "womens"), (r"(?U)\bmixed?\b|\bmixte\b|\bmix\b", "mixed"), (r"(?U)\bopen\b|\bmen'?s?\s+open|\bopen\s+men", "open"),
)
WINS = r"(?i)\b(def(?:eated|\.)?|beat|beats|bested|over|won against|topped)\b"
SCORE = r"\b\d{1,2}\s*[-–]\s*\d{1,2}\b"
ROUND = r"(?i)\b(final|semi|quarter|round|pool|bracket|match)"
BLOCK = r"(?i)^\s*1st\s*[-–:.]?\s*([^,;]+)"


def discipline_groups(disciplines: DataFrame, vague: list[str] = ()) -> DataFrame:
    """Adds canonical_group, match_method, review_needed, conflict_flag to disciplines(name, team_type): the first level that the name
    has, with singles or doubles; a conflict if it has several levels, or mixed singles."""
    low = F.lower(F.trim("name"))
    hits = F.array_distinct(F.filter(F.array(*[F.when(low.rlike(p), level) for p, level in LEVELS]), lambda x: x.isNotNull()))
    kind = F.when(F.col("team_type") == "doubles", "doubles").otherwise("singles")
    d = disciplines.withColumns({"_hits": hits, "_kind": kind})
    none, level = F.size("_hits") == 0, F.try_element_at("_hits", F.lit(1))
    bare = F.trim(F.regexp_replace(low, r"[\s\d:.,\-/]+$", ""))
    review = bare.isin(*vague) | low.isin(*vague) if vague else F.lit(False)
    lost = low.isin("unknown", "net", "doubles", "singles") | review
    odd = (level == "mixed") & (F.col("_kind") == "singles")
    group = F.when(none & lost, "uncategorized").when(none, F.concat(F.lit("open_"), "_kind")).when(odd, "uncategorized").otherwise(F.concat(level, F.lit("_"), "_kind"))
    conflict = F.when(none, 0).otherwise(((F.size("_hits") > 1) | odd).cast("int"))
    out = d.withColumns({"canonical_group": group, "match_method": F.when(none, "fallback").otherwise("pattern"), "conflict_flag": conflict})
    return out.withColumn("review_needed", F.when(none, lost.cast("int")).otherwise(((F.col("conflict_flag") == 1) | review).cast("int"))).drop("_hits", "_kind")


def team_entries(rows: DataFrame, unknown: str) -> DataFrame:
    """One row an entry: its two persons in order and what is wrong with it, if anything. rows(entry, event, discipline, discipline_name,
    placement, year, participant_order, person_id) of doubles."""
    e = rows.groupBy("entry", "event", "discipline", "discipline_name", "placement", "year").agg(F.count("*").alias("n"), F.count_if(F.col("person_id").isNull()).alias("open"), F.sort_array(F.collect_list("person_id")).alias("p"))
    a, b = F.try_element_at("p", F.lit(1)), F.try_element_at("p", F.lit(2))
    wrong = F.when((F.col("n") != 2) | (F.size("p") != 2), "participant_count_mismatch").when(F.col("open") > 0, "null_historical_person_id").when((a == b) & (a == unknown), "unknown_team").when(a == b, "self_team")
    wrong = wrong.when(~F.coalesce(F.col("placement").between(1, 999), F.lit(False)), "placement_out_of_range")
    return e.select("entry", "event", "discipline", "discipline_name", "placement", "year", a.alias("a"), b.alias("b"), wrong.alias("issue"))


def build_teams(rows: DataFrame, unknown: str, namespace: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(teams, appearances, issues). A team's best placement in a discipline is its appearance; the others are displaced. Its years are
    of all its entries, its appearance_count of the (event, discipline) pairs."""
    e = team_entries(rows, unknown)
    good = e.where("issue is null").withColumn("team_id", X.uuid5(namespace, F.concat_ws("|", "a", "b")))
    w = Window.partitionBy("team_id", "event", "discipline").orderBy("placement", "entry")
    good = good.withColumn("_n", F.row_number().over(w))
    teams = good.groupBy("team_id", "a", "b").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count_if(F.col("_n") == 1).alias("appearance_count"))
    level = F.create_map(*[F.lit(x) for p in {"participant_count_mismatch": "high", "null_historical_person_id": "high", "unknown_team": "low", "self_team": "critical", "placement_out_of_range": "high"}.items() for x in p])
    issues = e.where("issue is not null").select("issue", F.col("entry").alias("subject"), level[F.col("issue")].alias("severity"))
    issues = issues.union(good.where("_n > 1").select(F.lit("multi_stage_result"), "entry", F.lit("low")))
    named = e.where(F.lower("discipline_name").contains("singles")).select("discipline").distinct()
    issues = issues.union(named.select(F.lit("discipline_team_type_mismatch"), "discipline", F.lit("medium")))
    return teams, good.where("_n = 1").select("team_id", "event", "discipline", "entry", "placement", "year"), issues


def fragments(lines: DataFrame, persons: DataFrame, least: int = 10, most: int = 300) -> DataFrame:
    """(id, kind, a, b, score, year, confidence, pid_a, pid_b) of lines(id, line) that tell of a match: won by somebody over somebody, a
    score in a bracket, or a block of placements. Confidence .90 with a verb and a score, .75 with a verb, .65 with neither verb."""
    l = F.col("line")  # noqa: E741
    verb, score = l.rlike(WINS), F.nullif(F.regexp_extract("line", SCORE, 0), F.lit(""))
    kind = F.when(l.rlike(BLOCK), "placement_block").when(verb, "match_result").when(score.isNotNull() & l.rlike(ROUND), "bracket_line")
    f = lines.where(F.length("line").between(least, most)).withColumns({"kind": kind, "verb": verb, "score": score}).where("kind is not null")
    year = F.try_to_number(F.nullif(F.regexp_extract("line", r"\b(19[7-9]\d|20[0-2]\d)\b", 1), F.lit("")), F.lit("9999")).cast("int")
    sides = F.split("line", WINS, 2)
    ends = lambda c, n: F.regexp_replace(F.array_join(F.slice(F.split(F.trim(c), r"\s+"), n, 2), " "), r"[,;:]+$", "")
    left = F.when(F.size(F.split(F.trim(sides[0]), r"\s+")) > 1, ends(sides[0], -2)).otherwise(F.trim(sides[0]))
    right = ends(F.coalesce(F.try_element_at(sides, F.lit(2)), F.lit("")), 1)
    pair = F.split(F.trim(F.regexp_extract("line", BLOCK, 1)), r"\s*(?:/|&|\band\b)\s*", 2)
    block = F.col("kind") == "placement_block"
    a, b = F.when(block, pair[0]).when(F.col("verb"), left), F.when(block, F.try_element_at(pair, F.lit(2))).when(F.col("verb"), right)
    confidence = F.when(F.col("verb") & F.col("score").isNotNull(), 0.90).when(F.col("verb"), 0.75).otherwise(0.65)
    f = f.withColumns({"a": a, "b": b, "year": year, "confidence": confidence}).where("coalesce(a, '') <> '' and coalesce(b, '') <> '' and a <> b")
    p = persons.groupBy(F.lower("person_name").alias("_k")).agg(F.min("person_id").alias("pid"))
    for side in ("a", "b"):
        f = f.join(p.select(F.col("_k").alias(f"_{side}"), F.col("pid").alias(f"pid_{side}")), F.lower(side) == F.col(f"_{side}"), "left")
    return f.select("id", "kind", "a", "b", "score", "year", "confidence", "pid_a", "pid_b")


def split_anomaly(display: Column, places: list[str]) -> Column:
    """What is wrong with a team's name as shown: cut inside a place or brackets, or a partner missing."""
    parts = F.transform(F.split(display, " / "), lambda p: F.trim(F.lower(F.regexp_replace(p, r"\)+$", ""))))
    count = lambda c: F.length(display) - F.length(F.replace(display, F.lit(c), F.lit("")))
    place = F.exists(parts, lambda p: p.isin(*places) | p.rlike(r"^\w+,\s*(usa|canada|france|germany)"))
    return F.when(place | (count("(") != count(")")), "SPLIT_PARSING_ERROR").when(~display.contains(" / ") & display.contains("("), "MISSING_PARTNER")


def doubles_anomalies(disciplines: DataFrame, participants: DataFrame, nobody: list[str]) -> DataFrame:
    """(event, discipline, placement, anomaly, name): in doubles, entries with one name and a partner without, and names of one word."""
    p = participants.join(disciplines.where("team_type = 'doubles'").select("event", "discipline"), ["event", "discipline"], "left_semi").withColumn("name", F.trim("display_name"))
    real = ~F.lower("name").isin(*nobody)
    lone = p.groupBy("event", "discipline", "placement").agg(F.count_if(real).alias("r"), F.count_if(~real).alias("u"), F.max(F.when(real, F.col("name"))).alias("name")).where("r = 1 and u >= 1")
    short = p.where(real & ~F.col("name").contains(" ") & (F.length("name") > 1))
    cols = ["event", "discipline", "placement"]
    return lone.select(*cols, F.lit("MISSING_PARTNER").alias("anomaly"), "name").union(short.select(*cols, F.lit("TRUNCATED_NAME"), "name"))


def partners(participants: DataFrame, nobody: list[str], most: int = 3) -> DataFrame:
    """(name, partner, n, last_year, nth): with whom a name made entries of two most often. participants(event, discipline, placement, year,
    display_name). A slot of any other number of names makes no pair."""
    p = participants.where(~F.lower("display_name").isin(*nobody))
    two = p.groupBy("event", "discipline", "placement", "year").agg(F.sort_array(F.collect_set("display_name")).alias("s"), F.count("*").alias("n")).where("n = 2 and size(s) = 2")
    pairs = two.select("year", F.col("s")[0].alias("name"), F.col("s")[1].alias("partner"))
    pairs = pairs.union(pairs.select("year", "partner", "name")).groupBy("name", "partner").agg(F.count("*").alias("n"), F.max("year").alias("last_year"))
    return pairs.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "partner"))).where(F.col("nth") <= most)


def suggested_partners(missing: DataFrame, known: DataFrame) -> DataFrame:
    """(name, year, partner, confidence): of missing(name, year) HIGH for five entries together and five years apart at most, MEDIUM for
    three; others are no suggestion."""
    gap = F.when(F.col("last_year").isNotNull() & (F.coalesce("year", F.lit(0)) > 0), F.abs(F.col("year") - F.col("last_year"))).otherwise(99)
    j = missing.join(known, "name").withColumn("confidence", F.when((F.col("n") >= 5) & (gap <= 5), "HIGH").when(F.col("n") >= 3, "MEDIUM"))
    return j.where("confidence is not null").select("name", "year", "partner", "confidence")
