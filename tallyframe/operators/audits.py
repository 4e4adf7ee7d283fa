"""Audits: each gives findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What may be wrong with a person's name, how grave it is, and the patterns that show it.
NAME_CHECKS = (
    ("encoding_corruption", "HIGH", (r"[¶¦±¼¿¸¹º³]",)), ("encoding_corruption_question", "HIGH", (r"(?U)\w\?\w|\w\?|\?\w",)), ("multi_person", "MEDIUM", (r"(?i)\S\s+(and|&|\+|vs\.?)\s+\S|\S\s*/\s*\S",)),
    ("junk_marker_trailing", "LOW", (r"\s.*\*+$",)), ("junk_marker_characters", "MEDIUM", (r"[+=\\|]",)), ("junk_marker_rank", "MEDIUM", (r"(?:^|\s)\d{1,2}\.\s+\S",)), ("incomplete_name_question", "MEDIUM", (r"(?:^|\s)\?{1,5}(?:\s|$)",)),
    ("single_word", "LOW", (r"^[^ .]+$",)), ("non_person", "MEDIUM", (r"^[A-Z]{2}\s+\d+$", r"\$\d+", r"(?i)\d+-\d+\s+over\b", r"\b\d{3,}\b", r"^[A-Z]{2,}[\s-]+[A-Z]{2,}(?:[\s-]+[A-Z]{2,})*$", r"(?i)-prizes\b|\bprize\b", ",", r"^\P{Lu}")),
    ("abbreviated_name", "LOW", (r"^[A-Z]\.?\s+\S",)), ("incomplete_name_last", "LOW", (r"^\S+\s+[A-Z]$",)), ("incomplete_name_initials", "MEDIUM", (r"^[A-Z]\.\s+[A-Z]\.$",)),
)


def name_issues(persons: DataFrame, sentinels: list[str]) -> DataFrame:
    """(person_id, category, severity): a row for each check that a name fails. Empty names and sentinels are not looked at."""
    name = F.trim(F.coalesce("person_name", F.lit("")))
    found = [F.when(F.exists(F.array(*[name.rlike(p) for p in patterns]), lambda x: x), F.struct(F.lit(c).alias("category"), F.lit(s).alias("severity"))) for c, s, patterns in NAME_CHECKS]
    return persons.where((name != "") & ~name.isin(*sentinels)).select("person_id", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("i")).select("person_id", "i.category", "i.severity")


def rollup(issues: DataFrame) -> DataFrame:
    """(category, severity, n, persons)."""
    return issues.groupBy("category", "severity").agg(F.count("*").alias("n"), F.countDistinct("person_id").alias("persons"))


def stage_drop(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, before, after, lost): rows of each key in both stages, where they differ."""
    count = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    both = count(before, "before").join(count(after, "after"), key, "full_outer").na.fill(0, ["before", "after"])
    return both.withColumn("lost", F.col("before") - F.col("after")).where("lost <> 0")


def flattened_ties(source: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict): source and derived placements of each group side by side: equal, ties flattened (the same number of places, but the
    shared ones made to run on), or other; and groups that one side lacks."""
    places = lambda df, n: df.groupBy(*keys).agg(F.sort_array(F.collect_list("placement")).alias(n))
    j = places(source, "_s").join(places(derived, "_d"), keys, "full_outer")
    run = F.sequence(F.lit(1), F.greatest(F.size(F.coalesce("_d", F.array().cast("array<int>"))), F.lit(1)))
    tied = F.size(F.array_distinct("_s")) < F.size("_s")
    verdict = F.when(F.col("_s").isNull(), "only_derived").when(F.col("_d").isNull(), "only_source").when(F.col("_s") == F.col("_d"), "equal").when(tied & (F.size("_s") == F.size("_d")) & (F.col("_d") == run), "flattened").otherwise("other")
    return j.select(*keys, verdict.alias("verdict"))


def identity_findings(aliases: DataFrame, persons: DataFrame) -> DataFrame:
    """(signal, subject, detail) from aliases(alias, person_id) and persons(person_id, name, source, placements), names being normalised:
    an alias with several persons; one of these whose own name it is; several persons with placements of one name; a stub (without
    placements, from a patch) beside such a person."""
    a = aliases.where("coalesce(alias, '') <> '' and coalesce(person_id, '') <> ''").select("alias", "person_id").distinct()
    several = a.groupBy("alias").agg(F.array_sort(F.collect_set("person_id")).alias("ids")).where("size(ids) > 1")
    conflict = several.select(F.lit("alias_conflict").alias("signal"), F.col("alias").alias("subject"), F.array_join("ids", "|").alias("detail"))
    own = a.join(several, "alias").join(persons.select("person_id", "name"), "person_id").where("name = alias")
    selfs = own.select(F.lit("self_pointing_conflict"), F.col("alias"), F.col("person_id"))
    live = persons.where("placements > 0 and coalesce(name, '') <> ''")
    twice = live.groupBy("name").agg(F.array_sort(F.collect_set("person_id")).alias("ids")).where("size(ids) > 1").select(F.lit("live_duplicate"), "name", F.array_join("ids", "|"))
    one = live.groupBy("name").agg(F.min("person_id").alias("live"))
    stubs = persons.where("source like 'patch_%' and coalesce(placements, 0) = 0").join(one, "name").where("live <> person_id").select(F.lit("stub_beside_live"), "person_id", "live")
    return conflict.union(selfs).union(twice).union(stubs)


def discipline_verdict(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, entries, places, tie_share, highest, verdict) of placements: clean, with ties, with gaps, or dense (all on one place)."""
    g = results.groupBy(*keys).agg(F.count("*").alias("entries"), F.countDistinct("placement").alias("places"), F.max("placement").alias("highest"))
    tie = F.round(1 - F.col("places") / F.col("entries"), 3)
    verdict = F.when((F.col("places") == 1) & (F.col("entries") > 1), "dense").when(F.col("highest") > F.col("entries"), "gaps").when(F.col("places") < F.col("entries"), "ties").otherwise("clean")
    return g.select(*keys, "entries", "places", tie.alias("tie_share"), "highest", verdict.alias("verdict"))


def required(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """(severity, check_id, table_name, issues): for each required column how many rows lack it; all, if the table has no such column."""
    empty = lambda c: F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "") if c in df.columns else F.count("*")
    counts = df.agg(*[empty(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit("hard").alias("severity"), F.lit(f"required_{c}").alias("check_id"), F.lit(table).alias("table_name"), F.col(c).alias("issues")) for c in columns])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def canonical_gate(disciplines: DataFrame, participants: DataFrame, persons: DataFrame, person_like) -> DataFrame:
    """(severity, check_id, issues): the checks of the canonical tables that need several of them."""
    out = []
    def add(severity: str, check: str, df: DataFrame) -> None:
        out.append(df.agg(F.count("*").alias("issues")).select(F.lit(severity).alias("severity"), F.lit(check).alias("check_id"), "issues"))
    p = participants
    add("hard", "orphan_discipline", p.join(disciplines, ["event", "discipline"], "left_anti"))
    add("hard", "orphan_person", p.where("coalesce(person_id, '') <> ''").join(persons.select("person_id"), "person_id", "left_anti"))
    add("hard", "placement_not_positive", p.where("placement is null or placement < 1"))
    slots = p.groupBy("event", "discipline", "placement").agg(F.count("*").alias("n"))
    add("warn", "doubles_participants", slots.join(disciplines.where("team_type = 'doubles'"), ["event", "discipline"]).where("n % 2 = 1"))
    add("warn", "blank_name", p.where("trim(coalesce(display_name, '')) = ''"))
    add("warn", "non_person_name", p.where((F.trim(F.coalesce("display_name", F.lit(""))) != "") & ~person_like(F.col("display_name"))))
    add("info", "one_id_many_names", p.where("coalesce(person_id, '') <> ''").groupBy("person_id").agg(F.countDistinct("display_name").alias("n")).where("n > 1"))
    full = out[0]
    for df in out[1:]:
        full = full.union(df)
    return full


# Event types, and patterns that a place, a name or a date should not have.
EVENT_TYPES = ("worlds", "net", "freestyle", "mixed", "golf", "social")
URL, EMAIL, MARKUP = r"(?i)https?://|www\.", r"\S+@\S+\.\S+", r"(?i)<[a-z/][^>]*>|&(?:amp|nbsp|lt|gt|#\d+);"


def event_rules(year_from: int = 1980, year_to: int = 2030) -> dict[str, tuple[str, Column]]:
    """Checks of one row of events(id, name, event_type, location, date, year, host_club): severity, and what breaks it."""
    c = lambda n: F.trim(F.coalesce(F.col(n).cast("string"), F.lit("")))
    texts = lambda p: F.exists(F.array(*map(c, ("name", "location", "host_club"))), lambda x: x.rlike(p))
    raw = F.array(*[F.coalesce(F.col(n), F.lit("")) for n in ("name", "location", "host_club")])
    in_date = F.regexp_extract(c("date"), r"(?<!\d)((?:19|20)\d{2})(?!\d)", 1)
    return {
        "event_id_missing": ("ERROR", c("id") == ""),
        "event_id_pattern": ("ERROR", (c("id") != "") & ~c("id").rlike(r"^\d+$")),
        "event_name_missing": ("ERROR", c("name") == ""),
        "event_name_html": ("ERROR", c("name").rlike(MARKUP)),
        "event_name_url": ("WARN", c("name").rlike(URL)),
        "event_name_placeholder": ("WARN", F.lower(c("name")).rlike(r"^(event|test|untitled|n/a|tba|tbd)\b")),
        "event_type_invalid": ("ERROR", (c("event_type") != "") & ~F.lower(c("event_type")).isin(*EVENT_TYPES)),
        "location_missing": ("WARN", c("location") == ""),
        "location_url": ("ERROR", c("location").rlike(URL)),
        "location_email": ("ERROR", c("location").rlike(EMAIL)),
        "location_hosted_by": ("WARN", c("location").rlike(r"(?i)\bhosted by\b")),
        "location_multi_sentence": ("WARN", c("location").rlike(r"[a-z]{3}\.\s+[A-Z]")),
        "location_too_long": ("WARN", F.length(c("location")) > 100),
        "location_tba": ("INFO", c("location").rlike(r"(?i)\btb[ad]\b")),
        "location_street": ("INFO", c("location").rlike(r"(?i)\b\d+\s+\w+\s+(street|st\.|ave|avenue|road|rd\.|blvd)\b")),
        "date_missing_worlds": ("ERROR", (F.lower(c("event_type")) == "worlds") & (c("date") == "")),
        "date_ical_remnant": ("WARN", c("date").rlike(r"(?i)add to ical|vcal")),
        "date_too_long": ("INFO", F.length(c("date")) > 60),
        "date_year_mismatch": ("WARN", (in_date != "") & F.col("year").isNotNull() & (in_date != c("year"))),
        "year_missing_worlds": ("ERROR", (F.lower(c("event_type")) == "worlds") & F.col("year").isNull()),
        "year_out_of_range": ("ERROR", ~F.col("year").between(year_from, year_to)),
        "host_club_url": ("WARN", c("host_club").rlike(URL)),
        "host_club_numbered_prefix": ("INFO", c("host_club").rlike(r"^\d+\s*[.)]")),
        "string_whitespace": ("INFO", F.exists(raw, lambda x: x != F.trim(x))),
        "string_double_space": ("INFO", texts(r"\S {2,}\S")),
        "string_control_chars": ("WARN", F.exists(raw, lambda x: x.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))),
        "string_mojibake": ("WARN", texts("Ã.|â€|¶|¿")),
    }


def placement_rules() -> dict[str, tuple[str, Column]]:
    """Checks of one placement(event, division, place, competitor_type, player1, player2)."""
    one, two, division = (F.trim(F.coalesce(n, F.lit(""))) for n in ("player1", "player2", "division"))
    both = lambda p: one.rlike(p) | two.rlike(p)
    return {
        "place_invalid": ("ERROR", F.col("place").isNull() | (F.col("place") < 1)),
        "competitor_type_invalid": ("ERROR", ~F.coalesce(F.col("competitor_type").isin("player", "team"), F.lit(False))),
        "name_empty": ("ERROR", one == ""),
        "name_short": ("WARN", F.length(one) == 1),
        "name_noise": ("WARN", both(rf"{URL}|(?i)^\W*(results?|round|pool|finals?)\b")),
        "leading_dash": ("WARN", both(r"^[-–]")),
        "unsplit_team": ("WARN", (two == "") & one.rlike(r"\s(&|/|and)\s")),
        "doubles_dash_separator": ("INFO", (two == "") & F.lower(division).contains("doubles") & one.rlike(r"\S\s+[-–]\s+\S")),
        "duplicate_in_team": ("ERROR", (two != "") & (F.lower(one) == F.lower(two))),
        "has_slash": ("WARN", (two != "") & both("/")),
        "has_score": ("WARN", both(r"\b\d{1,2}-\d{1,2}\b")),
        "has_month": ("INFO", both(r"(?i)\b(january|february|april|june|july|august|september|october|november|december)\b")),
        "has_semicolon": ("WARN", both(";")),
        "team_without_second": ("WARN", (F.col("competitor_type") == "team") & (two == "")),
        "division_unknown": ("INFO", F.lower(division) == "unknown"),
        "division_like_placement": ("WARN", division.rlike(r"^\d{1,3}\s*[.)]\s*\S")),
        "division_foreign": ("INFO", division.rlike(r"(?i)\b(dobles|individuales|femenino|feminin|hommes|femmes|simples)\b")),
    }


def cross_record(events: DataFrame, placements: DataFrame) -> DataFrame:
    """(check_id, subject): ids that repeat; years with several worlds; events alike in year, name and place; types that none of the
    event's categories bear out; all divisions unknown; events without results. events(id, name, event_type, location, year),
    placements(event, category)."""
    low = lambda c: F.trim(F.lower(F.coalesce(c, F.lit(""))))
    one = lambda df, check, subject: df.select(F.lit(check).alias("check_id"), F.col(subject).cast("string").alias("subject"))
    many = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
    out = one(many(events, "id"), "event_id_duplicate", "id")
    out = out.union(one(many(events.where("event_type = 'worlds' and year is not null"), "year"), "worlds_multiple_per_year", "year"))
    alike = many(events.select("year", low("name").alias("name"), low("location").alias("location")).where("name <> ''"), "year", "name", "location")
    out = out.union(one(alike, "duplicate_event", "name"))
    has = lambda c: F.max((F.col("category") == c).cast("int"))
    kinds = placements.groupBy(F.col("event").alias("id")).agg(has("net").alias("net"), has("freestyle").alias("free"), F.min((F.col("category") == "unknown").cast("int")).alias("unknown"))
    j = events.select("id", "event_type").distinct().join(kinds, "id", "left")
    for kind, column in (("net", "net"), ("freestyle", "free"), ("worlds", "net"), ("worlds", "free")):
        out = out.union(one(j.where((F.col("event_type") == kind) & (F.col(column) == 0)), f"{kind}_without_{'net' if column == 'net' else 'freestyle'}", "id"))
    return out.union(one(j.where("unknown = 1"), "all_unknown_divisions", "id")).union(one(j.where("unknown is null"), "no_results", "id"))


def alias_registry(aliases: DataFrame, persons: DataFrame) -> DataFrame:
    """(line, check_id, severity) of aliases(line, alias, person_id, person_canon): blank, malformed id, repeated row, person gone (but its
    name known, or not), one alias for several persons."""
    uuid = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    known, named = persons.select("person_id").distinct().withColumn("_id", F.lit(True)), persons.select(F.lower("person_name").alias("_c")).distinct().withColumn("_name", F.lit(True))
    several = aliases.where("coalesce(alias, '') <> ''").groupBy(F.lower("alias").alias("_al")).agg((F.countDistinct("person_id") > 1).alias("_several"))
    first = aliases.groupBy("alias", "person_id", "person_canon").agg(F.min("line").alias("_first"))
    a = aliases.withColumns({"_c": F.lower("person_canon"), "_al": F.lower("alias")}).join(known, "person_id", "left").join(named, "_c", "left").join(several, "_al", "left")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("alias", "person_id", "person_canon")]
    a = a.alias("a").join(first.alias("f"), same).select("a.*", "_first")
    valid = F.coalesce(F.lower("person_id").rlike(uuid), F.lit(False))
    rules = {
        "blank_alias": ("hard", F.trim(F.coalesce("alias", F.lit(""))) == ""), "malformed_uuid": ("hard", ~valid), "duplicate_row": ("warn", F.col("line") > F.col("_first")),
        "stale_pid_canon_resolves": ("warn", valid & F.col("_id").isNull() & F.col("_name").isNotNull()), "missing_canonical_pid": ("hard", valid & F.col("_id").isNull() & F.col("_name").isNull()), "alias_conflict": ("hard", F.col("_several")),
    }
    found = F.array(*[F.when(broken, F.struct(F.lit(n).alias("check_id"), F.lit(s).alias("severity"))) for n, (s, broken) in rules.items()])
    return a.select("line", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("line", "i.*")


def people_findings(rows: DataFrame, person_like, most: int = 20) -> DataFrame:
    """(check_id, severity, name, n) of rows(name, person_id, person_canon): names without a person, persons without a name, and names with
    odd letters, several persons, marks at the end or an open bracket; the `most` frequent of each."""
    name, pid = F.trim(F.coalesce("name", F.lit(""))), F.trim(F.coalesce("person_id", F.lit("")))
    rules = {
        "unmapped_person_name": ("WARN", person_like(name) & (pid == "")), "canon_missing": ("ERROR", (pid != "") & (F.trim(F.coalesce("person_canon", F.lit(""))) == "")), "mojibake": ("WARN", name.rlike("[¶¦±¼¿¸¹º³]")),
        "multi_person": ("WARN", name.rlike(r"(?i)\S\s+(and|&|\+)\s+\S|\S/\S") & ~name.rlike(r"^\p{Ll}|,.*,|^(I{1,3}|IV|V|VI{0,3}|IX|X)\s+and\b")), "trailing_junk": ("INFO", name.rlike(r"\s.*[*–-]+$")), "open_paren": ("INFO", name.contains("(") & ~name.contains(")")),
    }
    found = F.array(*[F.when(broken, F.struct(F.lit(n).alias("check_id"), F.lit(s).alias("severity"))) for n, (s, broken) in rules.items()])
    n = rows.select(name.alias("name"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).groupBy("i.check_id", "i.severity", "name").agg(F.count("*").alias("n"))
    w = Window.partitionBy("check_id").orderBy(F.desc("n"), "name")
    return n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def expected_counts(before: DataFrame, after: DataFrame, expected: int) -> DataFrame:
    """(before, after, changed, ok): whether a patch took away or added just as many rows as it says."""
    b, a = before.agg(F.count("*").alias("before")), after.agg(F.count("*").alias("after"))
    return b.crossJoin(F.broadcast(a)).withColumn("changed", F.col("after") - F.col("before")).withColumn("ok", F.col("changed") == expected)  # one row each
