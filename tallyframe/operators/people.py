"""Persons: whether a text is a name, whom it names, and how sure that is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import text as X

# Patterns and words that say that a text is no person's name; given first names with their short forms; names of nobody.
NOT_PERSONS = (
    r"[¶¦±¼¿¸¹º³]", r"\w\?|\?\w", r"(?:^|\s)\?{1,5}(?:\s|$)", r"[+=\\|/]", r"^[A-Z]{2}\s+\d+$", r"\$\d+", r"(?i)\d+-\d+\s+over\b", r"\b\d{3,}\b", r",",
    r"^[A-Z]{2,}[\s-]+[A-Z]{2,}(?:[\s-]+[A-Z]{2,})*$", r"\s.*[*]+$", r"^[^ .]*$", r"^[A-Z]\.?\s+\S", r"^\S+\s+[A-Z]$", r"^[A-Z]\.\s+[A-Z]\.$", r"(?iu)-prizes\b|\bprize\b", r">|\s:\s", r"\S{21,}", r"^\p{IsLowercase}", r"\bThe\b", '"', r"(?i) or ",
)
NOT_PERSON_TERMS = (
    "connection", "dimension", "footbag", "spikehammer", "freestyler", "results", "champions", "whirlygig", "whirlwind", "spinning", "blender", "smear", "clipper",
    "torque", "butterfly", "mirage", "legbeater", "ducking", "eggbeater", "ripwalk", "hopover", "dropless", "scorpion", "matador", "symposium", "swirl", "drifter",
    "vortex", "superfly", "atomic", "blurry", "whirl", "flux", "dimwalk", "nemesis", "bedwetter", "pixie", "rooted", "sailing", "diving", "ripped", "warrior", "paradon",
    "steping", "pdx", "mullet", "depending", "head-to-head", "being determined", "round robin", "foot clan", "big add posse", "aerial zone", "annual mountain",
    "be announced", "highest.placed", "two footbags",
)
NICKNAMES = {"dave": ("david",), "david": ("dave",), "mike": ("michael",), "michael": ("mike",), "bob": ("robert",), "robert": ("bob",), "bill": ("william",), "william": ("bill",), "jim": ("james",), "james": ("jim",), "tom": ("thomas",), "thomas": ("tom",), "steve": ("steven", "stephen"), "steven": ("steve",), "stephen": ("steve",)}
NOBODY = ("[UNKNOWN PARTNER]", "__UNKNOWN_PARTNER__", "__NON_PERSON__", "Unknown", "")


def of_all_scripts(pattern: str) -> str:
    r"""A pattern whose \d, \w and \b take digits and letters of all scripts, and no marks, for parts of words."""
    word = r"[\p{L}\p{N}_]"
    return pattern.replace(r"\d", r"\p{Nd}").replace(r"\w", word).replace(r"\b", rf"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")


def is_person_like(name: Column) -> Column:
    # White space of all kinds; blanks and line feeds stay apart from the rest.
    s = F.regexp_replace(F.regexp_replace(name, r"(?U)[\s\x1c-\x1f&&[^ \n]]", "\t"), r"^\s+|\s+\z", "")
    words = "|".join(NOT_PERSON_TERMS)
    bad = s.rlike(of_all_scripts(rf"(?iu)\b({words})\b"))
    for pattern in NOT_PERSONS:
        bad = bad | s.rlike(of_all_scripts(pattern))
    return F.coalesce((s != "") & ~bad, F.lit(False))


def first_of(df: DataFrame, key: Column, order: list, **values: Column) -> DataFrame:
    """(key, values) of each key's first row in order; null and empty keys have none."""
    w = Window.partitionBy("_k").orderBy(*order)
    d = df.withColumn("_k", key).where("_k is not null and _k <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return d.select("_k", *[v.alias(n) for n, v in values.items()])


def resolve_aliases(names: DataFrame, persons: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, name, person_id) for names(id, name), by persons(ord, person_id, person_name) and aliases(ord, alias, person_id, person_canon).

    Of persons with one name the first counts. An alias stands for the person whose name is its person_canon, else for its person_id if
    that is a person's, else for nobody; of equal aliases the first that stands for somebody counts. An alias goes before a name."""
    norm = lambda c: X.normalise_name(F.trim(F.col(c)))
    p = persons.where("trim(coalesce(person_id, '')) <> '' and trim(coalesce(person_name, '')) <> ''")
    by_name = first_of(p, norm("person_name"), ["ord"], by_name=F.trim("person_id"))
    known = p.select(F.trim("person_id").alias("person_id")).distinct().withColumn("_known", F.lit(True))
    a = aliases.withColumns({"_canon": norm("person_canon"), "person_id": F.trim("person_id")})
    a = a.join(by_name.select(F.col("_k").alias("_canon"), "by_name"), "_canon", "left").join(known, "person_id", "left")
    a = a.withColumn("target", F.coalesce("by_name", F.when(F.col("_known"), F.col("person_id")))).where("target is not null")
    by_alias = first_of(a, norm("alias"), ["ord"], by_alias=F.col("target"))
    n = names.withColumn("_k", norm("name")).join(by_alias, "_k", "left").join(by_name, "_k", "left")
    return n.select("id", "name", F.coalesce("by_alias", "by_name").alias("person_id"))


def auto_link(accounts: DataFrame, legacy: DataFrame, persons: DataFrame, variants: DataFrame) -> DataFrame:
    """(id, tier, reason, person_id) for accounts(id, real_name, legacy_id): none without a legacy account; tier3 with the reason it is no
    more; tier1 for an equal name, tier2 for a known variant, if it is the one candidate, the legacy account's person, and of one surname.

    legacy(legacy_id), persons(person_id, person_name, legacy_id), variants(a, b), which hold either way."""
    norm = lambda c: F.trim(F.lower(F.regexp_replace(c, r"\s+", " ")))
    acc = accounts.join(legacy.select("legacy_id").distinct().withColumn("_legacy", F.lit(True)), "legacy_id", "left").withColumn("_n", norm(F.col("real_name")))
    owner = persons.where("legacy_id is not null").groupBy("legacy_id").agg(F.min("person_id").alias("owner"))
    # An account needs to know whether its candidates are several: their least and greatest ids say so. Names are joined, of which many persons may have one, and not persons.
    merged = lambda df, key: df.groupBy(key).agg(F.min("pid").alias("pid"), F.max("_hi").alias("_hi"), F.max("_open").alias("_open"), F.min("kind").alias("kind"), F.min("pname").alias("pname"))
    p = persons.select(F.col("person_id").alias("pid"), F.col("person_id").alias("_hi"), F.col("person_id").isNull().alias("_open"), F.lit("exact").alias("kind"), F.col("person_name").alias("pname"), norm(F.col("person_name")).alias("_p"))
    p = merged(p, "_p")
    both = variants.select(norm(F.col("a")).alias("_n"), norm(F.col("b")).alias("_p")).union(variants.select(norm(F.col("b")), norm(F.col("a")))).distinct()
    loose = both.join(p, "_p").select("_n", "pid", "_hi", "_open", F.lit("variant").alias("kind"), "pname")
    named = merged(p.withColumnRenamed("_p", "_n").union(loose), "_n")
    c = merged(acc.select("id", "_n").join(named, "_n"), "id")
    several = (F.col("pid") < F.col("_hi")) | (F.col("_open") & F.col("pid").isNotNull())
    j = acc.join(owner, "legacy_id", "left").join(c, "id", "left")
    same = X.surname(F.col("real_name")) == X.surname(F.col("pname"))
    reason = F.when(F.col("_legacy").isNull(), None).when(F.col("owner").isNull(), "no_hp_for_legacy_account").when(F.col("kind").isNull(), "no_name_candidate").when(several, "multiple_name_candidates").when((F.col("pid") != F.col("owner")) | ~F.coalesce(same, F.lit(False)), "hp_mismatch")
    tier = F.when(F.col("_legacy").isNull(), "none").when(reason.isNotNull(), "tier3").when(F.col("kind") == "exact", "tier1").otherwise("tier2")
    return j.select("id", tier.alias("tier"), reason.alias("reason"), F.when(tier.isin("tier1", "tier2"), F.col("pid")).alias("person_id"))


def abbreviations(persons: DataFrame) -> DataFrame:
    """(stub, likely) ids: persons without events whose name may be short for that of one with events: equal text after the first space
    (four characters at least), equal first letter, and shorter. persons(person_id, person_name, event_count)."""
    after = lambda c: F.lower(F.expr(f"substring({c}, instr({c}, ' ') + 1)"))
    s = persons.where(~F.col("person_name").isin(*NOBODY) & (F.coalesce("event_count", F.lit(0)) == 0) & F.col("person_name").contains(" "))
    k = persons.where((F.col("event_count") > 0) & F.col("person_name").contains(" "))
    first = lambda c: F.lower(F.substring(c, 1, 1))
    s = s.select(F.col("person_id").alias("stub"), F.length("person_name").alias("_ls"), after("person_name").alias("_after"), first(F.replace("person_name", F.lit("."), F.lit(""))).alias("_first"))
    k = k.select(F.col("person_id").alias("likely"), F.length("person_name").alias("_lk"), after("person_name").alias("_after"), first(F.col("person_name")).alias("_first"))
    return s.join(k, ["_after", "_first"]).where("length(_after) >= 4 and _ls < _lk").select("stub", "likely")


def membership_matches(members: DataFrame, persons: DataFrame, by_alias: DataFrame) -> DataFrame:
    """(id, status, person_id, score) for members(id, name): 100 by alias (id, person_id) or equal name, 75 by a nickname and surname, 65
    by first name and surname; the best for each person, and CONFLICT (with the first name) where several persons share the best score.

    Persons are one row for each name, or first name and surname, before names are joined: their least and greatest ids say whether they are several."""
    first = lambda c: F.split(c, " ")[0]
    last = lambda c: F.element_at(F.split(c, " "), -1)
    norm = lambda c: F.trim(F.lower(F.regexp_replace(F.regexp_replace(c, r"[.,']", ""), r"\s+", " ")))
    merged = lambda df, *keys: df.groupBy(*keys).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.max("_open").alias("_open"), F.min("b").alias("b"))
    what = ["_lo", "_hi", "_open", "b"]
    one = [F.col("person_id").alias("_lo"), F.col("person_id").alias("_hi"), F.col("person_id").isNull().alias("_open"), F.struct(F.col("person_name").alias("pn"), "person_id").alias("b")]
    p = merged(persons.select(norm(F.col("person_name")).alias("m"), *one), "m").withColumns({"_f": first("m"), "_l": last("m")})
    short = merged(p.where("_l <> ''"), "_f", "_l")
    m = members.select("id", norm(F.col("name")).alias("m"))
    names = m.select("m").distinct().withColumns({"_f": first("m"), "_l": last("m")})
    nick = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in NICKNAMES.items() for x in pair])
    exact = names.select("m").join(p, "m").select("m", F.lit(100).alias("score"), *what)
    near = names.select("m", "_l", F.lit(75).alias("score"), F.explode(F.try_element_at(nick, F.col("_f"))).alias("_f")).union(names.select("m", "_l", F.lit(65), "_f"))
    near = near.join(short, ["_f", "_l"]).select("m", "score", *what)
    top = lambda df, key: merged(df, key, "score").groupBy(key).agg(F.max_by(F.struct("score", *what), "score").alias("t")).select(key, "t.*")
    alias = by_alias.join(persons, "person_id").select("id", F.lit(100).alias("score"), *one)
    best = top(m.join(top(exact.union(near), "m"), "m").select("id", "score", *what).union(alias), "id")
    several = (F.col("_lo") < F.col("_hi")) | (F.col("_open") & F.col("_lo").isNotNull())
    status = F.when(several, "CONFLICT").when(F.col("score") == 100, "MATCHED_STRONG").when(F.col("score") == 75, "MATCHED_VARIANT").otherwise("MATCHED_WEAK")
    out = members.select("id").join(best, "id", "left")
    return out.select("id", F.when(F.col("score").isNull(), "NO_MATCH").otherwise(status).alias("status"), F.col("b.person_id").alias("person_id"), F.coalesce("score", F.lit(0)).alias("score"))


def rollup_by_tier(rows: DataFrame, key: str, tier: str, ranks: dict[str, int], order: list[Column]) -> DataFrame:
    """One row of each key: that of the highest tier, then the first in order."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), F.col(tier)), F.lit(0))
    w = Window.partitionBy(key).orderBy(rank.desc(), *order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def provenance(legacy: DataFrame, persons: DataFrame, variants: DataFrame) -> DataFrame:
    """(legacy_id, person_id, grade, reason): equal names first; variants (a, b, either way) only for legacy ids that have no equal name.
    A person with several legacy ids, and a legacy id with several persons, is MEDIUM; the rest is HIGH. All names are normalised before."""
    exact = legacy.join(persons, "name").select("legacy_id", "person_id", F.lit("exact").alias("how"))
    both = variants.select(F.col("a").alias("name"), F.col("b").alias("other")).union(variants.select("b", "a")).distinct()
    loose = legacy.join(exact.select("legacy_id").distinct(), "legacy_id", "left_anti").join(both, "name").select("legacy_id", F.col("other").alias("name")).join(persons, "name").select("legacy_id", "person_id", F.lit("variant").alias("how"))
    e = exact.union(loose).groupBy("legacy_id", "person_id").agg(F.min("how").alias("how"))
    e = e.join(e.groupBy("person_id").agg(F.count("*").alias("_p")), "person_id").join(e.groupBy("legacy_id").agg(F.count("*").alias("_l")), "legacy_id")
    reason = F.when(F.col("_p") > 1, "ambiguous_multiple_legacy_matches").when(F.col("_l") > 1, "ambiguous_multiple_hp_matches").otherwise(F.col("how"))
    return e.select("legacy_id", "person_id", F.when((F.col("_p") > 1) | (F.col("_l") > 1), "MEDIUM").otherwise("HIGH").alias("grade"), reason.alias("reason"))


def suggest(unresolved: DataFrame, persons: DataFrame) -> DataFrame:
    """(name, n, person_id, how): names by how often they occur, with the one person they may be: of equal name, of equal name without a
    generation's ending, or alone with their first initial and surname. unresolved(name), persons(person_id, person_name)."""
    base = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[\s,]+(jr|sr|ii|iii|iv)\.?$", ""))
    short = lambda c: F.concat_ws(" ", F.substring(c, 1, 1), F.element_at(F.split(c, " "), -1))
    n = unresolved.groupBy("name").agg(F.count("*").alias("n")).withColumns({"_e": F.lower("name"), "_b": base(F.col("name"))}).withColumn("_s", short(F.col("_b")))
    p = persons.withColumns({"_e": F.lower("person_name"), "_b": base(F.col("person_name"))}).withColumn("_s", short(F.col("_b")))
    for k, how in (("_e", "exact"), ("_b", "suffix"), ("_s", "initial")):
        n = n.join(p.groupBy(k).agg(F.min("person_id").alias(how), F.count("*").alias("_c")).where("_c = 1").drop("_c"), k, "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("suffix").isNotNull(), "suffix").when(F.col("initial").isNotNull(), "initial")
    return n.select("name", "n", F.coalesce("exact", "suffix", "initial").alias("person_id"), how.alias("how"))


def best_event(rows: DataFrame) -> DataFrame:
    """Of events alike in year, name and place that with placements, then the most of them, then with a date, then the lowest numeric id.
    rows(id, year, name, location, date, placements)."""
    low = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    n = F.coalesce("placements", F.lit(0))
    date = (low("date") != "") & ~low("date").isin("tba", "tbd")
    number = F.try_to_number(F.when(F.col("id").rlike(r"^\d{1,18}$"), F.col("id")), F.lit("9" * 18)).cast("long")
    w = Window.partitionBy(F.coalesce(F.col("year"), F.lit(-1)), low("name"), low("location")).orderBy((n > 0).desc(), n.desc(), date.desc(), F.coalesce(number, F.lit(2**62)), "id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def register(entries: DataFrame, namespace: str) -> DataFrame:
    """(player_id, name, entries, countries): a key from the cleaned name of each person-like entry(name, country), how often it occurs, and
    the countries seen with it, the most frequent first."""
    clean = F.trim(F.regexp_replace(F.regexp_replace("name", r"\s+[A-Z]{3}$", ""), r"\s+", " "))
    e = entries.withColumn("_name", clean).where(is_person_like(F.col("_name")))
    c = e.groupBy("_name", "country").agg(F.count("*").alias("n"))
    named = F.array_sort(F.collect_list(F.when(F.coalesce("country", F.lit("")) != "", F.struct((-F.col("n")).alias("k"), F.col("country").alias("c")))))
    return c.groupBy(F.col("_name").alias("name")).agg(F.sum("n").alias("entries"), F.array_join(F.transform(named, lambda x: x["c"]), "|").alias("countries")).select(X.uuid5(namespace, F.lower("name")).alias("player_id"), "name", "entries", "countries")


def club_links(rows: DataFrame, persons: DataFrame) -> DataFrame:
    """(club, name, person_id, how) of rows(club, name): the person of just that name, if there is one; each (club, name) once."""
    p = persons.groupBy(F.lower(F.trim("person_name")).alias("_k")).agg(F.min("person_id").alias("pid"), F.count("*").alias("n"))
    r = rows.select("club", F.trim("name").alias("name")).where("coalesce(name, '') <> ''").distinct().withColumn("_k", F.lower("name")).join(p, "_k", "left")
    return r.select("club", "name", F.when(F.col("n") == 1, F.col("pid")).alias("person_id"), F.when(F.col("n") == 1, "exact").when(F.col("n") > 1, "ambiguous").otherwise("none").alias("how"))


def base_order(col: Column) -> Column:
    """Order without regard to case and accents."""
    return F.lower(X.fold_marks(col))
