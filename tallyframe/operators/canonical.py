"""The canonical tables (events, disciplines, results, participants, persons): how they are made and mended.

disciplines(event, discipline, name, category, team_type), results(event, discipline, placement), participants(event, discipline,
placement, participant_order, display_name, person_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import text as X
from tallyframe.operators.graph import merge_targets

GHOST = "__UNKNOWN_PARTNER__"
# Words that say what a discipline is.
NOT_NET = "routine freestyle shred circle sick request battle ironman combo trick golf consecutive consec distance overall".split() + ["one pass", "one-pass", "2-square", "2 square", "two square", "four square", "4-square", "4 square"]
NET = ("net", "volley", "side-out", "side out", "rallye")


def holds(text: Column, words) -> Column:
    return F.lower(text).rlike("|".join(rf"\Q{w}\E" for w in words))


def event_keys(events: DataFrame, policies: DataFrame) -> DataFrame:
    """(id, key) for events(id, year, name, series, city, date, pinned) and policies(series, policy): the pinned key, else year and series,
    with the city where the policy is always_city, or maybe_city and the key would clash; the first by (date or year, name, id) of those
    that still clash keeps the key, the others have _2, _3 and so on. Without a policy the city is never in it."""
    e = events.join(policies, "series", "left").withColumn("_city", X.slugify(F.coalesce("city", F.lit(""))))
    base = F.concat_ws("_", F.col("year").cast("string"), X.slugify(F.col("series")))
    full = F.when(F.col("_city") != "", F.concat_ws("_", base, "_city")).otherwise(base)
    e = e.withColumn("_key", F.coalesce("pinned", F.when(F.col("policy") == "always_city", full).otherwise(base))).withColumn("_full", full)
    clash = F.count("*").over(Window.partitionBy("_key")) > 1
    e = e.withColumn("_key", F.when(clash & F.col("pinned").isNull() & (F.col("policy") == "maybe_city"), F.col("_full")).otherwise(F.col("_key")))
    n = F.row_number().over(Window.partitionBy("_key").orderBy(F.col("pinned").isNull(), F.coalesce("date", F.col("year").cast("string")), F.lower("name"), "id"))
    return e.select("id", F.when(n == 1, F.col("_key")).otherwise(F.concat_ws("_", "_key", n.cast("string"))).alias("key"))


def discipline_table(placements: DataFrame) -> DataFrame:
    """(event, discipline, name, team_type, sort_order) from placements(ord, event, division, competitor_type): in the order in which an
    event's divisions are first met; their slugs, with _2 and so on where one repeats; doubles where teams outnumber players."""
    team = F.count_if(F.col("competitor_type") == "team")
    d = placements.groupBy("event", F.col("division").alias("name")).agg(F.min("ord").alias("ord"), F.when(team > F.count_if(F.col("competitor_type") != "team"), "doubles").otherwise("singles").alias("team_type"))
    d = d.withColumn("slug", X.slugify(F.col("name")))
    n = F.row_number().over(Window.partitionBy("event", "slug").orderBy("ord"))
    key = F.when(n == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", n.cast("string")))
    return d.select("event", key.alias("discipline"), "name", "team_type", F.row_number().over(Window.partitionBy("event").orderBy("ord")).alias("sort_order"))


def participant_table(placements: DataFrame) -> DataFrame:
    """(event, division, placement, participant_order, display_name): both players of each row, numbered within the placement, so that
    tied teams give 1 to 4. placements(ord, event, division, place, player1, player2)."""
    p = placements.select("ord", "event", "division", F.col("place").alias("placement"), F.posexplode(F.array("player1", "player2")).alias("pos", "display_name")).where("coalesce(display_name, '') <> ''")
    n = F.row_number().over(Window.partitionBy("event", "division", "placement").orderBy("ord", "pos"))
    return p.select("event", "division", "placement", n.alias("participant_order"), "display_name")


def person_stats(participants: DataFrame, events: DataFrame) -> DataFrame:
    """(person_id, first_year, last_year, event_count, placement_count, wins): a win counts for the first of an entry only."""
    per = participants.where("person_id is not null and person_id <> ''").groupBy("person_id", "event").agg(F.count("*").alias("n"), F.count_if((F.col("placement") == 1) & (F.col("participant_order") == 1)).alias("w"))
    return per.join(events.select("event", "year"), "event").groupBy("person_id").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count("*").alias("event_count"), F.sum("n").alias("placement_count"), F.sum("w").alias("wins"))


def density_retag(disciplines: DataFrame, participants: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Doubles whose placements all have one participant, on average just 1, are singles, but for disciplines to keep."""
    n = participants.groupBy("event", "discipline").agg(F.count("*").alias("_p"), F.countDistinct("placement").alias("_r"))
    d = disciplines.join(n, ["event", "discipline"], "left")
    thin = (F.col("team_type") == "doubles") & (F.col("_p") > 0) & (F.col("_p") == F.col("_r")) & ~F.col("discipline").isin(*keep)
    return d.withColumn("team_type", F.when(F.coalesce(thin, F.lit(False)), "singles").otherwise(F.col("team_type"))).select(*disciplines.columns)


def ghost_partners(disciplines: DataFrame, participants: DataFrame) -> DataFrame:
    """Doubles slots with a first and no second participant get a partner without a name."""
    doubles = disciplines.where("team_type = 'doubles'").select("event", "discipline")
    at = lambda n: F.count_if(F.col("participant_order") == n)
    lone = participants.join(doubles, ["event", "discipline"], "left_semi").groupBy("event", "discipline", "placement").agg(at(1).alias("_1"), at(2).alias("_2")).where("_1 > 0 and _2 = 0")
    ghosts = lone.select("event", "discipline", "placement", F.lit(2).alias("participant_order"), F.lit(GHOST).alias("display_name"), F.lit("").alias("person_id"))
    return participants.unionByName(ghosts)


def sequential_pairs(disciplines: DataFrame, participants: DataFrame) -> DataFrame:
    """(event, discipline, placement, participant_order, display_name, note): in doubles where some slot has not just two participants, all
    are dealt two by two in order, and the last alone gets a partner without a name; others stay as they are."""
    slots = participants.groupBy("event", "discipline", "placement").agg(F.count("*").alias("n")).groupBy("event", "discipline").agg(F.max(F.col("n") != 2).alias("_odd"))
    odd = disciplines.where("team_type = 'doubles'").select("event", "discipline").join(slots, ["event", "discipline"]).where("_odd").drop("_odd")
    n = F.row_number().over(Window.partitionBy("event", "discipline").orderBy("placement", "participant_order")) - 1
    p = participants.join(odd.withColumn("_deal", F.lit(True)), ["event", "discipline"], "left").withColumn("_i", n)
    deal = F.coalesce("_deal", F.lit(False))
    slot, order = F.floor(F.col("_i") / 2).cast("int") + 1, (F.col("_i") % 2 + 1).cast("int")
    note = F.when(deal & (slot != F.col("placement")), F.concat(F.lit("seq_from:"), F.col("placement").cast("string"))).otherwise("")
    out = p.select("event", "discipline", F.when(deal, slot).otherwise(F.col("placement")).alias("placement"), F.when(deal, order).otherwise(F.col("participant_order")).alias("participant_order"), "display_name", note.alias("note"), deal.alias("_d"))
    last = out.where("_d").groupBy("event", "discipline").agg(F.count("*").alias("n"), F.max("placement").alias("placement")).where("n % 2 = 1")
    ghosts = last.select("event", "discipline", "placement", F.lit(2).alias("participant_order"), F.lit(GHOST).alias("display_name"), F.lit("auto:ghost_partner").alias("note"))
    return out.drop("_d").unionByName(ghosts)


def bare_to_net(disciplines: DataFrame, *children: DataFrame) -> list[DataFrame]:
    """In events with a discipline that is plainly no net, those that say nothing are net: key, name and category, unless the key is taken;
    the new key goes on to the children."""
    name = F.col("name")
    mixed = F.max(holds(name, NOT_NET)).over(Window.partitionBy("event"))
    taken = disciplines.select("event", F.col("discipline").alias("_new")).distinct().withColumn("_taken", F.lit(True))
    d = disciplines.withColumns({"_mixed": mixed, "_new": F.concat(F.col("discipline"), F.lit("_net"))}).join(taken, ["event", "_new"], "left")
    bare = F.col("_mixed") & ~holds(name, [*NOT_NET, *NET]) & ~F.lower(F.trim(name)).isin("unknown", "") & F.col("_taken").isNull()
    d = d.withColumn("_bare", F.coalesce(bare, F.lit(False)))
    renames = d.where("_bare").select("event", "discipline", "_new").distinct()
    pick = lambda c, v: F.when(F.col("_bare"), v).otherwise(F.col(c)).alias(c)
    new = {"discipline": F.col("_new"), "name": F.concat(name, F.lit(" Net")), "category": F.lit("net")}
    out = [d.select(*[pick(c, new[c]) if c in new else F.col(c) for c in disciplines.columns])]
    return out + [c.join(renames, ["event", "discipline"], "left").withColumn("discipline", F.coalesce("_new", "discipline")).select(*c.columns) for c in children]


def exact_names(participants: DataFrame, persons: DataFrame) -> DataFrame:
    """Participants without a person get the one person of just that name."""
    one = persons.groupBy(F.col("person_name").alias("display_name")).agg(F.min("person_id").alias("_pid"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return participants.join(one, "display_name", "left").withColumn("person_id", F.coalesce(F.nullif(F.col("person_id"), F.lit("")), "_pid")).select(*participants.columns)


def overrides(events: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """changes(event, exclude, and for each field f: has_f, f): events to leave out are; a field that a change has is set, to null too."""
    c = changes.select("event", F.coalesce("exclude", F.lit(False)).alias("_x"), *[F.struct(F.coalesce(f"has_{f}", F.lit(False)).alias("has"), F.col(f).alias("v")).alias(f"_{f}") for f in fields])
    e = events.join(c, "event", "left").where(~F.coalesce("_x", F.lit(False)))
    return e.withColumns({f: F.when(F.col(f"_{f}.has"), F.col(f"_{f}.v")).otherwise(F.col(f)) for f in fields}).select(*events.columns)


def merge_by_name(persons: DataFrame, participants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Persons of one name become the one with most participations (ties: the least id); participants go with them."""
    used = participants.groupBy("person_id").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(F.lower("person_name")).orderBy(F.desc(F.coalesce("_n", F.lit(0))), "person_id")
    p = persons.join(used, "person_id", "left").withColumns({"_kept": F.first("person_id").over(w)})
    moved = p.where("person_id <> _kept").select("person_id", "_kept")
    return p.where("person_id = _kept").select(*persons.columns), participants.join(moved, "person_id", "left").withColumn("person_id", F.coalesce("_kept", "person_id")).select(*participants.columns)


def drop_noise(placements: DataFrame, tokens: list[str]) -> DataFrame:
    """Without repeated rows and rows whose player is a mere token; names and divisions with single spaces and no marks at their ends."""
    tidy = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[\s*.,;:-]+|[\s*,;:-]+$", ""))
    p = placements.withColumns({c: tidy(F.col(c)) for c in ("division", "player1", "player2")})
    return p.where(~F.lower("player1").isin(*tokens) & (F.col("player1") != "")).dropDuplicates(["event", "division", "place", "player1", "player2"])


def with_missing_class(main: DataFrame, extra: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `extra` whose keys the main table lacks, behind it."""
    return main.unionByName(extra.join(main.select(*keys).distinct(), keys, "left_anti").select(*main.columns))


SENTINELS = ("__unknown_partner__", "[unknown partner]", "__non_person__", "unknown", "tba", "?")


def platform_export(disciplines: DataFrame, results: DataFrame, participants: DataFrame, persons: DataFrame, names: DataFrame, person_like) -> dict[str, DataFrame]:
    """The canonical tables as the platform takes them, step by step.

    Disciplines with sparse coverage go, and with them their results and participants (disciplines also has coverage). Names of nobody
    become Unknown; amounts of prizes behind names go. Participants without a person get that of names(display_name, person_id,
    person_name). Persons whose name is nobody's or no name go, and no participant refers to them any more. `aka ...` goes from names,
    names in capitals get title case. Persons whom nobody refers to go; those of one name become the one most referred to."""
    keys = ["event", "discipline"]
    d = disciplines.where(F.lower(F.trim(F.coalesce("coverage", F.lit("")))) != "sparse")
    kept = d.select(*keys).distinct()
    r, p = results.join(kept, keys, "left_semi"), participants.join(kept, keys, "left_semi")
    shown = F.trim(F.regexp_replace("display_name", r"\s*\$\d[\d.,]*\s*$", ""))
    p = p.withColumn("display_name", F.when(F.lower(shown).isin(*SENTINELS) | (shown == ""), "Unknown").otherwise(shown))
    p = p.join(names.select("display_name", F.col("person_id").alias("_pid"), F.col("person_name").alias("_name")), "display_name", "left")
    fill = F.col("_pid").isNotNull() & (F.coalesce("person_id", F.lit("")) == "")
    p = p.withColumns({"person_id": F.when(fill, F.col("_pid")).otherwise(F.nullif(F.col("person_id"), F.lit(""))), "display_name": F.when(fill, F.col("_name")).otherwise(F.col("display_name"))}).drop("_pid", "_name")
    tidy = X.title_if_shouted(X.without_aka(F.col("person_name")))
    own = persons.select("person_id", tidy.alias("person_name")).unionByName(names.select("person_id", F.col("person_name")).join(persons.select("person_id"), "person_id", "left_anti").distinct())
    own = own.where((F.trim("person_name") != "") & ~F.lower("person_name").isin(*SENTINELS) & person_like(F.col("person_name")))
    p = p.join(own.select("person_id", F.lit(True).alias("_there")).distinct(), "person_id", "left").withColumn("person_id", F.when(F.col("_there"), F.col("person_id"))).drop("_there").select(*participants.columns)
    own = own.join(p.select("person_id").distinct(), "person_id", "left_semi")
    own, p = merge_by_name(own, p)
    return {"disciplines": d, "results": r, "participants": p, "persons": own}


def seed_entries(participants: DataFrame, persons: DataFrame, aliases: DataFrame, person_like, namespace: str) -> DataFrame:
    """(event, discipline, placement, participant_order, display_name, person_id, how): each participant's person, its own one, else by
    alias(alias, person_id), else by just that name, else a stub made of the name if it is one; else none. Empty names are filled from
    another entry of the same team (team_key) and place in it."""
    shown = participants.where("coalesce(display_name, '') <> '' and coalesce(team_key, '') <> ''").groupBy("team_key", "participant_order").agg(F.min("display_name").alias("_shown"))
    p = participants.join(shown, ["team_key", "participant_order"], "left").withColumn("display_name", F.coalesce(F.nullif(F.col("display_name"), F.lit("")), "_shown", F.lit("")))
    low = lambda df, c, v: df.groupBy(F.lower(c).alias("_k")).agg(F.min("person_id").alias(v))
    p = p.withColumn("_k", F.lower("display_name")).join(low(aliases, "alias", "_a"), "_k", "left").join(low(persons, "person_name", "_n"), "_k", "left")
    stub = F.when(person_like(F.col("display_name")), X.uuid5(namespace, F.col("_k")))
    own = F.nullif(F.col("person_id"), F.lit(""))
    how = F.when(own.isNotNull(), "own").when(F.col("_a").isNotNull(), "alias").when(F.col("_n").isNotNull(), "name").when(stub.isNotNull(), "stub").otherwise("none")
    return p.select("event", "discipline", "placement", "participant_order", "display_name", F.coalesce(own, "_a", "_n", stub).alias("person_id"), how.alias("how"))


def persons_master(canonical: DataFrame, provisional: DataFrame, promoted: DataFrame, club_only: DataFrame) -> DataFrame:
    """(master_id, person_name, person_type, source): canonical persons (person_id, person_name); provisional ones (person_name, source) that
    are not promoted(person_name) to one, and whose name no canonical person has; then names known from clubs alone (person_name). Keys of
    the last two depend on the name alone."""
    k = lambda c: F.trim(F.lower(F.regexp_replace(c, r"\s+", " ")))
    c = canonical.select("person_id", "person_name", k("person_name").alias("_k"))
    v = provisional.select("person_name", "source", k("person_name").alias("_k")).join(promoted.select(k("person_name").alias("_k")).distinct(), "_k", "left_anti").join(c.select("_k"), "_k", "left_anti")
    v = v.groupBy("_k").agg(F.min("person_name").alias("person_name"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("source"))
    o = club_only.select("person_name", k("person_name").alias("_k")).join(c.select("_k").union(v.select("_k")), "_k", "left_anti").join(promoted.select(k("person_name").alias("_k")), "_k", "left_anti").groupBy("_k").agg(F.min("person_name").alias("person_name"))
    out = c.select(F.col("person_id").alias("master_id"), "person_name", F.lit("CANONICAL").alias("person_type"), F.lit("RESULTS").alias("source"))
    out = out.union(v.select(X.sha1_key("prov_person::", F.col("_k")), "person_name", F.lit("PROVISIONAL"), "source"))
    return out.union(o.select(X.sha1_key("club_person::", F.col("_k")), "person_name", F.lit("CLUB_ONLY"), F.lit("CLUBS")))


def adjudicate(events: DataFrame, decisions: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, results) after decisions(event, target, action): suppress drops an event and its results; merge moves the results of an
    event to its target, where rows that are there already are not doubled, and adds `conflict` where a place then has several names.

    Merges are closed first (graph.merge_targets): along a chain results go to its end, round a cycle to its least event. What is merged
    into a suppressed event goes with it. No result is left at an event that is gone."""
    moved = merge_targets(decisions.where("action = 'merge'"), "event", "target").where("node <> survivor").select(F.col("node").alias("event"), "survivor")
    dropped = decisions.where("action = 'suppress'").select("event").distinct()
    gone = moved.select("event").union(dropped).distinct()
    r = results.join(dropped, "event", "left_anti").join(moved, "event", "left").withColumn("event", F.coalesce("survivor", "event")).drop("survivor").join(dropped, "event", "left_anti")
    r = r.dropDuplicates(["event", "discipline", "placement", "name"])
    n = r.groupBy("event", "discipline", "placement").agg(F.count("*").alias("_n"))
    return events.join(gone, "event", "left_anti"), r.join(n, ["event", "discipline", "placement"]).withColumn("conflict", F.col("_n") > 1).drop("_n")
