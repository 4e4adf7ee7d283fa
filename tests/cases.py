"""Cases stated in rows: their SQL is the answer, worked out by hand, and not a second form of the rule. Each is a unit test of its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import text as X
from tallyframe.operators import audits as A
from tallyframe.operators import canonical as C
from tallyframe.operators import clubs as K
from tallyframe.operators import mining as M
from tallyframe.operators import people as P
from tallyframe.operators import quality as Q
from tallyframe.operators import results_text as R
from tallyframe.operators import shaping as S
from tallyframe.operators import teams as T
from tallyframe.operators import windows as V
from tallyframe.operators import writes as W
from tallyframe.sources import readers


CASES: dict = {}


def query(sql: str):
    def add(f):
        CASES[f.__name__] = (f, sql)
        return f

    return add


def given(t, names: str, *rows: tuple) -> DataFrame:
    """A table of these rows; values are written as SQL literals."""
    literal = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"{x}D" if isinstance(x, float) else "'" + x.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"
    return t._spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)} AS v({names})")


def answer(names: str, *rows: tuple) -> str:
    """The SQL of a table of these rows; a name may have its type behind it, where the values alone say another."""
    literal = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"{x}::DOUBLE" if isinstance(x, float) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    columns = [n.strip().split(" ") for n in names.split(",")]
    typed = ", ".join(f"CAST({n[0]} AS {n[1]}) AS {n[0]}" if n[1:] else n[0] for n in columns)
    return f"SELECT {typed} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) v({', '.join(n[0] for n in columns)})"


PAGE = """Welcome to the 12th annual gathering
ATTENDEES:
Dan North (Intermediate: Sick 1)
175 Mill Road
Open Singles Net:
1. Ana Ruiz
2. Bo Lindqvist (SWE)
9.-12. Cy Young
Open Doubles Net - Initial Seeding
1. Wrong Seed / Other Seed
Open Doubles Net - Final Results
1. Ana Ruiz & Bo Lindqvist
2) Dee Fox / Eli Hart/Gus Poe
3rd Hal Ives and Ida Jay
OSR
Kim Lee Oak
2nd Place
Lou Mae Nix
& continued on the next page
Intermediate Shred: Max Orr
Women's Circle 1. Pia Quinn
Sick 3
1. Rex Stone
1. rex stone
2. Pixie > Whirl > Blender
3. Sue Tate and the rest was in my view great
4. 19:30 start
100. Too Far
"""


@query(answer(
    "event_id, line_no, division, category, place, competitor_type, player1, player2, confidence",
    (1, 5, "Open Singles Net", "net", 1, "player", "Ana Ruiz", "", "high"),
    (1, 6, "Open Singles Net", "net", 2, "player", "Bo Lindqvist (SWE)", "", "high"),
    (1, 7, "Open Singles Net", "net", 9, "player", "Cy Young", "", "high"),
    (1, 11, "Open Doubles Net", "net", 1, "team", "Ana Ruiz", "Bo Lindqvist", "high"),
    (1, 12, "Open Doubles Net", "net", 2, "team", "Dee Fox", "Eli Hart", "high"),
    (1, 13, "Open Doubles Net", "net", 3, "team", "Hal Ives", "Ida Jay", "high"),
    (1, 15, "Open Singles Routines", "freestyle", 1, "player", "Kim Lee Oak", "", "high"),
    (1, 17, "Open Singles Routines", "freestyle", 2, "player", "Lou Mae Nix", "", "high"),
    (1, 19, "Intermediate Shred", "freestyle", 1, "player", "Max Orr", "", "high"),
    (1, 20, "Women's Circle", "freestyle", 1, "player", "Pia Quinn", "", "high"),
    (1, 22, "Sick 3", "freestyle", 1, "player", "Rex Stone", "", "high"),
    (2, 0, "Unknown", "unknown", 1, "player", "Solo Runner", "", "medium"),
    (2, 1, "Unknown", "unknown", 2, "team", "Odd {Name", "Other One", "low"),
))
def parsed_results(t):
    return R.parse_results(given(t, "event_id, text", (1, PAGE), (2, "1. Solo Runner\n2. Odd {Name & Other One"), (3, ""), (4, None)))


@query(answer(
    "name, event_type, category",
    ("Open Singles Net", None, "net"), ("Open Net Routines", None, "net"), ("Shred 30", None, "freestyle"), ("Golf Open", None, "golf"), ("Timed Consecutives", None, "sideline"), ("Individual Overall", None, "overall"),
    ("Open Doubles", "net", "net"), ("Open Doubles", "worlds", "net"), ("Open", "worlds", "unknown"), ("Open", "mixed", "net"), ("Unknown", "mixed", "unknown"), ("Open", "social", "unknown"), ("", "net", "unknown"), (None, "net", "unknown"),
))
def division_categories(t):
    names = given(t, "name, event_type", ("Open Singles Net", None), ("Open Net Routines", None), ("Shred 30", None), ("Golf Open", None), ("Timed Consecutives", None), ("Individual Overall", None), ("Open Doubles", "net"), ("Open Doubles", "worlds"), ("Open", "worlds"), ("Open", "mixed"), ("Unknown", "mixed"), ("Open", "social"), ("", "net"), (None, "net"))
    return names.withColumn("category", R.division_category(F.col("name"), F.col("event_type")))


@query(answer(
    "id, event_type",
    (1, "worlds"), (2, "golf"), (3, "mixed"), (4, "net"), (5, "freestyle"), (6, "freestyle"), (7, "social"), (8, "net"), (9, "mixed"), (10, "social"),
))
def event_type_inference(t):
    events = given(t, "id, event_name, results_raw", (1, "World Footbag Championships 2001", "golf"), (2, "Spring Meet", ""), (3, "Spring Meet", ""), (4, "Shred Meet", ""), (5, "Meet", None), (6, "Winter Jam", ""), (7, "Four Square Day", ""), (8, "Meet", "Ann 21-16, 21-11 Bob"), (9, "Summer Open", ""), (10, None, None))
    kinds = given(t, "id, division_category", (2, "golf"), (3, "net"), (3, "freestyle"), (3, "golf"), (4, "net"), (5, "freestyle"), (9, "unknown"))
    return R.event_types(events, kinds, "id")


# Persons.


@query(answer("id, person_like", (1, True), (2, False), (3, False), (4, False), (5, False), (6, False), (7, False), (8, False), (9, False), (10, True), (11, False), (12, False), (13, False), (14, False), (15, False)))
def person_gate(t):
    n = given(t, "id, name", (1, "Ana Ruiz"), (2, "Ana"), (3, "A. Ruiz"), (4, "Ana R"), (5, "ANA RUIZ"), (6, "Ana Ruiz, Lima"), (7, "Ana & Bo/Cy Dee"), (8, "ana Ruiz"), (9, "Round Robin results"), (10, "Éva Kőszegi"), (11, "Ana Ruiz *"), (12, "US 12"), (13, "Ana or Bo Dee"), (14, ""), (15, None))
    return n.select("id", P.is_person_like(F.col("name")).alias("person_like"))


@query(answer("id, name, person_id", (1, "ana RUIZ", "p1"), (2, "Anita Ruiz", "p1"), (3, "Bo-Lind", "p3"), (4, "Stale Name", None), (5, "Nobody Here", None), (6, "José Paz", "p4"), (7, "Cy Young", "p6"), (8, "", None)))
def alias_resolution(t):
    persons = given(t, "ord, person_id, person_name", (1, "p1", "Ana Ruiz"), (2, "p2", "Ana  Ruiz"), (3, "p3", "Bo Lind"), (4, "p4", "Jose Paz"), (5, "p5", "Cy Young"), (6, "p6", "Cyrus Young"), (7, " ", "Ghost"))
    aliases = given(t, "ord, alias, person_id, person_canon", (1, "Anita Ruiz", "px", "Ana Ruiz"), (2, "Anita Ruiz", "p3", "Bo Lind"), (3, "Stale Name", "gone", "Not There"), (4, "Cy Young", "p5", "Cyrus Young"), (5, "", "p1", "Ana Ruiz"))
    names = given(t, "id, name", (1, "ana RUIZ"), (2, "Anita Ruiz"), (3, "Bo-Lind"), (4, "Stale Name"), (5, "Nobody Here"), (6, "José Paz"), (7, "Cy Young"), (8, ""))
    return P.resolve_aliases(names, persons, aliases)


@query(answer(
    "id, tier, reason, person_id",
    (1, "tier1", None, "h1"), (2, "tier2", None, "h2"), (3, "none", None, None), (4, "tier3", "no_hp_for_legacy_account", None), (5, "tier3", "no_name_candidate", None), (6, "tier3", "multiple_name_candidates", None), (7, "tier3", "hp_mismatch", None), (8, "tier3", "hp_mismatch", None), (9, "none", None, None),
))
def auto_link_tiers(t):
    accounts = given(t, "id, real_name, legacy_id", (1, "Ana  Ruiz", "l1"), (2, "Bobby Lind", "l2"), (3, "Ana Ruiz", None), (4, "Ana Ruiz", "l4"), (5, "Not Known", "l1"), (6, "Sam Same", "l6"), (7, "Ana Ruiz", "l2"), (8, "Cy Young Old", "l8"), (9, "Ana Ruiz", "absent"))
    persons = given(t, "person_id, person_name, legacy_id", ("h1", "Ana Ruiz", "l1"), ("h2", "Bob Lind", "l2"), ("h6", "Sam Same", "l6"), ("h7", "Sam Same", None), ("h8", "Cy Young", "l8"))
    legacy = given(t, "legacy_id", ("l1",), ("l2",), ("l4",), ("l6",), ("l8",))
    return P.auto_link(accounts, legacy, persons, given(t, "a, b", ("Bob Lind", "Bobby Lind"), ("Cy Young Old", "Cy Young")))


@query(answer("stub, likely", ("s1", "k1"), ("s1", "k4"), ("s2", "k1"), ("s2", "k4"), ("k3", "k4")))
def abbreviation_clusters(t):
    return P.abbreviations(given(t, "person_id, person_name, event_count", ("s1", "A. Ruizmann", 0), ("s2", "An Ruizmann", None), ("s3", "B Ruizmann", 0), ("s4", "A Poe", 0), ("s5", "Unknown", 0), ("k1", "Ana Ruizmann", 4), ("k2", "Al Poe", 3), ("k3", "Ana Ruizmann", 0), ("k4", "Adam ruizmann", 1)))


@query(answer("id, status, person_id, score", (1, "MATCHED_STRONG", "p1", 100), (2, "MATCHED_VARIANT", "p2", 75), (3, "MATCHED_WEAK", "p3", 65), (4, "CONFLICT", "p4", 100), (5, "NO_MATCH", None, 0), (6, "MATCHED_STRONG", "p3", 100)))
def membership_scores(t):
    members = given(t, "id, name", (1, "Ana Ruiz"), (2, "Dave Lind"), (3, "Cy Q. Young"), (4, "Sam Same"), (5, "No One"), (6, "The Cyclone"))
    persons = given(t, "person_id, person_name", ("p1", "Ana  Ruiz"), ("p2", "David Lind"), ("p3", "Cy Young"), ("p4", "Sam Same"), ("p5", "Sam Same"))
    return P.membership_matches(members, persons, given(t, "id, person_id", (6, "p3")))


@query(answer("member, tier, expiration", ("a", "provisional_lifetime", "2001"), ("b", "provisional_annual_active", "2009"), ("c", "other", "2000")))
def tier_rollup(t):
    rows = given(t, "member, tier, expiration", ("a", "provisional_expired", "2010"), ("a", "provisional_lifetime", "2001"), ("b", "provisional_annual_active", "2008"), ("b", "provisional_annual_active", "2009"), ("c", "other", "2000"))
    return P.rollup_by_tier(rows, "member", "tier", {"provisional_lifetime": 3, "provisional_annual_active": 2, "provisional_expired": 1}, [F.desc("expiration")])


@query(answer("legacy_id, person_id, grade, reason", ("l1", "p1", "HIGH", "exact"), ("l2", "p2", "HIGH", "variant"), ("l3", "p3", "MEDIUM", "ambiguous_multiple_legacy_matches"), ("l4", "p3", "MEDIUM", "ambiguous_multiple_legacy_matches"), ("l5", "p5", "MEDIUM", "ambiguous_multiple_hp_matches"), ("l5", "p6", "MEDIUM", "ambiguous_multiple_hp_matches")))
def provenance_candidates(t):
    legacy = given(t, "legacy_id, name", ("l1", "ana ruiz"), ("l2", "bobby lind"), ("l3", "cy young"), ("l4", "cy young"), ("l5", "sam same"), ("l6", "nobody"))
    persons = given(t, "person_id, name", ("p1", "ana ruiz"), ("p2", "bob lind"), ("p3", "cy young"), ("p5", "sam same"), ("p6", "sam same"), ("p7", "anna ruiz"))
    return P.provenance(legacy, persons, given(t, "a, b", ("bob lind", "bobby lind"), ("ana ruiz", "anna ruiz")))


@query(answer("name, n BIGINT, person_id, how", ("Ana Ruiz", 2, "p1", "exact"), ("Bob Lind Jr.", 1, "p2", "suffix"), ("C Young", 1, "p3", "initial"), ("Nobody Here", 1, None, None), ("S Same", 1, None, None)))
def unresolved_suggestions(t):
    names = given(t, "name", ("Ana Ruiz",), ("Ana Ruiz",), ("Bob Lind Jr.",), ("C Young",), ("Nobody Here",), ("S Same",))
    return P.suggest(names, given(t, "person_id, person_name", ("p1", "ana ruiz"), ("p2", "Bob Lind"), ("p3", "Cy Young"), ("p4", "Sam Same"), ("p5", "Sue Same")))


# Clubs.
CLUBS = "club, last_hosted_year, ever_hosted, last_updated_year, created_year, contact_member_id, contact_member_last_year, max_member_last_year, unique_members, linkable_members, has_description"


@query(answer("club, rules, category, substitute", ("a", "1,6", "pre_populate", 0), ("b", "2,6,7", "pre_populate", 0), ("c", "3,5,7,8", "pre_populate", 1), ("d", "8", "onboarding_visible", 0), ("e", "7", "onboarding_visible", 0), ("f", "10", "onboarding_visible", 0), ("g", "", "dormant", 0), ("h", "", "junk", 0), ("i", "5,8", "onboarding_visible", 1), ("j", "9", "onboarding_visible", 0)))
def club_rules(t):
    rows = given(
        t, CLUBS,
        ("a", 2021, 1, None, 1999, None, None, None, 0, 0, False), ("b", 2001, 1, 2020, 1999, "m1", 2010, None, 0, 0, True), ("c", None, 0, 2022, 2001, "", None, 2023, 2, 1, True), ("d", None, 0, None, None, "m2", 2019, 2021, 1, 1, True), ("e", None, 0, 2016, 2015, None, None, 2015, 0, 0, False),
        ("f", None, 0, 2016, 2016, None, None, None, 10, 0, True), ("g", None, 0, 2015, 2001, None, None, 2019, 9, 2, True), ("h", None, 0, None, None, None, None, None, None, None, False), ("i", None, 0, None, None, None, None, 2020, 0, 0, False), ("j", None, 0, 2022, 2022, "m3", None, None, 0, 0, None),
    )
    c = K.classify_clubs(rows.withColumns({x: F.col(x).cast("int") for x in ("last_hosted_year", "contact_member_last_year")}))
    rules = F.array_join(F.filter(F.array(*[F.when(F.col(f"R{i}") == 1, str(i)) for i in range(1, 11)]), lambda x: x.isNotNull()), ",")
    return c.select("club", rules.alias("rules"), "category", F.col("contact_signal_substitute_applied").alias("substitute"))


@query(answer("club, score", ("a", 1.0), ("b", 0.4), ("c", 0.3), ("d", 0.0)))
def club_scores(t):
    rows = given(t, "club, has_name, has_country, has_city, has_contact_email, has_description, has_external_url, linkable_members", ("a", True, True, True, True, True, True, 25), ("b", True, True, False, False, False, False, 0), ("c", True, False, True, False, False, True, 1), ("d", True, None, None, None, None, None, None))
    return K.club_score(rows).select("club", "score")


@query(answer("club_key, person_id, role, selection_rank", ("a", "p2", "leader", 1), ("b", "q1", "leader", 1), ("b", "q2", "co_leader", 2), ("c", "r2", "leader", 1)))
def club_leaders(t):
    rows = given(t, "club_key, person_id, person_name, mirror_member_id, person", ("a", "p1", "Zoe", "", ""), ("a", "p2", "Yan", "m", "x"), *[("b", f"q{i}", f"Name {i}", "m", "x") for i in range(1, 6)], ("c", "r1", "Bea", "m", "x"), ("c", "r2", "Abe", "m", "x"))
    return K.leaders(K.affiliations(rows.withColumnRenamed("person_id", "pid").withColumnRenamed("person", "person_id")).drop("person_id").withColumnRenamed("pid", "person_id"))


@query(answer("country, region, total BIGINT, clubs", ("X", "North", 3, "a|b"), ("X", "South", 3, "c"), ("Y", None, 2, "d|e"), ("Z", None, 2, "f|g")))
def clubs_by_region(t):
    return K.by_region(given(t, "country, region, club", ("X", "North", "b"), ("X", "North", "a"), ("X", "South", "c"), ("Y", "East", "d"), ("Y", "East", "e"), ("Z", "West", "f"), ("Z", "", "g")))


# What pages show.


@query(answer("event, nth, discipline, shown", ("e1", 1, "Open Routines", "1:Ana"), ("e1", 2, "Open Doubles Net", "1:Ana+Bo;2:Cy+Dee"), ("e1", 3, "Mixed Doubles Net", "1:Eve+Fay"), ("e1", 4, "Golf", "1:Gus"), ("e2", 1, "Golf", "1:Hal")))
def nested_results(t):
    rows = given(
        t, "ord, event, discipline, category, entry, placement, score, name, participant_order",
        (1, "e1", "Golf", "golf", "r1", 1, None, "Gus", 1), (2, "e1", "Mixed Doubles Net", "net", "r2", 1, None, "Fay", 2), (3, "e1", "Mixed Doubles Net", "net", "r2", 1, None, "Eve", 1), (4, "e1", "Open Doubles Net", "net", "r3", 1, "15-9", "Ana", 1), (5, "e1", "Open Doubles Net", "net", "r3", 1, "15-9", "Bo", 2),
        (6, "e1", "Open Doubles Net", "net", "r4", 2, None, "Cy", 1), (7, "e1", "Open Doubles Net", "net", "r4", 2, None, "Dee", 2), (8, "e1", "Open Routines", "freestyle", "r5", 1, None, "Ana", 1), (9, "e2", "Golf", "golf", "r6", 1, None, "Hal", 1),
    )
    one = lambda p: F.concat_ws(":", p["placement"].cast("string"), F.array_join(p["participants"], "+"))
    return S.sections(rows).select("event", "nth", "discipline", F.array_join(F.transform("placements", one), ";").alias("shown"))


@query(answer("event, discipline, placement, prefix, mates", ("e1", "Doubles", 1, "With partner: ", "Bo"), ("e1", "Team", 2, "With partners: ", "Bo, Cy"), ("e1", "Singles", 3, "Tied with: ", "Dee"), ("e2", None, 1, "", "")))
def teammates_of(t):
    rows = given(t, "ord, event, discipline, team_type, placement, person_id, name", (1, "e1", "Doubles", "doubles", 1, "me", "Ana"), (2, "e1", "Doubles", "doubles", 1, "b", "Bo"), (3, "e1", "Team", "team", 2, "b", "Bo"), (4, "e1", "Team", "team", 2, "me", "Ana"), (5, "e1", "Team", "team", 2, None, "Cy"), (6, "e1", "Team", "team", 2, "c", "Cy"), (7, "e1", "Singles", "singles", 3, "me", "Ana"), (8, "e1", "Singles", "singles", 3, "d", "Dee"), (9, "e2", None, "singles", 1, "me", "Ana"))
    return S.teammates(rows, "me")


@query(answer("name, href, has_more, too_short", ("Ana Ruiz", "/members/ana", True, False), ("Anders Poe", "/members/anders", True, False), ("Anka Old", "/history/p3", True, False)))
def search_merge(t):
    members = given(t, "slug, name", ("ana", "Ana Ruiz"), ("anders", "Anders Poe"), ("bo", "Bo Lind"))
    persons = given(t, "person_id, name, slug", ("p1", "Ana Ruiz", "ana"), ("p3", "Anka Old", None), ("p4", "Annie Old", None), ("p5", "Cy Young", None))
    rows, facts = S.search(members, persons, " AN ", 3)
    return rows.crossJoin(F.broadcast(facts))  # one row of facts


@query(answer("name, bonus BIGINT, composition", ("spinning whirl", 2, "whirl (3) + spinning (+2 on rotational base) = 5"), ("spinning ducking clipper", 2, "clipper (2) + spinning (+1) + ducking (+1) = 4")))
def add_compositions(t):
    tricks = given(t, "name, adds, base", ("whirl", "3", None), ("clipper", "2", None), ("spinning whirl", "5", "whirl"), ("spinning ducking clipper", None, "clipper"), ("odd clipper", "3", "clipper"), ("modifier", "modifier", "x"))
    return S.compositions(tricks, given(t, "slug, modifier, add_bonus, add_bonus_rotational", ("spinning", "spinning", 1, 2), ("ducking", "ducking", 1, 1)))


@query(answer("family, members", ("whirl", "spinning whirl|whirl"), ("clipper", "clipper|ducking clipper")))
def trick_families(t):
    return S.families(given(t, "family, trick", ("clipper", "clipper"), ("clipper", "ducking clipper"), ("whirl", "whirl"), ("whirl", "spinning whirl"), ("lone", "lone"), (None, "x")), "family", "trick", {"whirl": 0, "clipper": 1})


@query(answer("key, value, n BIGINT", ("reason", "a", 3), ("reason", "b", 1), ("status", "open", 2), ("status", "done", 2)))
def queue_marginals(t):
    return S.marginals(given(t, "reason, status", ("a", "open"), ("a", "open"), ("a", "done"), ("b", "done")), ["reason", "status"])


# Canonical tables.


@query(answer("id, key", (1, "2001_spring_open"), (2, "2001_spring_open_2"), (3, "2001_fall_lima"), (4, "pinned_key"), (5, "2002_cup_oslo"), (6, "2002_cup_rome"), (7, "2003_cup"), (8, "2001_spring_open_3")))
def event_key_policy(t):
    events = given(t, "id, year, name, series, city, date, pinned", (1, 2001, "B", "Spring Open", "Lima", "2001-03-01", None), (2, 2001, "A", "Spring Open", "Oslo", "2001-04-01", None), (3, 2001, "F", "Fall", "Lima", "2001-09-01", None), (4, 2001, "P", "Fall", "Rome", None, "pinned_key"), (5, 2002, "C", "Cup", "Oslo", None, None), (6, 2002, "C", "Cup", "Rome", None, None), (7, 2003, "C", "Cup", "Rome", None, None), (8, 2001, "a", "Spring Open", "Bonn", "2001-04-01", None))
    return C.event_keys(events, given(t, "series, policy", ("Fall", "always_city"), ("Cup", "maybe_city"), ("Spring Open", "never")))


@query(answer("event, discipline, name, team_type, sort_order", ("e", "open_net", "Open Net", "doubles", 1), ("e", "open_net_2", "Open-Net", "singles", 2), ("e", "golf", "Golf", "singles", 3)))
def discipline_keys(t):
    return C.discipline_table(given(t, "ord, event, division, competitor_type", (1, "e", "Open Net", "team"), (2, "e", "Open-Net", "player"), (3, "e", "Open Net", "team"), (4, "e", "Open Net", "player"), (5, "e", "Golf", "team"), (6, "e", "Golf", "player")))


@query(answer("event, division, placement, participant_order, display_name", ("e", "D", 1, 1, "Ana"), ("e", "D", 1, 2, "Bo"), ("e", "D", 1, 3, "Cy"), ("e", "D", 1, 4, "Dee"), ("e", "D", 3, 1, "Eve")))
def participant_orders(t):
    return C.participant_table(given(t, "ord, event, division, place, player1, player2", (1, "e", "D", 1, "Ana", "Bo"), (2, "e", "D", 1, "Cy", "Dee"), (3, "e", "D", 3, "Eve", "")))


@query(answer("person_id, first_year, last_year, event_count BIGINT, placement_count BIGINT, wins BIGINT", ("a", 2001, 2003, 2, 3, 2), ("b", 2001, 2001, 1, 2, 0)))
def canonical_person_stats(t):
    p = given(t, "event, placement, participant_order, person_id", ("e1", 1, 1, "a"), ("e1", 1, 2, "b"), ("e1", 2, 1, "b"), ("e2", 1, 1, "a"), ("e2", 3, 1, "a"), ("e2", 4, 1, ""))
    return C.person_stats(p, given(t, "event, year", ("e1", 2001), ("e2", 2003)))


DISCIPLINES = "event, discipline, name, category, team_type"
PARTICIPANTS = "event, discipline, placement, participant_order, display_name, person_id"


@query(answer("event, discipline, team_type", ("e", "thin", "singles"), ("e", "full", "doubles"), ("e", "kept", "doubles"), ("e", "none", "doubles"), ("e", "single", "singles")))
def density_singles(t):
    d = given(t, DISCIPLINES, *[("e", x, x, "net", "singles" if x == "single" else "doubles") for x in ("thin", "full", "kept", "none", "single")])
    p = given(t, PARTICIPANTS, *[("e", x, n, o, f"N{n}{o}", "") for x, slots in (("thin", ((1, 1), (2, 1))), ("full", ((1, 1), (1, 2))), ("kept", ((1, 1), (2, 1))), ("single", ((1, 1),))) for n, o in slots])
    return C.density_retag(d, p, ["kept"]).select("event", "discipline", "team_type")


@query(answer("placement, participant_order, display_name", (1, 1, "Ana"), (1, 2, "Bo"), (2, 1, "Cy"), (2, 2, "__UNKNOWN_PARTNER__"), (3, 2, "Dee")))
def ghosts_added(t):
    p = given(t, PARTICIPANTS, ("e", "d", 1, 1, "Ana", ""), ("e", "d", 1, 2, "Bo", ""), ("e", "d", 2, 1, "Cy", ""), ("e", "d", 3, 2, "Dee", ""))
    return C.ghost_partners(given(t, DISCIPLINES, ("e", "d", "D", "net", "doubles")), p).select("placement", "participant_order", "display_name")


@query(answer("discipline, placement, participant_order, display_name, note", ("odd", 1, 1, "Ana", ""), ("odd", 1, 2, "Bo", ""), ("odd", 2, 1, "Cy", "seq_from:1"), ("odd", 2, 2, "Dee", "seq_from:1"), ("odd", 3, 1, "Eve", "seq_from:2"), ("odd", 3, 2, "__UNKNOWN_PARTNER__", "auto:ghost_partner"), ("even", 4, 1, "Fay", ""), ("even", 4, 2, "Gus", "")))
def pairs_in_sequence(t):
    d = given(t, DISCIPLINES, ("e", "odd", "O", "net", "doubles"), ("e", "even", "E", "net", "doubles"))
    p = given(t, PARTICIPANTS, ("e", "odd", 1, 1, "Ana", ""), ("e", "odd", 1, 2, "Bo", ""), ("e", "odd", 1, 3, "Cy", ""), ("e", "odd", 1, 4, "Dee", ""), ("e", "odd", 2, 1, "Eve", ""), ("e", "even", 4, 1, "Fay", ""), ("e", "even", 4, 2, "Gus", ""))
    return C.sequential_pairs(d, p).select("discipline", "placement", "participant_order", "display_name", "note")


@query(answer("event, discipline, name, category, parts BIGINT", ("m", "open_net", "Open Net", "net", 1), ("m", "routines", "Routines", "freestyle", 0), ("m", "mixed", "Mixed", "unknown", 1), ("m", "mixed_net", "Mixed Net", "net", 0), ("m", "unknown", "Unknown", "unknown", 0), ("s", "open", "Open", "unknown", 1)))
def bare_labels_to_net(t):
    d = given(t, DISCIPLINES, ("m", "open", "Open", "unknown", "singles"), ("m", "routines", "Routines", "freestyle", "singles"), ("m", "mixed", "Mixed", "unknown", "doubles"), ("m", "mixed_net", "Mixed Net", "net", "doubles"), ("m", "unknown", "Unknown", "unknown", "singles"), ("s", "open", "Open", "unknown", "singles"))
    d, p = C.bare_to_net(d, given(t, PARTICIPANTS, ("m", "open", 1, 1, "Ana", ""), ("m", "mixed", 1, 1, "Bo", ""), ("s", "open", 1, 1, "Cy", "")))
    n = p.groupBy("event", "discipline").agg(F.count("*").alias("parts"))
    return d.join(n, ["event", "discipline"], "left").select("event", "discipline", "name", "category", F.coalesce("parts", F.lit(0)).cast("long").alias("parts"))


@query(answer("event, name, status", ("a", "New", "old"), ("b", "B", None), ("d", "D", "x")))
def event_overrides(t):
    e = given(t, "event, name, status", ("a", "A", "old"), ("b", "B", "old"), ("c", "C", "x"), ("d", "D", "x"))
    return C.overrides(e, given(t, "event, exclude, has_name, name, has_status, status", ("a", False, True, "New", False, "ignored"), ("b", None, False, None, True, None), ("c", True, False, None, False, None)), ["name", "status"])


@query(answer("person_id, person_name, used BIGINT", ("p2", "Ana Ruiz", 3), ("p3", "Bo Lind", 1)))
def persons_merged(t):
    persons, parts = C.merge_by_name(given(t, "person_id, person_name", ("p1", "ana ruiz"), ("p2", "Ana Ruiz"), ("p3", "Bo Lind")), given(t, "person_id, entry", ("p1", 1), ("p2", 2), ("p2", 3), ("p3", 4)))
    return persons.join(parts.groupBy("person_id").agg(F.count("*").alias("used")), "person_id")


@query(answer("display_name, person_id", ("Ana Ruiz", "p1"), ("Sam Same", ""), ("Bo Lind", "kept"), ("No One", "")))
def exact_name_fill(t):
    p = given(t, PARTICIPANTS, ("e", "d", 1, 1, "Ana Ruiz", ""), ("e", "d", 2, 1, "Sam Same", None), ("e", "d", 3, 1, "Bo Lind", "kept"), ("e", "d", 4, 1, "No One", ""))
    found = C.exact_names(p, given(t, "person_id, person_name", ("p1", "Ana Ruiz"), ("p2", "Sam Same"), ("p3", "Sam Same"), ("p4", "Bo Lind")))
    return found.select("display_name", F.coalesce("person_id", F.lit("")).alias("person_id"))


@query(answer("event, division, place, player1, player2", ("e", "Open Net", 1, "Ana Ruiz", "Bo"), ("e", "Golf", 1, "Cy", "")))
def structural_cleanup(t):
    return C.drop_noise(given(t, "event, division, place, player1, player2", ("e", "Open  Net:", 1, "Ana  Ruiz*", "Bo"), ("e", "Open Net", 1, "Ana Ruiz", "Bo"), ("e", "Golf", 1, "- Cy", ""), ("e", "Golf", 2, "TBA", ""), ("e", "Golf", 3, "***", "")), ["tba", "n/a"])


# Teams.


@query(answer("name, team_type, canonical_group, match_method, review_needed, conflict_flag", ("Intermediate Women's Doubles Net", "doubles", "intermediate_doubles", "pattern", 1, 1), ("Open Singles Net", "singles", "open_singles", "pattern", 0, 0), ("Mixed Net", "singles", "uncategorized", "pattern", 1, 1), ("Mixed Doubles", "doubles", "mixed_doubles", "pattern", 0, 0), ("Pro Net", "singles", "other_singles", "pattern", 0, 0), ("Net", "doubles", "uncategorized", "fallback", 1, 0), ("Kick Volley", None, "open_singles", "fallback", 0, 0), ("Advanced Pro", "doubles", "other_doubles", "pattern", 0, 0), ("Misc 2", "doubles", "uncategorized", "fallback", 1, 0)))
def net_groups(t):
    d = given(t, "name, team_type", ("Intermediate Women's Doubles Net", "doubles"), ("Open Singles Net", "singles"), ("Mixed Net", "singles"), ("Mixed Doubles", "doubles"), ("Pro Net", "singles"), ("Net", "doubles"), ("Kick Volley", None), ("Advanced Pro", "doubles"), ("Misc 2", "doubles"))
    return T.discipline_groups(d, ["misc"])


ENTRIES = (("r1", "e1", "d1", "Open Doubles", 4, 2001, ("a", "b")), ("r2", "e1", "d1", "Open Doubles", 1, 2001, ("b", "a")), ("r3", "e2", "d2", "Singles Net", 2, 2004, ("a", "b")), ("r4", "e1", "d1", "Open Doubles", 5, 2001, ("a",)), ("r5", "e1", "d1", "Open Doubles", 6, 2001, ("a", None)), ("r6", "e1", "d1", "Open Doubles", 7, 2001, ("a", "a")), ("r7", "e1", "d1", "Open Doubles", 8, 2001, ("u", "u")), ("r8", "e1", "d1", "Open Doubles", 1000, 2001, ("c", "d")), ("r9", "e1", "d1", "Open Doubles", 9, 2001, ("a", "b", None)))


def entries(t):
    return given(t, "entry, event, discipline, discipline_name, placement, year, participant_order, person_id", *[(*e[:6], i, p) for e in ENTRIES for i, p in enumerate(e[6], 1)])


@query(answer("a, b, first_year, last_year, appearance_count BIGINT", ("a", "b", 2001, 2004, 2)))
def teams_built(t):
    return T.build_teams(entries(t), "u", "6ba7b8109dad11d180b400c04fd430c8")[0].drop("team_id")


@query(answer("event, discipline, entry, placement", ("e1", "d1", "r2", 1), ("e2", "d2", "r3", 2)))
def team_appearances(t):
    return T.build_teams(entries(t), "u", "6ba7b8109dad11d180b400c04fd430c8")[1].select("event", "discipline", "entry", "placement")


@query(answer("issue, subject, severity", ("multi_stage_result", "r1", "low"), ("participant_count_mismatch", "r4", "high"), ("participant_count_mismatch", "r5", "high"), ("self_team", "r6", "critical"), ("unknown_team", "r7", "low"), ("placement_out_of_range", "r8", "high"), ("participant_count_mismatch", "r9", "high"), ("discipline_team_type_mismatch", "d2", "medium")))
def team_issues(t):
    return T.build_teams(entries(t), "u", "6ba7b8109dad11d180b400c04fd430c8")[2]


@query(answer("id, kind, a, b, score, year, confidence, pid_a, pid_b", (1, "match_result", "Ana Ruiz", "Bo Lind", "15-9", 1998, 0.90, "p1", "p2"), (2, "match_result", "Cy Young", "Dee Fox", None, None, 0.75, None, None), (3, "placement_block", "Ana Ruiz", "Cy Young", None, None, 0.65, "p1", None)))
def match_fragments(t):
    lines = given(t, "id, line", (1, "In 1998 Ana Ruiz defeated Bo Lind 15-9 in the final"), (2, "Then Cy Young beat Dee Fox, easily"), (3, "1st - Ana Ruiz/Cy Young, 2nd - Dee Fox/Bo Lind"), (4, "Final score 15-9 in pool B"), (5, "Nothing to see here at all"), (6, "A beat A"))
    return T.fragments(lines, given(t, "person_id, person_name", ("p1", "ana ruiz"), ("p2", "Bo Lind")))


@query(answer("id, anomaly", (1, None), (2, "SPLIT_PARSING_ERROR"), (3, "SPLIT_PARSING_ERROR"), (4, "MISSING_PARTNER"), (5, "SPLIT_PARSING_ERROR"), (6, None)))
def split_anomalies(t):
    return given(t, "id, shown", (1, "Ana Ruiz / Bo Lind"), (2, "Ana Ruiz / Oregon"), (3, "Ana Ruiz (Lima / Peru)"), (4, "Ana Ruiz (Lima)"), (5, "Ana Ruiz / Lima, USA"), (6, "Ana Ruiz")).select("id", T.split_anomaly(F.col("shown"), ["oregon", "peru", "or"]).alias("anomaly"))


@query(answer("placement, anomaly, name", (2, "MISSING_PARTNER", "Cy Young"), (3, "TRUNCATED_NAME", "Dee")))
def doubles_audit(t):
    d = given(t, DISCIPLINES, ("e", "d", "D", "net", "doubles"), ("e", "s", "S", "net", "singles"))
    p = given(t, PARTICIPANTS, ("e", "d", 1, 1, "Ana Ruiz", ""), ("e", "d", 1, 2, "Bo Lind", ""), ("e", "d", 2, 1, "Cy Young", ""), ("e", "d", 2, 2, "__UNKNOWN_PARTNER__", ""), ("e", "d", 3, 1, "Dee", ""), ("e", "d", 3, 2, "Eli Hart", ""), ("e", "s", 1, 1, "Fay", ""))
    return T.doubles_anomalies(d, p, ["__unknown_partner__", ""]).select("placement", "anomaly", "name")


@query(answer("name, year, partner, confidence", ("Ana", 2005, "Bo", "HIGH"), ("Ana", 2005, "Cy", "MEDIUM"), ("Ana", 2020, "Bo", "MEDIUM"), ("Ana", 2020, "Cy", "MEDIUM")))
def partner_suggestions(t):
    slots = [("Ana", "Bo", y) for y in range(2000, 2005)] + [("Ana", "Cy", y) for y in (1999, 2000, 2001)] + [("Ana", "Dee", 2004)]
    p = given(t, "event, discipline, placement, year, display_name", *[(f"e{i}", "d", 1, y, n) for i, (a, b, y) in enumerate(slots) for n in (a, b)], *[("x", "d", 1, 2004, n) for n in ("Ana", "Dee", "Eve")])
    return T.suggested_partners(given(t, "name, year", ("Ana", 2005), ("Ana", 2020), ("Zed", 2000)), T.partners(p, ["__unknown_partner__"]))


# Audits.


@query(answer("person_id, category, severity", (1, "encoding_corruption", "HIGH"), (2, "encoding_corruption_question", "HIGH"), (3, "multi_person", "MEDIUM"), (4, "junk_marker_trailing", "LOW"), (5, "junk_marker_characters", "MEDIUM"), (6, "junk_marker_rank", "MEDIUM"), (6, "non_person", "MEDIUM"), (7, "incomplete_name_question", "MEDIUM"), (8, "single_word", "LOW"), (9, "non_person", "MEDIUM"), (10, "abbreviated_name", "LOW"), (11, "incomplete_name_last", "LOW"), (12, "incomplete_name_initials", "MEDIUM"), (12, "abbreviated_name", "LOW")))
def name_checks(t):
    n = given(t, "person_id, person_name", (1, "Ana Ru¿iz"), (2, "Ana Ru?z"), (3, "Ana Ruiz and Bo Lind"), (4, "Ana Ruiz*"), (5, "Ana=Ruiz Poe"), (6, "2. Ana Ruiz"), (7, "Ana ?"), (8, "Ana"), (9, "Ana Ruiz, Lima"), (10, "A Ruizmann"), (11, "Ana R"), (12, "A. R."), (13, "Ana Ruiz"), (14, ""), (15, None), (16, "__NON_PERSON__"))
    return A.name_issues(n, ["__NON_PERSON__"])


@query(answer("event, before BIGINT, after BIGINT, lost BIGINT", ("a", 3, 2, 1), ("b", 1, 0, 1), ("c", 0, 1, -1)))
def stage_drops(t):
    return A.stage_drop(given(t, "event", ("a",), ("a",), ("a",), ("b",), ("d",)), given(t, "event", ("a",), ("a",), ("c",), ("d",)), "event")


@query(answer("d, verdict", ("eq", "equal"), ("flat", "flattened"), ("other", "other"), ("src", "only_source"), ("der", "only_derived")))
def tie_flattening(t):
    rows = lambda **g: given(t, "d, placement", *[(k, p) for k, v in g.items() for p in v])
    return A.flattened_ties(rows(eq=(1, 2, 2), flat=(1, 2, 2, 4), other=(1, 2), src=(1,)), rows(eq=(2, 1, 2), flat=(1, 2, 3, 4), other=(1, 3), der=(1,)), ["d"])


@query(answer("signal, subject, detail", ("alias_conflict", "anita", "p1|p2"), ("alias_conflict", "bo", "p3|p4"), ("self_pointing_conflict", "bo", "p3"), ("live_duplicate", "cy", "p5|p6"), ("stub_beside_live", "p7", "p1")))
def identity_audit(t):
    aliases = given(t, "alias, person_id", ("anita", "p1"), ("anita", "p2"), ("anita", "p2"), ("bo", "p3"), ("bo", "p4"), ("cyrus", "p5"), ("", "p1"))
    return A.identity_findings(aliases, given(t, "person_id, name, source, placements", ("p1", "ana", "import", 3), ("p2", "ann", "import", 1), ("p3", "bo", "import", 2), ("p4", "bob", "import", 0), ("p5", "cy", "import", 1), ("p6", "cy", "import", 2), ("p7", "ana", "patch_v53:x", 0), ("p8", "ana", "import", None)))


@query(answer("d, entries BIGINT, places BIGINT, tie_share, highest, verdict", ("clean", 3, 3, 0.0, 3, "clean"), ("dense", 3, 1, 0.667, 1, "dense"), ("gaps", 2, 2, 0.0, 9, "gaps"), ("ties", 3, 2, 0.333, 2, "ties")))
def discipline_forensics(t):
    return A.discipline_verdict(given(t, "d, placement", *[(k, p) for k, v in {"clean": (1, 2, 3), "dense": (1, 1, 1), "gaps": (1, 9), "ties": (1, 2, 2)}.items() for p in v]), ["d"])


@query(answer("severity, check_id, issues BIGINT", ("hard", "orphan_discipline", 1), ("hard", "orphan_person", 1), ("hard", "placement_not_positive", 1), ("warn", "doubles_participants", 2), ("warn", "blank_name", 1), ("warn", "non_person_name", 1), ("info", "one_id_many_names", 1)))
def canonical_checks(t):
    p = given(t, PARTICIPANTS, ("e", "d", 1, 1, "Ana Ruiz", "p1"), ("e", "d", 1, 2, "Bo Lind", "p2"), ("e", "d", 2, 1, "Ana Ruyz", "p1"), ("e", "d", 0, 1, "Cy", "gone"), ("e", "x", 1, 1, "  ", ""))
    return A.canonical_gate(given(t, DISCIPLINES, ("e", "d", "D", "net", "doubles")), p, given(t, "person_id", ("p1",), ("p2",)), P.is_person_like)


# Sources.


@query(answer("event, text", ("e1", "Open Net\n1. Ana / Bo\n2. Cy\n\nGolf\n1. Dee"), ("e2", "Golf\n3. Eve")))
def results_blocks(t):
    rows = given(t, "ord, event, division, place, player_1, player_2", (1, "e1", "Open Net", "2", "Cy", ""), (2, "e1", "Open Net", "1", "Ana", "Bo"), (3, "e1", "Golf", "1", "Dee", None), (4, "e2", "Golf", "3", " Eve ", ""), (5, "e2", "Golf", "4", "", ""))
    return readers.results_block(rows, "division", "place", "player_1", "player_2")


@query(answer("page, nth, name, adds, notation, tags", (1, 1, "Whirl", 3, "SET > OP IN", "rotational|basic"), (1, 2, "Odd & Even", None, None, "")))
def move_lists(t):
    html = "<table><tr><th>Name</th></tr><tr class=a><td><a href='/1'>Whirl</a></td><td>3</td><td>SET &gt; OP IN</td><td>rotational, basic</td></tr><TR><TD>Odd & Even</TD><TD>n/a</TD></TR></table>"
    return readers.move_list(given(t, "page, html", (1, html.replace("&gt;", ">")), (2, ""), (3, None)))


@query(answer("id, club, place, contact", (1, "Foot & Bag Club", "Lima, Peru", "Ana Ruiz"), (2, "", "", "")))
def page_fields(t):
    html = '<div class="x clubsShowName"><h1>Foot &amp; Bag  Club</h1></div><p class=clubsLocation>Lima,\n Peru</p><b>Contact:</b> <i>Ana</i> Ruiz<br>more'
    return readers.fields(given(t, "id, html", (1, html), (2, "<p>none</p>")), "html", {"club": "clubsShowName", "place": "clubsLocation"}, {"contact": "Contact"}).drop("html")


@query(answer("block, header, n BIGINT", (0, None, 1), (1, "1999: Spring", 2), (2, "2000: Fall", 1)))
def year_blocks(t):
    lines = readers.text_blocks(given(t, "id, text", (1, "intro\n1999: Spring\n1. Ana\n2000: Fall")), "id", "text", r"^\d{4}:")
    return lines.groupBy(F.col("block").cast("int").alias("block"), F.col("block_header").alias("header")).agg(F.count("*").alias("n"))


# Scalars.


@query(answer("id, match, honour, title, plain, year, pattern, fixed", (1, "fi ana", "lukasz o", "Ana Ruiz", "Bo Lind", 1999, "full_name", "José"), (2, "x", "x", "O'Neil", "Cy", None, "several", "plain"), (3, None, None, None, None, None, "blank", None), (4, "a b", "a b", "McDuff", "Dee", 2029, "initial_first", "Ãx"), (5, "", "", "", "", None, "one_word", "São – x")))
def name_functions(t):
    rows = given(t, "id, a, b, c, d, e, f, g", (1, " \ufb01  Ana ", "Łukasz Ø", "ANA RUIZ", "Bo Lind (aka Bobby)", "x1999-2001", "Ana Ruiz", "JosÃ©"), (2, "X", "x", "O'Neil", "Cy AKA The Bull", "12345 1969", "Ana & Bo", "plain"), (3, None, None, None, None, None, None, None), (4, "A\u00a0B", "A  B", "McDuff", "Dee", "in 2029!", "A. Ruiz", "Ãx"), (5, "", "", "", "", "", "Ana", "São – x"))
    return rows.select("id", X.match_key(F.regexp_replace("a", "\u00a0", " ")).alias("match"), X.honour_key(F.col("b")).alias("honour"), X.title_if_shouted(F.col("c")).alias("title"), X.without_aka(F.col("d")).alias("plain"), X.year_in(F.col("e")).alias("year"), X.name_pattern(F.col("f")).alias("pattern"), X.repaired(F.col("g")).alias("fixed"))


@query(answer("id, city, region, country", (1, "Lima", "", "Peru"), (2, "Portland", "Oregon", "USA"), (3, "", "", "Peru"), (4, "", "", ""), (5, "A", "B, C", "D")))
def locations(t):
    return given(t, "id, text", (1, "Lima, Peru"), (2, "Portland, Oregon, USA"), (3, "Peru"), (4, None), (5, "A, B,, C , D")).select("id", X.location(F.col("text")).alias("l")).select("id", "l.*")


@query(answer("text, first, last, sec", ("May 4, 1999", "1999-05-04", "1999-05-04", 3723), ("may 4-6, 1999", "1999-05-04", "1999-05-06", 62), ("May 30-June 2, 1999", "1999-05-30", "1999-06-02", None), ("TBA", "", "", None), ("May 40, 1999", "", "", 5)))
def dates_and_times(t):
    rows = given(t, "text, clock", ("May 4, 1999", "1:02:03"), ("may 4-6, 1999", "1:02"), ("May 30-June 2, 1999", "x:1"), ("TBA", None), ("May 40, 1999", "5"))
    return rows.select("text", X.date_range(F.col("text")).alias("d"), X.seconds(F.col("clock")).alias("sec")).select("text", F.col("d.start").alias("first"), F.col("d.end").alias("last"), "sec")


@query(answer("id, rest, key", (1, "spinning", "k::a9993e364706"), (2, "a", "k::da39a3ee5e6b"), (3, "", "k::a9993e364706")))
def token_subtraction(t):
    rows = given(t, "id, name, base, key", (1, "Spinning whirl", "Whirl", "abc"), (2, "a a b", "b a", ""), (3, "whirl", "whirl whirl", "abc"))
    return rows.select("id", F.array_join(S.subtract_tokens(F.col("name"), F.col("base")), " ").alias("rest"), X.sha1_key("k::", F.col("key")).alias("key"))


@query(answer("id, kind, shown", (1, "net", "open"), (2, "other", "open"), (3, "other", "hidden")))
def mapped_values(t):
    return given(t, "id, code, status", (1, "N", "active"), (2, "?", "inactive"), (3, None, "archived")).select("id", M.mapped(F.col("code"), {"N": "net", "F": "freestyle"}, "other").alias("kind"), F.when(F.expr(M.MEMBER_VIEWS["clubs_open"]), "open").otherwise("hidden").alias("shown"))


@query(answer("id", (1,)))
def searchable_members(t):
    names = "id, deleted_at, is_deceased, searchable, personal_data_purged_at, email_verified_at"
    return M.view(given(t, names, (1, None, 0, 1, None, "2001"), (2, "2001", 0, 1, None, "2001"), (3, None, 1, 1, None, "2001"), (4, None, 0, 0, None, "2001"), (5, None, 0, 1, "2001", "2001"), (6, None, 0, 1, None, None), (7, None, None, 1, None, "2001")), "members_searchable").select("id")


# Mining.
TRICKS = ["whirl", "spinning whirl", "paradox whirl", "mirage", "leg over"]


@query(answer("id, line_no, nth, trick, class", (1, 0, 0, "spinning whirl", "result_trick"), (1, 0, 1, "whirl", "result_trick"), (1, 2, 0, "mirage", "sequence"), (1, 2, 1, "legover", "sequence"), (1, 4, 0, "paradox whirl", "text")))
def mined_tricks(t):
    return M.mine(given(t, "id, text", (1, "1. Ana: Spinning-Whirl and whirl\nWHIRL RESULTS:\nmirage > leg  over\nwhirlygig\nthe Paradox Whirl won\nx")), TRICKS, {"leg over": "legover"})


@query(answer("id, slug, how", (1, "whirl", "name"), (2, "leg-over", "slug"), (3, "mirage", "alt"), (4, None, "none")))
def overlay_names(t):
    return M.overlay(given(t, "id, name, alt", (1, "WHIRL", None), (2, "Leg Over!", "whirl"), (3, "Mirage thing", "mirage"), (4, "x", None)), given(t, "slug, name", ("whirl", "Whirl"), ("leg-over", "legover"), ("mirage", "Mirage")))


@query(answer("era, honoured, overlap, n BIGINT", ("before_1990", True, "unique_name_matches_other", 1), ("1990s", False, "ambiguous_multiple_matches", 1), ("2010_on", False, "variant_assisted_match", 1), ("unknown", False, "no_name_match", 2)))
def cohort_counts(t):
    persons = given(t, "person_id, name, last_year, honoured", ("p1", "ana", 1989, True), ("p2", "bo", 1990, False), ("p3", "bobby", 2010, None), ("p4", "cy", None, False), ("p5", "dee", None, False))
    return M.cohorts(persons, given(t, "other_id, name", ("o1", "ana"), ("o2", "bo"), ("o3", "bo"), ("o4", "bob"), ("o5", "")), given(t, "a, b", ("bob", "bobby")))


# The export.


def exported(t):
    d = given(t, f"{DISCIPLINES}, coverage", ("e", "net", "Net", "net", "doubles", "full"), ("e", "thin", "Thin", "net", "singles", " Sparse "), ("e", "golf", "Golf", "golf", "singles", None))
    r = given(t, "event, discipline, placement", ("e", "net", 1), ("e", "thin", 1), ("e", "golf", 1))
    p = given(t, PARTICIPANTS, ("e", "net", 1, 1, "Ana Ruiz $200", "p1"), ("e", "net", 1, 2, "__UNKNOWN_PARTNER__", ""), ("e", "golf", 1, 1, "B. Lind", None), ("e", "golf", 2, 1, "ana ruiz", "p2"), ("e", "golf", 3, 1, "Junk", "p4"), ("e", "golf", 4, 1, "Ana Ruiz", "p1"), ("e", "thin", 1, 1, "Cy Young", "p3"))
    persons = given(t, "person_id, person_name", ("p1", "ANA RUIZ"), ("p2", "Ana Ruiz aka Anita"), ("p3", "Cy Young"), ("p4", "Round Robin 2001"))
    return C.platform_export(d, r, p, persons, given(t, "display_name, person_id, person_name", ("B. Lind", "p9", "Bo Lind")), P.is_person_like)


@query(answer("discipline, placement, participant_order, display_name, person_id", ("net", 1, 1, "Ana Ruiz", "p1"), ("net", 1, 2, "Unknown", None), ("golf", 1, 1, "Bo Lind", "p9"), ("golf", 2, 1, "ana ruiz", "p1"), ("golf", 3, 1, "Junk", None), ("golf", 4, 1, "Ana Ruiz", "p1")))
def exported_participants(t):
    return exported(t)["participants"].select("discipline", "placement", "participant_order", "display_name", "person_id")


@query(answer("table_name, key", ("persons", "p1 Ana Ruiz"), ("persons", "p9 Bo Lind"), ("disciplines", "net"), ("disciplines", "golf"), ("results", "net"), ("results", "golf")))
def exported_tables(t):
    out = exported(t)
    return out["persons"].select(F.lit("persons").alias("table_name"), F.concat_ws(" ", "person_id", "person_name").alias("key")).union(out["disciplines"].select(F.lit("disciplines"), "discipline")).union(out["results"].select(F.lit("results"), "discipline"))


@query(answer("placement, participant_order, display_name, person_id, how", (1, 1, "Ana Ruiz", "p1", "own"), (1, 2, "Bo", "p2", "alias"), (2, 1, "Cy Young", "p3", "name"), (2, 2, "Dee Fox", "stub", "stub"), (3, 1, "???", None, "none"), (4, 1, "Ana Ruiz", "p1", "name")))
def seeded_entries(t):
    p = given(t, "event, discipline, placement, participant_order, display_name, person_id, team_key", ("e", "d", 1, 1, "Ana Ruiz", "p1", "k1"), ("e", "d", 1, 2, "Bo", "", "k1"), ("e", "d", 2, 1, "CY YOUNG", "", None), ("e", "d", 2, 2, "Dee Fox", None, None), ("e", "d", 3, 1, "???", "", ""), ("e", "d", 4, 1, "", "", "k1"))
    s = C.seed_entries(p, given(t, "person_id, person_name", ("p1", "Ana Ruiz"), ("p3", "Cy Young")), given(t, "alias, person_id", ("bo", "p2")), P.is_person_like, "6ba7b8109dad11d180b400c04fd430c8")
    return s.select("placement", "participant_order", X.title_if_shouted(F.col("display_name")).alias("display_name"), F.when(F.length("person_id") == 36, "stub").otherwise(F.col("person_id")).alias("person_id"), "how")


@query(answer("person_name, person_type, source, keyed", ("Ana Ruiz", "CANONICAL", "RESULTS", False), ("Bo Lind", "PROVISIONAL", "clubs|members", True), ("Eve Hart", "CLUB_ONLY", "CLUBS", True)))
def person_master(t):
    one = lambda *names: given(t, "person_name", *[(n,) for n in names])
    m = C.persons_master(given(t, "person_id, person_name", ("p1", "Ana Ruiz")), given(t, "person_name, source", ("ana  ruiz", "members"), ("Bo Lind", "members"), ("Bo Lind", "clubs"), ("Cy Young", "members")), one("Cy Young"), one("Ana Ruiz", "bo lind", "Cy Young", "Eve Hart", "Eve Hart"))
    return m.select("person_name", "person_type", "source", F.col("master_id").rlike("^(prov|club)_person::[0-9a-f]{12}$").alias("keyed"))


@query(answer("event, placement, name, conflict", ("a", 1, "Ana", False), ("a", 2, "Bo", True), ("a", 2, "Cy", True), ("d", 1, "Dee", False)))
def adjudicated_events(t):
    e = given(t, "event", ("a",), ("b",), ("c",), ("d",))
    r = given(t, "event, discipline, placement, name", ("a", "x", 1, "Ana"), ("a", "x", 2, "Bo"), ("b", "x", 1, "Ana"), ("b", "x", 2, "Cy"), ("c", "x", 1, "Eve"), ("d", "x", 1, "Dee"))
    events, results = C.adjudicate(e, given(t, "event, target, action", ("b", "a", "merge"), ("c", None, "suppress"), ("d", None, "keep")), r)
    return results.join(events, "event").select("event", "placement", "name", "conflict")


# More audits.


@query(answer(
    "id, check_id", *[(i, c) for i, cs in {
        "2": ("event_type_invalid", "location_missing"), "x3": ("event_id_pattern", "event_name_html", "location_url", "location_email", "string_double_space"), "4": ("event_name_placeholder", "date_missing_worlds", "year_missing_worlds", "location_tba", "host_club_numbered_prefix"),
        "5": ("date_year_mismatch", "year_out_of_range", "location_hosted_by", "location_multi_sentence", "date_ical_remnant", "string_whitespace"), "6": ("event_name_missing", "location_street", "host_club_url", "string_mojibake"),
    }.items() for c in cs],
))
def event_checks(t):
    e = given(
        t, "id, name, event_type, location, date, year, host_club",
        ("1", "Spring Open", "net", "Lima, Peru", "May 4, 1999", 1999, "Club"), ("2", "Meet", "bowling", None, "", None, ""), ("x3", "A <b>bold</b>  cup", "net", "http://x.org a@b.org", None, 2001, None), ("4", "TBA", "worlds", "TBD", None, None, "1. Club"),
        ("5", "Old", "golf", "hosted by us. It was good there. Really", "May 2001 Add to iCal", 1961, "Club "), ("6", "", "social", "12 Mill Street", None, 2000, "www.club.org Ã©"),
    )
    return Q.row_issues(e, "id", A.event_rules()).select("id", "check_id")


@query(answer("id, check_id", *[(i, c) for i, cs in {2: ("place_invalid", "competitor_type_invalid", "name_empty", "division_unknown"), 3: ("unsplit_team", "has_score"), 4: ("duplicate_in_team",), 5: ("has_slash", "leading_dash", "division_foreign"), 6: ("doubles_dash_separator",), 7: ("team_without_second", "has_semicolon", "division_like_placement"), 8: ("name_short", "has_month"), 9: ("name_noise",)}.items() for c in cs]))
def placement_checks(t):
    p = given(t, "id, division, place, competitor_type, player1, player2", (1, "Open", 1, "player", "Ana Ruiz", ""), (2, "Unknown", 0, None, "", None), (3, "Open", 2, "player", "Ana & Bo 15-9", ""), (4, "Open", 3, "team", "Ana Ruiz", "ana ruiz"), (5, "Dobles", 4, "team", "-Ana", "Bo/Cy"), (6, "Open Doubles", 5, "player", "Ana - Bo", ""), (7, "1. Open", 6, "team", "Ana; x y", ""), (8, "Open", 7, "team", "A", "July"), (9, "Open", 8, "player", "Round 2 winner", ""))
    return Q.row_issues(p, "id", A.placement_rules()).select("id", "check_id")


@query(answer("check_id, subject", ("event_id_duplicate", "1"), ("worlds_multiple_per_year", "1999"), ("duplicate_event", "cup"), ("net_without_net", "4"), ("freestyle_without_freestyle", "5"), ("worlds_without_net", "2"), ("all_unknown_divisions", "5"), ("no_results", "1"), ("no_results", "3"), ("no_results", "6"), ("no_results", "7")))
def cross_record_checks(t):
    e = given(t, "id, name, event_type, location, year", (1, "A", "golf", "x", 1990), (1, "B", "golf", "x", 1991), (2, "W", "worlds", "x", 1999), (3, "V", "worlds", "y", 1999), (4, "N", "net", "", 2000), (5, "F", "freestyle", "", 2000), (6, "Cup", "golf", "Lima", 2001), (7, " cup", "social", "lima", 2001))
    return A.cross_record(e, given(t, "event, category", (2, "freestyle"), (4, "golf"), (5, "unknown")))


U1, U2, U3 = ("00000000-0000-5000-8000-00000000000" + x for x in "123")


@query(answer("line, check_id, severity", (2, "blank_alias", "hard"), (3, "malformed_uuid", "hard"), (4, "duplicate_row", "warn"), (5, "stale_pid_canon_resolves", "warn"), (6, "missing_canonical_pid", "hard"), (1, "alias_conflict", "hard"), (4, "alias_conflict", "hard"), (7, "alias_conflict", "hard")))
def alias_registry_checks(t):
    a = given(t, "line, alias, person_id, person_canon", (1, "Anita", U1, "Ana Ruiz"), (2, " ", U1, "Ana Ruiz"), (3, "Bobby", "p1", "Bo Lind"), (4, "Anita", U1, "Ana Ruiz"), (5, "Cyrus", U3, "bo lind"), (6, "Deirdre", U3, "Gone"), (7, "ANITA", U2, "Bo Lind"))
    return A.alias_registry(a, given(t, "person_id, person_name", (U1, "Ana Ruiz"), (U2, "Bo Lind")))


@query(answer("check_id, severity, name, n BIGINT", ("unmapped_person_name", "WARN", "Ana Ruiz", 2), ("canon_missing", "ERROR", "Bo Lind", 1), ("mojibake", "WARN", "Cy¿ Young", 1), ("multi_person", "WARN", "Dee and Eli Hart", 1), ("unmapped_person_name", "WARN", "Dee and Eli Hart", 1), ("trailing_junk", "INFO", "Fay Gray *", 1), ("open_paren", "INFO", "Gus Poe (Lima", 1), ("unmapped_person_name", "WARN", "Gus Poe (Lima", 1)))
def tier_one_people(t):
    return A.people_findings(given(t, "name, person_id, person_canon", ("Ana Ruiz", "", ""), ("Ana Ruiz", None, ""), ("Bo Lind", "p2", " "), ("Cy¿ Young", "p3", "Cy Young"), ("Dee and Eli Hart", "", ""), ("Fay Gray *", "p4", "Fay Gray"), ("Gus Poe (Lima", "", ""), ("III and Hal", "p5", "x"), (None, None, None)), P.is_person_like)


@query(answer("before BIGINT, after BIGINT, changed BIGINT, ok", (3, 2, -1, True)))
def patch_asserted(t):
    rows = given(t, "id", (1,), (2,), (3,))
    return A.expected_counts(rows, W.delete(rows, "id", given(t, "id", (3,), (9,))), -1)


@query(answer("id", ("12",), ("3",), ("x",), ("7",)))
def best_of_events(t):
    return P.best_event(given(t, "id, year, name, location, date, placements", ("1", 1999, "Cup", "Lima", "May 1", 0), ("12", 1999, "cup ", "lima", "TBA", 3), ("3", 2000, "Cup", "Lima", "May", 2), ("20", 2000, "Cup", "Lima", "", 2), ("x", 2001, "Cup", "", "May", None), ("5", 2001, "Cup", "", "tbd", None), ("9", None, "Z", "", "", 0), ("7", None, "Z", None, None, 0))).select("id")


@query(answer("name, entries BIGINT, countries", ("Ana Ruiz", 4, "PER|FIN"), ("Bo Lind", 1, "")))
def player_registry(t):
    return P.register(given(t, "name, country", ("Ana Ruiz", "PER"), ("Ana  Ruiz PER", "PER"), ("Ana Ruiz", "FIN"), ("Ana Ruiz", None), ("Bo Lind", ""), ("Junk", "PER")), "12345678123456781234567812345678").drop("player_id")


@query(answer("club, name, person_id, how", ("a", "Ana Ruiz", "p1", "exact"), ("a", "Sam Same", None, "ambiguous"), ("b", "Ana Ruiz", "p1", "exact"), ("b", "No One", None, "none")))
def club_person_links(t):
    return P.club_links(given(t, "club, name", ("a", "Ana Ruiz "), ("a", "Ana Ruiz"), ("a", "Sam Same"), ("b", "Ana Ruiz"), ("b", "No One"), ("b", "")), given(t, "person_id, person_name", ("p1", "ana ruiz"), ("p2", "Sam Same"), ("p3", "Sam Same")))


@query(answer("nth BIGINT, name", (1, "Élan"), (2, "elms"), (3, "Emma"), (4, "Zoë"), (5, "zz")))
def base_ordered(t):
    n = given(t, "name", ("zz",), ("Zoë",), ("Emma",), ("elms",), ("Élan",)).withColumn("k", P.base_order(F.col("name")))
    return V.placed(n, [], F.substring("k", 1, 1), ["k", "name"], "nth").select("nth", "name")


@query(answer("trick, adds, record, next_value", ("t", None, 10, 15), ("t", None, 15, 20), ("t", None, 15, 20), ("t", None, 20, None), ("t", None, 20, None), ("t", 3, 12, None), ("u", None, None, None)))
def record_progression(t):
    return V.progression(given(t, "trick, adds, record", ("t", None, 10), ("t", None, 15), ("t", None, 15), ("t", None, 20), ("t", None, 20), ("t", 3, 12), ("u", None, None)), ["trick", "adds"], "record")


@query(answer("text, a, b, c", ("footbag", "f", "foo", "ag"), ("", "", "", ""), (None, None, None, None)))
def sqlite_substrings(t):
    return given(t, "text", ("footbag",), ("",), (None,)).select("text", X.sqlite_substr(F.col("text"), 0, 2).alias("a"), X.sqlite_substr(F.col("text"), 1, 3).alias("b"), X.sqlite_substr(F.col("text"), -2, 2).alias("c"))


@query(answer(
    "event, discipline, team_type, sort_order, people BIGINT",
    (1, "open_singles_net", "singles", 1, 3), (1, "open_doubles_net", "doubles", 2, 6), (1, "open_singles_routines", "singles", 3, 2), (1, "intermediate_shred", "singles", 4, 1), (1, "womens_circle", "singles", 5, 1), (1, "sick_3", "singles", 6, 1), (2, "unknown", "singles", 1, 3),
))
def canonical_chain(t):
    """From text to the canonical tables."""
    found = R.parse_results(given(t, "event_id, text", (1, PAGE), (2, "1. Solo Runner\n2. Odd {Name & Other One"))).withColumnsRenamed({"event_id": "event", "line_no": "ord"})
    people = C.participant_table(found).groupBy("event", F.col("division").alias("name")).agg(F.count("*").alias("people"))
    return C.discipline_table(found).join(people, ["event", "name"]).select("event", "discipline", "team_type", "sort_order", "people")
