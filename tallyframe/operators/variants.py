"""Spellings of one name: a similarity join over names, and the miner that decides which pairs are kept as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import text as X

Q = 2
#: A gram of more names than this is not joined by itself.
LIGHT = 64
#: Tasks that a gram's rows are dealt to.
PARTS = 16


def padded_grams(name: Column) -> Column:
    """All runs of Q characters of a name, with a mark before and behind it, in order."""
    s = F.concat(F.lit("\u0001"), name, F.lit("\u0002"))
    return F.transform(F.sequence(F.lit(1), F.char_length(s) - (Q - 1)), lambda i: F.struct(i.alias("pos"), F.substring(s, i, Q).alias("gram")))


def deletions(name: Column) -> Column:
    """The name and what is left of it without one or two of its characters."""
    one = lambda s: F.when(F.char_length(s) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(s), F.lit(1))), lambda i: without(s, i))).otherwise(F.array().cast("array<string>"))
    return F.array_union(F.array_union(F.array(name), one(name)), F.flatten(F.transform(one(name), one)))


def without(s: Column, i: Column) -> Column:
    """A text without its character at place i."""
    return F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.char_length(s)))


def one_apart(n: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of distinct names at edit distance 1, each once and no others.

    Names of one length are one change apart if they are equal without the character at one place; of names of two lengths the shorter is
    the longer without one character, by the first of equal neighbours. Joins are by what is left, which no more names share than there
    are characters and places, and are merged: Spark takes exploded rows for few, and would broadcast them."""
    k = n.where("name <> ''").select("name", F.explode(F.sequence(F.lit(1), F.char_length("name"))).alias("pos")).withColumn("key", without(F.col("name"), F.col("pos")))
    changed = k.alias("x").join(k.alias("y").hint("merge"), [F.col("x.key") == F.col("y.key"), F.col("x.pos") == F.col("y.pos")]).where("x.name < y.name").select(F.col("x.name").alias("a"), F.col("y.name").alias("b"))
    first = (F.col("pos") == 1) | (F.substring("name", F.col("pos"), F.lit(1)) != F.substring("name", F.col("pos") - 1, F.lit(1)))
    longer = k.where(first).select("key", F.col("name").alias("long")).join(n.select(F.col("name").alias("key")).hint("merge"), "key")
    return changed.union(longer.select(F.least("key", "long").alias("a"), F.greatest("key", "long").alias("b")))


def similar_names(names: DataFrame, name: str = "name", edits: int = 1) -> DataFrame:
    """(a, b), a < b: the distinct names at edit distance 1 to `edits` (1 or 2). Equal to trying all pairs.

    For two edits, an inverted index over rare grams: one edit changes Q grams of a name at most, so of the Q * edits + 1 rarest grams of two
    near names one is shared, at places no farther apart than `edits`, by names whose lengths differ no more. Grams are counted over all
    names. A gram of more than LIGHT names is never joined with itself: the names that have one among their rarest meet through what
    deletions of `edits` characters leave of both, and so do names with too few grams; such a key has no more names than edits can make.
    Joins of exploded rows are merged, as for one edit; a gram's rows are dealt into PARTS to learn its count."""
    n = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    if edits == 1:
        return one_apart(n)
    grams = n.select("name", F.char_length("name").alias("len"), F.explode(padded_grams(F.col("name"))).alias("g")).select("name", "len", "g.pos", "g.gram", F.pmod(F.hash("name"), F.lit(PARTS)).alias("part"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("df")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    # By rank, so that a gram that a name has several times is taken with all its places.
    order = Window.partitionBy("name").orderBy("df", "gram")
    prefix = grams.join(counts.hint("merge"), ["gram", "part"]).withColumn("nth", F.rank().over(order)).where(F.col("nth") <= Q * edits + 1)
    few = F.col("len") + Q - 1 < Q * edits + 1 + edits
    # Light grams: postings of LIGHT names at most.
    light = prefix.where(F.col("df") <= LIGHT)
    other = light.select("gram", F.col("name").alias("b"), F.col("len").alias("blen"), F.col("pos").alias("bpos"))
    close = (F.abs(F.col("len") - F.col("blen")) <= edits) & (F.abs(F.col("pos") - F.col("bpos")) <= edits)
    found = light.join(other.hint("merge"), "gram").where(close & (F.col("name") < F.col("b"))).select(F.col("name").alias("a"), "b")
    # Names with heavy ones among their rarest, and short ones: if a pair shares no light gram, both are of these.
    keys = prefix.where(few | (F.col("df") > LIGHT)).select("name").distinct().select("name", F.explode(deletions(F.col("name"))).alias("key"))
    pairs = keys.join(keys.withColumnRenamed("name", "b").hint("merge"), "key").where("name < b").select(F.col("name").alias("a"), "b")
    return found.union(pairs).distinct().where(F.levenshtein("a", "b", edits) >= 1)


# The miner.

#: Characters that a clean name does not have.
NOISE = "?¿�¹~`\"*#$%^&|\\<>{}[]"


def spaced(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def norm_key(name: Column) -> Column:
    """Without marks, lower case, other than letters and digits to spaces, single spaces."""
    return F.trim(F.regexp_replace(F.lower(X.fold_accents(name)), r"[^\p{L}\p{N}]+", " "))


def cased(name: Column) -> Column:
    """Title case for a name in one case alone; mixed case stays."""
    one = ((F.upper(name) == name) | (F.lower(name) == name)) & name.rlike(r"\p{L}")
    letters = F.split(F.lower(name), "")
    titled = F.array_join(F.transform(letters, lambda c, i: F.when((i == 0) | ~F.coalesce(F.try_element_at(letters, i), F.lit("")).rlike(r"\p{L}"), F.upper(c)).otherwise(c)), "")
    return F.when(one, titled).otherwise(name)


def clean(name: Column) -> Column:
    """No noise, no word in quotes, no mark at either end, no dash alone."""
    noisy = F.translate(name, NOISE, "") != name
    return ~noisy & ~name.rlike(r"(^|\s)'\S*'(\s|$)|^'(\s|$)|\s'(\s|$)") & ~name.rlike(r"^[ \-.,]|[ \-.,]$") & ~name.rlike(r"(^|\s)-{1,3}(\s|$)")


def initials_joined(key: Column) -> Column:
    """Neighbouring words of one letter as one word."""
    return F.regexp_replace(key, r"(?<=^| )(\p{L}) (?=\p{L}( |$))", "$1")


def words(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda w: w != "")


def structural(v: Column, c: Column) -> Column:
    """Whether two normal forms differ as a whole: in order, in how initials are written, or in one word more beside two shared."""
    a, b = F.array_distinct(words(v)), F.array_distinct(words(c))
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    subset = (both == F.least(F.size(a), F.size(b))) & (either - both == 1) & (both >= 2)
    swapped = (F.array_sort(words(v)) == F.array_sort(words(c))) & (v != c)
    return swapped | (initials_joined(v) == initials_joined(c)) | subset


def confidence(v: Column, c: Column) -> Column:
    """high where two normal forms have the same words, in any order; medium otherwise."""
    a, b = F.array_sort(F.array_distinct(words(v))), F.array_sort(F.array_distinct(words(c)))
    return F.when((v == c) | ((F.size(words(v)) > 0) & (a == b) & (F.size(words(v)) == F.size(words(c)))), "high").otherwise("medium")


def mine_variants(persons: DataFrame, displays: DataFrame, rated: DataFrame, aliases: DataFrame) -> DataFrame:
    """(variant_name, canonical_name, confidence, source) of what is known to name a person otherwise.

    persons(ord, person_id, name); displays(ord, display_name, person_id, fallback); rated(ord, name): names that are looked up by their
    normal form; aliases(ord, alias, person_id, status). `ord` says which row comes first. Names are kept if they differ from the person's,
    have two words or more and are no other person's name; of names with one normal form for one person the first stays, in the
    order display, rated, unmarked form of the person's own name, alias. Aliases must be verified and clean, of two to four words, with a
    surname of the same family, and differ by more than letters and marks. All joins go by ids or normal forms."""
    p = persons.select("ord", F.trim("person_id").alias("person_id"), spaced(F.col("name")).alias("canonical")).where("person_id <> '' and canonical <> ''")
    p = p.withColumn("last", F.row_number().over(Window.partitionBy("person_id").orderBy(F.desc("ord")))).where("last = 1").drop("last").withColumn("ckey", norm_key(F.col("canonical")))
    # A person listed twice keeps the later name in the earlier place; the first in order has the normal form.
    place = persons.groupBy(F.trim("person_id").alias("person_id")).agg(F.min("ord").alias("ord"))
    p = p.drop("ord").join(place, "person_id")
    owner = p.groupBy("ckey").agg(F.min(F.struct("ord", "canonical")).alias("o")).select(F.col("ckey").alias("key"), F.col("o.canonical").alias("owner"))
    many = lambda c: F.size(words(c)) >= 2
    digits = lambda *cs: F.concat_ws(" ", *cs).rlike(r"\p{Nd}")

    d = displays.select("ord", spaced(F.col("display_name")).alias("variant"), F.trim("person_id").alias("person_id"), spaced(F.col("fallback")).alias("fallback")).where("variant <> '' and person_id <> ''")
    d = d.join(p.select("person_id", "canonical"), "person_id", "left").withColumn("canonical", F.coalesce("canonical", F.nullif("fallback", F.lit("")))).where("canonical is not null")
    d = d.withColumn("key", norm_key(F.col("variant"))).withColumn("ckey", norm_key(F.col("canonical"))).join(owner, "key", "left")
    d = d.where(many(F.col("key")) & many(F.col("ckey")) & (F.col("variant") != F.col("canonical")) & ~digits("variant", "canonical") & (F.coalesce("owner", "canonical") == F.col("canonical")))
    d = d.select(F.lit(1).alias("turn"), "ord", "variant", "canonical", "key", F.lit("high").alias("confidence"), F.lit("display_name").alias("source"))

    r = rated.select("ord", spaced(F.col("name")).alias("variant")).where("variant <> ''").withColumn("key", norm_key(F.col("variant"))).where(many(F.col("key")))
    r = r.join(owner, "key").where(F.col("variant") != F.col("owner")).select(F.lit(2), "ord", "variant", F.col("owner").alias("canonical"), "key", F.lit("high"), F.lit("bap"))

    m = p.select("ord", "canonical", X.fold_accents(F.col("canonical")).alias("variant")).where("variant <> canonical").withColumn("key", norm_key(F.col("variant"))).join(owner, "key", "left")
    m = m.where(many(F.col("key")) & ~digits("canonical") & (F.coalesce("owner", "canonical") == F.col("canonical"))).select(F.lit(3), "ord", "variant", "canonical", "key", F.lit("high"), F.lit("manual"))

    a = aliases.select("ord", spaced(F.col("alias")).alias("variant"), F.trim("person_id").alias("person_id"), F.trim(F.coalesce("status", F.lit(""))).alias("status"))
    a = a.where("variant <> '' and person_id <> '' and status in ('', 'verified')").where(clean(F.col("variant"))).join(p.select("person_id", "canonical", "ckey"), "person_id")
    a = a.withColumn("key", norm_key(F.col("variant"))).join(owner, "key", "left")
    bare = lambda c: F.lower(X.fold_accents(F.col(c)))
    last = lambda c: F.try_element_at(words(F.col(c)), F.lit(-1))
    sure = confidence(F.col("key"), F.col("ckey"))
    a = a.where(F.size(words(F.col("key"))).between(2, 4) & many(F.col("ckey")) & (bare("variant") != bare("canonical")) & X.surname_family(last("key"), last("ckey")) & ~digits("variant", "canonical") & (F.coalesce("owner", "canonical") == F.col("canonical")))
    a = a.withColumn("confidence", sure).where((F.col("confidence") == "high") | structural(F.col("key"), F.col("ckey"))).select(F.lit(4), "ord", "variant", "canonical", "key", "confidence", F.lit("alias"))

    every = d.union(r).union(m).union(a).withColumn("final", cased(F.col("variant"))).where((F.col("final") != F.col("canonical")) | (F.col("turn") == 3))
    first = every.withColumn("nth", F.row_number().over(Window.partitionBy("key", "canonical").orderBy("turn", "ord", "variant"))).where("nth = 1")
    return first.select(F.when(F.col("turn") == 3, F.col("variant")).otherwise(F.col("final")).alias("variant_name"), F.col("canonical").alias("canonical_name"), "confidence", "source")
