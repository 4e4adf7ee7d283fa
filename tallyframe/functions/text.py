"""Scalar functions on names, dates and keys, as column expressions; only Unicode folding needs Arrow."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Endings that are no surname.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md")


def like_literal(text: str) -> str:
    """Escapes a user's text for LIKE."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def contains_text(col: Column, text: str) -> Column:
    """Contains, ignoring the case of A-Z alone, as SQLite's LIKE does; wildcards in the text stand for themselves."""
    return F.contains(F.translate(col, UPPER, LOWER), F.lit(text.translate(str.maketrans(UPPER, LOWER))))


def sqlite_substr(col: Column, start: int, length: int) -> Column:
    """substr as SQLite counts: from 0 the first character is one before the text."""
    return F.substring(col, max(start, 1), max(0, length - 1) if start == 0 else length) if start >= 0 else F.substring(col, start, length)


def slugify(col: Column, sep: str = "_", most: int = 80) -> Column:
    """Lower case, apostrophes dropped, other marks to one separator, none at the ends."""
    s = F.regexp_replace(F.lower(col), "['’]", "")
    s = F.regexp_replace(s, "[^a-z0-9]+", sep)
    return F.regexp_replace(F.substring(F.regexp_replace(s, f"^{sep}+|{sep}+$", ""), 1, most), f"{sep}+$", "")


def surname(col: Column) -> Column:
    """The last word that is not a generational or academic ending."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(col), "[.,]", "")), r"\s+"), lambda w: ~w.isin(*SUFFIXES))
    return F.try_element_at(words, F.lit(-1))


@F.pandas_udf(T.StringType())
def fold_marks(s: pd.Series) -> pd.Series:
    """Without combining marks (compatibility decomposition)."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def fold_accents(s: pd.Series) -> pd.Series:
    """Without combining marks (canonical decomposition only, so that other letters stay as they are)."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))


def normalise_name(col: Column) -> Column:
    """Folded, lower case, separators to spaces, other marks dropped, single spaces."""
    s = F.regexp_replace(F.lower(fold_marks(col)), "[-_/]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w\s]", ""), r"\s+", " "))


def leading_int(col: Column) -> Column:
    """The number a text begins with, null if none."""
    return F.try_to_number(F.nullif(F.regexp_extract(col, r"^\s*(-?\d+)", 1), F.lit("")), F.lit("S999999999")).cast("int")


def flexible_date(col: Column) -> Column:
    """m/d/yyyy or yyyy-mm-dd, null otherwise."""
    return F.coalesce(F.try_to_date(col, "M/d/yyyy"), F.try_to_date(col, "yyyy-MM-dd"))


def _month(col: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(MONTHS, 1):
        out = F.when(F.lower(col) == name, i).otherwise(out)
    return out


def date_range(col: Column) -> Column:
    """struct(start, end) as ISO text from 'May 4, 1999', 'May 4-6, 1999' or 'May 30-June 2, 1999'; empty texts otherwise."""
    part = lambda k: F.regexp_extract(col, r"^\s*([A-Za-z]+)\s+(\d{1,2})(?:\s*-\s*(?:([A-Za-z]+)\s+)?(\d{1,2}))?\s*,\s*(\d{4})\s*$", k)
    number = lambda k: F.try_to_number(F.nullif(part(k), F.lit("")), F.lit("9999")).cast("int")
    day = lambda m, d: F.coalesce(F.date_format(F.try_to_date(F.concat_ws("-", number(5), m, d), "yyyy-M-d"), "yyyy-MM-dd"), F.lit(""))
    first = _month(part(1))
    last = F.coalesce(_month(part(3)), first)
    return F.struct(day(first, number(2)).alias("start"), day(last, F.coalesce(number(4), number(2))).alias("end"))


def uuid5(namespace_hex: str, name: Column) -> Column:
    """The version-5 UUID of a name, from sha1 alone."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def place_suffix(col: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th."""
    tens = (F.abs(col) % 100).between(11, 13)
    return F.concat(col.cast("string"), F.when(~tens & (F.abs(col) % 10 == 1), "st").when(~tens & (F.abs(col) % 10 == 2), "nd").when(~tens & (F.abs(col) % 10 == 3), "rd").otherwise("th"))


def seconds(col: Column) -> Column:
    """h:m:s or m:s as seconds; null where a part is no number."""
    return F.aggregate(F.split(col, ":"), F.lit(0), lambda acc, x: acc * 60 + F.try_to_number(F.trim(x), F.lit("999999")).cast("int"))


@F.pandas_udf(T.StringType())
def compose(s: pd.Series) -> pd.Series:
    """Compatibility forms composed (NFKC)."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def match_key(col: Column) -> Column:
    """Composed, lower case, trimmed, single spaces."""
    return F.trim(F.regexp_replace(F.lower(compose(col)), r"\s+", " "))


def honour_key(col: Column) -> Column:
    """A name for the lookup of honours: letters that have no decomposition are written out, marks dropped, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(fold_marks(F.translate(col, "łŁøØđĐ", "lLoOdD"))), r"\s+", " "))


def title_if_shouted(col: Column) -> Column:
    """Title case for a name in capitals alone; others as they are."""
    return F.when((F.upper(col) == col) & (F.lower(col) != col), F.initcap(F.lower(col))).otherwise(col)


def without_aka(col: Column) -> Column:
    """Without `aka ...`, in brackets or not."""
    return F.trim(F.regexp_replace(col, r"(?i)\s*[\(\[]?\baka\b.*$", ""))


def year_in(col: Column) -> Column:
    """The first year from 1970 to 2029 in a text."""
    return F.try_to_number(F.nullif(F.regexp_extract(col, r"(?<!\d)(19[7-9]\d|20[0-2]\d)(?!\d)", 1), F.lit("")), F.lit("9999")).cast("int")


def location(col: Column) -> Column:
    """struct(city, region, country) of "City, Region, Country", "City, Country" or "Country"; empty texts for what is not there."""
    parts = F.filter(F.transform(F.split(F.coalesce(col, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    n, at = F.size(parts), lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    return F.struct(F.when(n > 1, at(1)).otherwise("").alias("city"), F.when(n > 2, F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), ", ")).otherwise("").alias("region"), at(-1).alias("country"))


def sha1_key(prefix: str, col: Column) -> Column:
    """A short key that depends on the text alone."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.encode(col, "UTF-8")), 1, 12))


def name_pattern(col: Column) -> Column:
    """What kind of text an unresolved name is."""
    s = F.trim(col)
    return F.when(F.coalesce(s, F.lit("")) == "", "blank").when(s.rlike(r"[&/+]|(?i)\sand\s"), "several").when(s.rlike(r"\d"), "digits").when(s.rlike(r"[()\[\]]"), "brackets").when(s.rlike(r"^[A-Z]\.?\s+\S"), "initial_first").when(s.rlike(r"^\S+\s+[A-Z]\.?$"), "initial_last").when(~s.contains(" "), "one_word").otherwise("full_name")


def repaired(col: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read anew; texts that are no such thing stay."""
    looks = col.rlike("[Â-ô][\u0080-¿]") & ~col.rlike("[^\u0000-ÿ]")
    back = F.encode(F.when(looks, col), "ISO-8859-1").cast("string")
    return F.when(F.coalesce(looks & F.is_valid_utf8(back), F.lit(False)), back).otherwise(col)


def json_array(col: Column, kind: str = "string") -> Column:
    """The JSON array in a text; empty where there is none or it is malformed."""
    return F.coalesce(F.from_json(col, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def closeness(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def surname_family(a: Column, b: Column) -> Column:
    """Whether two surnames may be spellings of one: equal, much the same letters, one a prefix of the other, or one inside the other."""
    x, y = F.array_distinct(F.split(a, "")), F.array_distinct(F.split(b, ""))
    alike = (F.abs(F.length(a) - F.length(b)) <= 2) & (F.size(F.array_intersect(x, y)) * 10 >= F.least(F.size(x), F.size(y)) * 7)
    inside = (F.least(F.length(a), F.length(b)) >= 4) & (F.contains(a, b) | F.contains(b, a))
    return (a == b) | alike | F.startswith(a, b) | F.startswith(b, a) | inside
