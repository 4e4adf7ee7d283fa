"""Terms of a lexicon table in free text: every occurrence, then the longest first with their spans masked; lines and scores classified.

A lexicon of at most AUTOMATON letters becomes one Aho-Corasick automaton, which each task runs once over each line whatever the number
of terms. A larger one is never gathered: the words of the texts are joined with the first words of the terms, and the terms compared
in place. Both find the same occurrences."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a lexicon that may be broadcast.
AUTOMATON = 4_000_000
FOUND = "id long, line_no int, term string, start int, stop int"
WORD = "[A-Za-z0-9]+"
#: Terms that stand in lexicons but name no trick.
GENERIC = ("men", "women", "open", "novice", "intermediate", "final", "semifinal", "routine", "freestyle", "net", "golf", "distance", "accuracy", "shred", "sick", "circle", "qualification", "qualifier", "finals")
#: Words that make no person's name.
DIVISION_WORDS = ("OPEN", "SHRED", "SICK", "NOVICE", "INTERMEDIATE", "FINALS", "FINAL", "SEMIFINALS", "SEMIFINAL", "CONTEST", "DIVISION", "WOMEN", "MEN", "DOUBLES", "SINGLES", "MIXED", "FREESTYLE", "NET", "GOLF")
#: Words of a line that tell of a score.
SCORE_WORDS = ("score", "points", "final", "average", "technical", "artistic", "presentation", "execution", "routine", "freestyle", "shred", "sick 3")


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay."""
    return text.lower() if text.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def lines_of(texts: DataFrame) -> DataFrame:
    """(id, line_no, line) of texts(id, text): lines with single spaces, trimmed, blank ones left out, numbered from 1 without them."""
    tidy = F.transform(F.split("text", r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return texts.select(F.col("id").cast("long").alias("id"), F.posexplode(F.filter(tidy, lambda x: x != "")).alias("line_no", "line")).withColumn("line_no", (F.col("line_no") + 1).cast("int"))


def terms_of(lexicon: DataFrame) -> DataFrame:
    """(term, canon): lexicon(term, canon), lower case and trimmed; without generic terms and those without a letter or digit."""
    t = lexicon.select(F.trim(F.lower("term")).alias("term"), F.trim(F.coalesce("canon", "term")).alias("canon")).where(~F.col("term").isin(*GENERIC) & F.col("term").rlike("[A-Za-z0-9]"))
    return t.groupBy("term").agg(F.min("canon").alias("canon"))


def occurrences_by_automaton(lines: DataFrame, terms: list[str]) -> DataFrame:
    shared = lines.sparkSession.sparkContext.broadcast(terms)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = ahocorasick.Automaton()
        for term in shared.value:
            machine.add_word(term, term)
        if shared.value:
            machine.make_automaton()
        for f in frames:
            out = []
            for at, no, line in zip(f["id"], f["line_no"], f["line"], strict=True):
                if not shared.value:
                    break
                low = folded(line)
                for stop, term in machine.iter(low):
                    start = stop + 1 - len(term)
                    inside = start > 0 and low[start - 1].isascii() and low[start - 1].isalnum() or stop + 1 < len(low) and low[stop + 1].isascii() and low[stop + 1].isalnum()
                    if not inside:
                        out.append((at, no, term, start, stop + 1))
            yield pd.DataFrame(out, columns=["id", "line_no", "term", "start", "stop"])

    return lines.mapInPandas(scan, FOUND)


def occurrences_by_words(lines: DataFrame, terms: DataFrame) -> DataFrame:
    """The same by a join on each term's first run of letters and digits, which is a whole run of the line wherever the term is."""

    @F.pandas_udf("array<struct<word:string,at:int>>")
    def runs(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [{"word": m.group(), "at": m.start()} for m in re.finditer(WORD, folded(x))])

    @F.pandas_udf("string")
    def low(s: pd.Series) -> pd.Series:
        return s.map(folded)

    first = terms.select("term", F.regexp_extract("term", WORD, 0).alias("word"))
    first = first.withColumn("before", F.instr("term", F.col("word")) - 1)
    words = lines.select("id", "line_no", low("line").alias("low"), F.explode(runs("line")).alias("r")).select("id", "line_no", "low", "r.word", "r.at")
    start = F.col("at") - F.col("before")
    met = words.join(first, "word").withColumn("start", start).withColumn("stop", start + F.char_length("term")).where((start >= 0) & (F.substring("low", start + 1, F.char_length("term")) == F.col("term")))
    edge = lambda i: F.substring("low", i, F.lit(1)).rlike("[a-z0-9A-Z]")
    outside = ~F.when(F.col("start") > 0, edge(F.col("start"))).otherwise(F.lit(False)) & ~edge(F.col("stop") + 1)
    return met.where(outside).select("id", "line_no", "term", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))


def occurrences(lines: DataFrame, terms: DataFrame, most: int = AUTOMATON) -> DataFrame:
    """(id, line_no, term, start, stop): where terms stand in lines(id, line_no, line), as whole words, in any letter case."""
    letters = terms.agg(F.coalesce(F.sum(F.char_length("term")), F.lit(0))).first()[0]
    if letters > most:
        return occurrences_by_words(lines, terms)
    return occurrences_by_automaton(lines, [r.term for r in terms.select("term").collect()])  # AUTOMATON letters at most


def masked(found: DataFrame) -> DataFrame:
    """Adds `kept`: terms take their spans longest first, then in order of the alphabet, then from the left; what a taken span overlaps is
    not kept. Occurrences of one term that overlap are one, from the left. Lines are sorted together and read in one pass, with the
    mask of one line at a time."""

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        line, mask, last = None, set(), (None, 0)
        for f in frames:
            rows = []
            for r in f.itertuples():
                if line != (r.id, r.line_no):
                    line, mask, last = (r.id, r.line_no), set(), (None, 0)
                if last[0] == r.term and r.start < last[1]:
                    continue
                last = (r.term, r.stop)
                span = range(r.start, r.stop)
                free = mask.isdisjoint(span)
                if free:
                    mask.update(span)
                rows.append((r.id, r.line_no, r.term, r.start, r.stop, free))
            yield pd.DataFrame(rows, columns=["id", "line_no", "term", "start", "stop", "kept"])

    ordered = found.repartition("id", "line_no").sortWithinPartitions("id", "line_no", -F.char_length("term"), "term", "start")
    return ordered.mapInPandas(take, FOUND + ", kept boolean")


def mine_terms(texts: DataFrame, lexicon: DataFrame, most: int = AUTOMATON) -> DataFrame:
    """(id, line_no, line_class, start, stop, raw, canon, kept) of texts(id, text) by lexicon(term, canon; a null canon is the term).

    Terms that a longer one covers come with kept = false. Blank lines, headers and addresses hold none."""
    lines = lines_of(texts)
    terms = terms_of(lexicon)
    found = masked(occurrences(lines, terms, most)).join(lines, ["id", "line_no"]).join(terms, "term")
    out = found.select("id", "line_no", line_class(F.col("line"), F.lit(True)).alias("line_class"), "start", "stop", F.expr("substring(line, start + 1, stop - start)").alias("raw"), "canon", "kept")
    return out.where("line_class not in ('skip', 'header')")


# Lines and scores.

PLACED = r"^\s*(\d{1,3})(?:[.)]|(?:st|nd|rd|th)[.:\s]|\s*-\s*)\s*([A-Za-zÀ-ÿ0-9'’.\-/ ]{2,60}?)(?:\s*[,(][^-–—:]*)?(?:\s*[-–—:]\s*(.*))?\s*$"
BARE = r"^\s*(\d{1,3})\s+([A-ZÀ-Ö][A-Za-zÀ-ÿ'’-]+\s+[A-Za-zÀ-ÿ'’-]{2,})(?=\s|$)"
NAMED_SCORE = r"[A-Z][A-Za-zÀ-ÿ'’.\-]+(?:\s+[A-Z][A-Za-zÀ-ÿ'’.\-]+){0,3}\s*[-–—:]\s*\d{1,3}(?:\.\d{1,3})?"
NUMBER = r"\b(\d{1,3}(?:\.\d{1,3})?)\b"


def placed_name(line: Column) -> Column:
    return F.when(line.rlike(PLACED), F.regexp_extract(line, PLACED, 2)).when(line.rlike(BARE), F.regexp_extract(line, BARE, 2))


def tells_score(line: Column) -> Column:
    low = F.lower(line)
    out = line.rlike(NAMED_SCORE)
    for word in SCORE_WORDS:
        out = out | F.contains(low, F.lit(word))
    return out


def score_in(line: Column) -> Column:
    """The first number behind a placed name, where the line tells of a score; null otherwise."""
    tail = F.when(line.rlike(PLACED), F.regexp_extract(line, PLACED, 3))
    return F.when(tells_score(line), F.nullif(F.regexp_extract(tail, NUMBER, 1), F.lit("")))


def line_class(line: Column, has_term: Column) -> Column:
    """skip, header, result_trick, result_score, result_plain or trick_chain."""
    shouted = (F.length(F.trim(line)) > 2) & F.trim(line).rlike(r"""^[A-Z0-9\s\-:./()&,!?'"]+$""") & F.trim(line).rlike("[A-Z0-9]")
    head = F.trim(line).rlike(r"^[-=*#_]{4,}$") | shouted
    return F.when((F.trim(line) == "") | line.rlike(r"https?://|www\."), "skip").when(head, "header").when(placed_name(line).isNotNull() & has_term, "result_trick").when(placed_name(line).isNotNull() & score_in(line).isNotNull(), "result_score").when(placed_name(line).isNotNull(), "result_plain").when(has_term, "trick_chain").otherwise("skip")


def score_class(name: Column, score: Column, line: Column, kind: Column) -> Column:
    """freestyle_judging, consecutive_count, distance_count, golf_score, raw_integer or reject, of a score text beside a name."""
    low, value = F.lower(line), F.try_to_number(score, F.lit("999.999")).cast("double")
    value = F.coalesce(value, score.try_cast("double"))
    has = lambda *ws: F.greatest(*[F.contains(low, F.lit(w)) for w in ws], F.lit(False))
    words = F.filter(F.split(F.upper(F.trim(F.coalesce(name, F.lit("")))), r"\s+"), lambda w: w != "")
    division = F.forall(words, lambda w: w.isin(*DIVISION_WORDS))
    shouted = (F.size(words) <= 2) & (F.upper(F.trim(name)) == F.trim(name)) & ~name.rlike(r"\p{Ll}")
    decimal = F.contains(score, F.lit("."))
    return (
        F.when(kind.isin("header", "skip") | division | F.coalesce(shouted, F.lit(False)) | value.isNull(), "reject").when(decimal & (value < 30), "freestyle_judging").when(decimal, "raw_integer")
        .when((value > 100) & has("consecutive", "kicks"), "consecutive_count").when(has("pass", "distance", "meter", "metre"), "distance_count").when(has("golf") | (value < 30), "golf_score").otherwise("raw_integer")
    )


def scored_lines(texts: DataFrame) -> DataFrame:
    """(id, line_no, name, score, score_class) of the placed lines that tell of a score."""
    lines = lines_of(texts)
    kind = line_class(F.col("line"), F.lit(False))
    found = lines.select("id", "line_no", "line", kind.alias("kind"), placed_name(F.col("line")).alias("name"), score_in(F.col("line")).alias("score")).where("score is not null and kind not in ('skip', 'header')")
    return found.select("id", "line_no", F.trim("name").alias("name"), "score", score_class(F.col("name"), F.col("score"), F.col("line"), F.col("kind")).alias("score_class"))
