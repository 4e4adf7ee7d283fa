"""Sources and sinks: string-typed CSV, JSON lines, whole documents, unions of equal headers, deterministic writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def csv_strings(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """All columns are strings and a missing value is the empty string. Quoted commas and doubled quotes are read as such."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"').option("multiLine", True).csv(path).na.fill("")


def merge_sources(frames: list[DataFrame | None], key: str) -> tuple[DataFrame, DataFrame]:
    """The union of frames with one header, and the keys that several of its rows share. Sources that are missing (None) are passed over."""
    frames = [f for f in frames if f is not None]
    if not frames:
        raise ValueError("no source is there")
    header = frames[0].columns
    for f in frames[1:]:
        if f.columns != header:
            raise ValueError(f"headers differ: {header} and {f.columns}")
    both = frames[0]
    for f in frames[1:]:
        both = both.unionByName(f)
    return both, both.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def results_block(rows: DataFrame, division: str, place: str, player1: str, player2: str | None = None) -> DataFrame:
    """(event, text): one row a placement to a text of headed lines, divisions in the order they come in, places by number.
    rows(ord, event, ...)."""
    name = F.concat_ws(" / ", F.nullif(F.trim(player1), F.lit("")), *([F.nullif(F.trim(player2), F.lit(""))] if player2 is not None else []))
    lines = rows.where(name != "").groupBy("event", F.col(division).alias("division")).agg(F.min("ord").alias("ord"), F.array_sort(F.collect_list(F.struct(F.col(place).cast("int").alias("p"), F.col("ord").alias("o"), name.alias("n")))).alias("a"))
    block = F.concat_ws("\n", F.col("division"), F.array_join(F.transform("a", lambda x: F.concat(x["p"].cast("string"), F.lit(". "), x["n"])), "\n"))
    return lines.groupBy("event").agg(F.array_sort(F.collect_list(F.struct("ord", block.alias("b")))).alias("s")).select("event", F.array_join(F.transform("s", lambda x: x["b"]), "\n\n").alias("text"))


def move_list(pages: DataFrame, row: str = r"<tr[^>]*>(.*?)</tr>") -> DataFrame:
    """(page, nth, name, adds, notation, tags) of the table rows of list pages: cells in that order, tags by commas; rows without name or
    with a heading's cells are none."""
    rows = pages.select("page", F.posexplode(F.regexp_extract_all("html", F.lit(f"(?is){row}"), F.lit(1))).alias("nth", "row"))
    cells = F.transform(F.regexp_extract_all("row", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", ""), r"\s+", " ")))
    at = lambda i: F.nullif(F.try_element_at("cells", F.lit(i)), F.lit(""))
    out = rows.withColumn("cells", cells).where(at(1).isNotNull())
    tags = F.filter(F.transform(F.split(F.coalesce(at(4), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return out.select("page", "nth", at(1).alias("name"), F.try_to_number(at(2), F.lit("99")).cast("int").alias("adds"), at(3).alias("notation"), F.array_join(tags, "|").alias("tags"))


def fields(pages: DataFrame, text: str, classes: dict[str, str], labels: dict[str, str] | None = None) -> DataFrame:
    """Adds a column for each class-addressed element and each bold label: the text of the element, or what follows the label up to the
    next break; empty where there is none."""
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", ""), "&amp;", "&"), r"\s+", " "))
    found = {n: plain(F.regexp_extract(text, rf"(?is)<(\w+)[^>]*\bclass\s*=\s*[\"']?[^\"'>]*\b{c}\b[^>]*>(.*?)</\1>", 2)) for n, c in classes.items()}
    found |= {n: plain(F.regexp_extract(text, rf"(?is)<(?:b|strong)[^>]*>\s*{c}\s*:?\s*</(?:b|strong)>\s*:?\s*(.*?)(?:<br|</p|</div|<b>|<strong>|$)", 1)) for n, c in (labels or {}).items()}
    return pages.withColumns(found)


def override_merge(base: DataFrame, extra: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Rows of both; where they share a key the extra row stands, the first in order (of all columns, if none is given)."""
    both = base.withColumn("_p", F.lit(1)).unionByName(extra.withColumn("_p", F.lit(0)))
    w = Window.partitionBy(key).orderBy("_p", *(order or base.columns))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_p", "_n")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def whole_texts(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """(path, text) of each file below a folder; bytes that are not UTF-8 are read as Latin-1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select("path", text.alias("text"))


def text_blocks(docs: DataFrame, key: str, text: str, header: str) -> DataFrame:
    """(key, line_no, line, block, block_header): lines of a text; each that matches `header` begins a block, lines before are block 0."""
    lines = docs.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    is_header = F.col("line").rlike(header)
    return lines.withColumn("block", F.sum(F.when(is_header, 1).otherwise(0)).over(w)).withColumn("block_header", F.last(F.when(is_header, F.col("line")), ignorenulls=True).over(w))


def parse_placements(lines: DataFrame, key: str, division: str = r"^\s*([A-Za-z][A-Za-z ]+?)\s*:?\s*$") -> DataFrame:
    """(key, line_no, division, place, player1, player2, confidence) from lines (key, line_no, line).

    A line without a number heads a division, which is carried down; `12. Name`, `12) Name`, `12 - Name` and `1st Name` are placements;
    `A & B`, `A / B` and `A and B` are teams. Places of 100 and more are no placements."""
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    grammar = r"^\s*(\d{1,3})(?:st|nd|rd|th)?\s*[.):\-]?\s+(\S.*?)\s*$"
    head = F.nullif(F.regexp_extract("line", division, 1), F.lit(""))
    out = lines.withColumn("division", F.last(head, ignorenulls=True).over(w))
    out = out.withColumn("place", F.try_to_number(F.nullif(F.regexp_extract("line", grammar, 1), F.lit("")), F.lit("999")).cast("int")).where("place between 1 and 99")
    team = F.split(F.regexp_extract("line", grammar, 2), r"\s+(?:&|/|and)\s+", 2)
    return out.select(key, "line_no", F.coalesce("division", F.lit("Unknown")).alias("division"), "place", team[0].alias("player1"), F.try_element_at(team, F.lit(2)).alias("player2"), F.when(F.col("division").isNull(), "medium").otherwise("high").alias("confidence"))


def write_sorted(df: DataFrame, path: str, order: list[Column | str], form: str = "parquet") -> None:
    """Replaces what is at the path; rows in order over all files."""
    df.orderBy(*order).write.mode("overwrite").format(form).options(**({"header": True} if form == "csv" else {})).save(path)
