"""Exact deduplication by deterministic block naming.

A text, lower-cased A-Z, is cut into blocks of BLOCK bytes. Sorting the blocks gives each distinct block an integer name; pairs of
neighbouring names are then sorted and named in turn, until one name is left for each document. Names come from comparing whole
values, never from hashes, so equal (number of blocks, name) means equal texts. A text whose first block no other text of as many blocks
has is told apart by that, and its pairs need no names.

Hot groups: each task ships a block's bytes once, however often the block occurs there, and all later tables hold integers only. A block
that so comes from over MANY tasks is first thinned out in SALTS parts, so that what meets in one task does not grow with the tasks.
Nulls: a null text counts as empty; a null doc_id is a row like any other and sorts below all ids. Repeated rows: each is a row of
its group and one of them stays. Empty tables give empty results. Other columns are not read, but for `keep_one`, which passes all on.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm._base import Scope, ascii_lower, only, settle, written

BLOCK = 4096
#: Bytes of blocks that one task remembers while it looks for repeats.
REMEMBER = 48_000_000
MANY, SALTS = 1000, 64
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
CUT = "rid long, doc_id long, sha string, blocks int, pos int, rep long, block binary"
CUT_ARROW = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("sha", pa.string()), ("blocks", pa.int32()), ("pos", pa.int32()), ("rep", pa.int64()), ("block", pa.binary())])


def cut_blocks(batches: Iterator[pa.RecordBatch], block: int = BLOCK, remember: int = REMEMBER) -> Iterator[pa.RecordBatch]:
    """A row for each block; its bytes only where this task meets the block for the first time (since it last forgot)."""
    settle()
    top = TaskContext.get().partitionId() << 40
    seen: dict[bytes, int] = {}
    held = n_rows = n_reps = 0
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        out: list[list] = [[] for _ in CUT_ARROW]
        size = 0
        for i, doc_id in enumerate(ids):
            raw = (texts[i].as_py() or "").encode().translate(LOWER)
            sha, rid, blocks = hashlib.sha256(raw).hexdigest(), top + n_rows, max(1, -(-len(raw) // block))
            n_rows += 1
            for pos in range(blocks):
                part = raw[pos * block : (pos + 1) * block]
                rep = seen.get(part)
                new = rep is None
                if new:
                    if held > remember:
                        seen.clear()
                        held = 0
                    rep = seen[part] = top + n_reps
                    n_reps += 1
                    held += len(part) + 100
                    size += len(part)
                for column, value in zip(out, (rid, doc_id, None if pos else sha, blocks, pos, rep, part if new else None), strict=True):
                    column.append(value)
            if size > 16_000_000:
                yield pa.record_batch(out, schema=CUT_ARROW)
                out, size = [[] for _ in CUT_ARROW], 0
        yield pa.record_batch(out, schema=CUT_ARROW)


def name_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block: a new name begins wherever the block differs from the one before."""
    name, last = (TaskContext.get().partitionId() << 40) - 1, None
    for batch in batches:
        names = []
        for value in batch.column(1).to_pylist():
            if value != last:
                name, last = name + 1, value
            names.append(name)
        yield pa.record_batch([batch.column(0), pa.array(names, pa.int64())], names=["rep", "name"])


def block_names(reps: DataFrame, many: int = MANY) -> DataFrame:
    """(rep, name): equal blocks have one name. `reps` has rep and block, a block once for each task that met it."""
    mark = F.xxhash64("block")
    hot = written(reps.groupBy(mark.alias("mark")).agg(F.count("*").alias("n")).where(F.col("n") > many).select("mark"), "hot-blocks")
    first, thin = None, reps
    if not hot.isEmpty():
        marked = reps.withColumn("mark", mark)
        w = Window.partitionBy("block", F.pmod(F.xxhash64("rep"), F.lit(SALTS)))
        first = written(marked.join(hot, "mark", "left_semi").withColumn("first", F.min("rep").over(w)).select("rep", "first", F.when(F.col("rep") == F.col("first"), F.col("block")).alias("block")), "thinned")
        thin = marked.join(hot, "mark", "left_anti").select("rep", "block").union(first.where("block is not null").select("rep", "block"))
    names = written(thin.repartition("block").sortWithinPartitions("block").mapInArrow(name_sorted, "rep long, name long"), "names")
    if first is None:
        return names
    return names.union(first.where("rep <> first").select(F.col("rep").alias("other"), "first").join(names, F.col("first") == F.col("rep")).select("other", "name"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, many: int = MANY) -> DataFrame:
    """rid, doc_id, sha, blocks, name: rows with equal (blocks, name) have equal texts, and no others."""
    with Scope() as scope:
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        cut = written(source.mapInArrow(lambda it: cut_blocks(it, block), CUT), "blocks")
        names = block_names(cut.where("block is not null").select("rep", "block"), many)
        rows = written(cut.select("rid", "doc_id", "sha", "blocks", "pos", "rep").join(names, "rep").drop("rep"), "named")
        heads = rows.where("pos = 0")
        shared = heads.where("blocks > 1").groupBy("blocks", "name").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        together = written(heads.where("blocks > 1").join(shared, ["blocks", "name"], "left_semi").select("rid"), "together")
        level = written(rows.where("blocks > 1").join(together, "rid", "left_semi").select("rid", "blocks", "pos", "name"), "level")
        # Texts of one block have their name; those told apart by their first block have one of their own.
        done = heads.where("blocks = 1").select("rid", "blocks", "name")
        done = done.union(heads.where("blocks > 1").join(together, "rid", "left_anti").select("rid", "blocks", (-1 - F.col("rid")).alias("name")))
        most, width = level.agg(F.max("blocks")).first()[0] or 1, 1
        while width < most:
            width *= 2
            half = F.col("pos").bitwiseAND(1)
            pairs = level.groupBy("rid", "blocks", F.shiftright("pos", 1).alias("pos")).agg(F.max(F.when(half == 0, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("r"))
            pairs = written(pairs, "pairs")
            named = written(pairs.select("l", "r").distinct().sortWithinPartitions("l", "r").withColumn("name", F.monotonically_increasing_id()), "pairnames")
            level = pairs.join(named, ["l", "r"]).select("rid", "blocks", "pos", "name")
            done = done.union(level.where(F.col("blocks") <= width).select("rid", "blocks", "name"))
            level = level.where(F.col("blocks") > width)
        return scope.stay(written(heads.select("rid", "doc_id", "sha").join(done, "rid"), "identities"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row; of equal texts the row with the largest id is kept."""
    named = identities(docs, id_col, text_col, block)
    groups = written(named.groupBy("blocks", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("best")), "groups")
    return named.join(groups, ["blocks", "name"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def row_key(doc_id: Column, sha: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), sha)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that exact_dedup keeps, with all their columns. Of rows equal in id and text one stays, the same one each time."""
    kept = exact_dedup(docs).where("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    own = F.sha2(F.encode(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), "UTF-8"), 256)
    return only(docs, row_key(F.col("doc_id").cast("long"), own), kept)
