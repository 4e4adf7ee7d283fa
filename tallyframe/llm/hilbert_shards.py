"""Shards along a Hilbert curve, so that files can be pruned by several metadata columns at once. DataFrame functions only.

Each dimension (source, lang, size) is quantised to 2**bits cells at quantiles of its whole values: a value's cell is its share of the
rows that come before it in the values' order. The cells' index on the curve orders the rows, and runs of that order are cut so that the
shards' row counts are at most one apart (law `rows`). Rows of one cell follow source, lang and size, then checksum and id: a cell of any
number of rows stays ordered, and equal texts with equal metadata are neighbours. `bits` grows with the rows (see `bits_for`).

Nulls in a dimension come before all values; a null text counts as empty (size 1). Repeated rows are rows of their own, in any order
among themselves. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._base import ranked, written

#: Values of a dimension up to this many are broadcast; more are joined by shuffle.
FEW = 100_000


def bits_for(rows: int) -> int:
    """Bits of each of three dimensions: about as many cells as rows / 64, from 4 bits to 16."""
    return min(16, max(4, -(-max(0, (rows // 64).bit_length()) // 3)))


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """The index on the Hilbert curve of a point whose coordinates are integers of `bits` bits.

    Each turn of the fold undoes one level of the curve's rotations and reflections, from the top bit down; the coordinates are then
    Gray-coded and their bits interleaved."""
    n = len(dims)

    def turn(x: Column, q: Column) -> Column:
        low = q - 1

        def one(a: Column, i: Column) -> Column:
            first, own = a[0], F.element_at(a, i + 1)
            swap = first.bitwiseXOR(own).bitwiseAND(low)
            flipped = F.transform(a, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
            swapped = F.transform(a, lambda v, j: F.when((j == 0) | (j == i), v.bitwiseXOR(F.when(i == 0, F.lit(0).cast("long")).otherwise(swap))).otherwise(v))
            return F.when(own.bitwiseAND(q) != 0, flipped).otherwise(swapped)

        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), x, one)

    long = lambda v: F.lit(v).cast("long")
    point = F.array(*[d.cast("long") for d in dims])
    tops = [1 << k for k in range(bits - 1, 0, -1)]
    folded = F.aggregate(F.array(*[long(q) for q in tops]), point, turn) if tops else point
    # Gray code: coordinate i becomes the xor of the coordinates up to i.
    gray = F.aggregate(folded, F.array().cast("array<long>"), lambda acc, v: F.concat(acc, F.array(F.when(F.size(acc) == 0, v).otherwise(v.bitwiseXOR(F.element_at(acc, -1))))))
    last = lambda g: F.element_at(g, -1)
    turned = F.aggregate(F.array(gray), long(0), lambda acc, g: F.aggregate(F.array(*[long(q) for q in tops]), acc, lambda t, q: F.when(last(g).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)) if tops else acc)
    places = F.array(*[long(b) for b in range(bits - 1, -1, -1)])
    interleave = lambda acc, b: F.aggregate(gray, acc, lambda a, v: a * 2 + F.pmod(F.floor((v.bitwiseXOR(turned)) / F.pow(F.lit(2.0), b)), F.lit(2)).cast("long"))
    return F.aggregate(places, long(0), interleave)


def quantised(rows: DataFrame, name: str, bits: int, total: int) -> DataFrame:
    """Adds `name`_cell: the share of the rows whose value of `name` comes before this row's, in 2**bits steps.

    Values are counted before they are shuffled. Their running totals take two levels: within the partitions of their order, and over
    these."""
    counts = rows.groupBy(name).agg(F.count("*").alias("_n"))
    placed, place = ranked(counts, [F.col(name).asc_nulls_first()], f"{name}-values")
    few = placed.count() <= FEW
    # Blocks of values by place: their totals are few, and each block's own running total is short.
    step = 4096
    placed = placed.withColumn("_block", F.floor(F.col(place) / step))
    blocks = placed.groupBy("_block").agg(F.sum("_n").alias("_sum"))
    above = F.expr("coalesce(sum(_sum) over (order by _block rows between unbounded preceding and 1 preceding), 0)")
    inside = F.expr(f"coalesce(sum(_n) over (partition by _block order by {place} rows between unbounded preceding and 1 preceding), 0)")
    placed = placed.withColumn("_inside", inside).join(blocks.select("_block", above.alias("_above")), "_block")
    cells = placed.select(F.col(name).alias("_value"), F.least(F.lit(2**bits - 1), F.floor((F.col("_above") + F.col("_inside")) * float(2**bits) / max(1, total))).cast("int").alias(f"{name}_cell"))
    return rows.join(F.broadcast(cells) if few else cells, F.col(name).eqNullSafe(F.col("_value"))).drop("_value")


def hilbert_shards(docs: DataFrame, shards: int = 16, bits: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert for each row of documents."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The only pass over the texts; what follows reads a few numbers and names for each row.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    rows = written(rows, "metadata")
    total = rows.count()
    bits = bits or bits_for(total)
    for name in ("source", "lang", "size"):
        rows = quantised(rows, name, bits, total)
    # The curve is computed for cells, not rows: few beside the rows, and joined back by their own number.
    number = ((F.col("source_cell").cast("long") * 2**bits + F.col("lang_cell")) * 2**bits + F.col("size_cell")).alias("cell")
    rows = written(rows.select("doc_id", "size", "text_crc32", "source", "lang", number), "cells")
    axes = [F.shiftright("cell", 2 * bits), F.shiftright("cell", bits).bitwiseAND(2**bits - 1), F.col("cell").bitwiseAND(2**bits - 1)]
    cells = rows.select("cell").distinct().withColumn("hilbert", hilbert_index(axes, bits))
    cells = written(cells, "curve")
    rows = rows.join(F.broadcast(cells) if cells.count() <= FEW else cells, "cell")
    placed, place = ranked(rows.drop("cell"), ["hilbert", F.col("source").asc_nulls_first(), F.col("lang").asc_nulls_first(), "size", "text_crc32", "doc_id"], "curve-order")
    each, more = divmod(total, shards)
    # The first `more` shards hold one row more than the rest.
    rank, edge = F.col(place), more * (each + 1)
    shard = F.when(rank < edge, F.floor(rank / (each + 1))).otherwise(more + F.floor((rank - edge) / max(each, 1))).cast("int")
    start = F.col("shard").cast("long") * each + F.least(F.col("shard"), F.lit(more))
    return placed.withColumn("shard", shard).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (rank - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def reference_index(point: list[int], bits: int) -> int:
    """The same index by walking the curve's definition level by level; for tests."""
    x, n = list(point), len(point)
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for q in (1 << k for k in range(bits - 1, 0, -1)):
        if x[-1] & q:
            t ^= q - 1
    return sum(((x[i] ^ t) >> b & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))
