"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

The mix is a sequence of slots. Each source has as many as its target asks for, of about BLOCK words each. Slot k is mapped to the point
k * g mod N of a golden-ratio lattice (N slots in all; g, next to N over the golden ratio, has no divisor in common with N, so every
point is met once), and the point through the sources' cumulative slots to a source: any run of slots holds each source in nearly its
share, all slots together hold it exactly. A source's slots are ranked, and rank j is joined to its j-th block: the source's documents,
shuffled by a hash of their ids, lie end to end, over and over, and are cut into blocks whose words differ by one at most. What the mix
takes of a document is what its blocks that are in slots hold of it. The same rows always give the same mix.

Sources weigh 1, 2, 3, repeating, by code point order, null last. Targets share all words by weight; none exceeds LIMIT times its
source's words, the excess being reshared by weight. No word is taken more than LIMIT times.

Nulls: a null text has no words; a null source is a source; a null id is shuffled as -1 would be. Documents without words take none.
Empty tables give empty results; repeated rows are rows of their own. Other columns are not read by `mix`; `mixed_documents` passes all on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._base import buckets_for, fresh, ranked, running_total, written

BLOCK = 256
LIMIT = 3
#: Sources up to this many are broadcast; more are joined by shuffle.
FEW = 100_000
#: Slots are numbers under 2**40, so that products with half of one keep to 64 bits.
HALF, MOST_SLOTS = 22, 1 << 40


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column) -> Column:
    """60 bits of a hash of the id."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("mix"), F.coalesce(doc_id.cast("long"), F.lit(-1)).cast("string"))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """source, nth, source_size, weight, target of each source, from its source and source_size.

    A water level is sought with sum(min(weight * level, limit * size)) = sum(size). It rises from round to round as full sources leave
    their excess to the others, until no more fill up; the driver holds sums only."""
    order, place = ranked(sizes, [F.col("source").asc_nulls_last()], "source-order")
    w = written(order.select("source", "source_size", (F.col(place) + 1).alias("nth")), "source-names")
    w = w.withColumn("weight", (F.pmod(F.col("nth") - 1, F.lit(3)) + 1).cast("double")).withColumn("cap", F.col("source_size") * float(limit))
    level, everything = -1.0, float(w.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        full = F.col("cap") < F.lit(level) * F.col("weight")
        filled, unfilled = w.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not unfilled:
            break
        risen = (everything - filled) / unfilled
        if risen <= level:
            break
        level = risen
    return w.select("source", "nth", "source_size", "weight", F.least("cap", F.lit(max(level, 0.0)) * F.col("weight")).alias("target"))


def golden_step(n: int) -> int:
    """The number nearest to n over the golden ratio, from there upwards, that has no divisor in common with n."""
    step = max(1, round(n * 0.6180339887498949))
    while math.gcd(step, n) > 1:
        step += 1
    return step


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(slot, nth, rank): the source of each slot, and how many of its slots come before. `sources` has nth and n, its number of slots.

    Each source's interval of points is listed under the equal cells that it meets, and slots look up their cell: cells hold equally many
    slots whatever the shares are."""
    if slots >= MOST_SLOTS:
        raise ValueError(f"more than {MOST_SLOTS} slots: raise BLOCK")
    spark, n_sources = sources.sparkSession, sources.count()
    cells = 1 << max(12, (4 * n_sources).bit_length())
    width = max(1, -(-slots // cells))
    dealt = sources.withColumn("_one", F.lit(0)).withColumn("_deal", F.floor(F.col("nth") / 4096))
    bounds = running_total(dealt, ["_one"], "_deal", ["nth"], F.col("n"), "lo").where("n > 0").select("nth", "lo", (F.col("lo") + F.col("n")).alias("hi"))
    bounds = bounds.select("nth", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    bounds = written(bounds, "bounds")
    step, low = golden_step(slots) if slots else 1, (1 << HALF) - 1
    k = F.col("id")
    at = F.pmod(F.pmod(F.shiftright(k, HALF) * step, F.lit(max(1, slots))) * (low + 1) + k.bitwiseAND(low) * step, F.lit(max(1, slots)))
    points = spark.range(slots).select(k.alias("slot"), at.alias("at")).withColumn("cell", F.floor(F.col("at") / width))
    found = points.join(F.broadcast(bounds) if n_sources <= FEW else bounds, "cell").where("at >= lo and at < hi").select("slot", "nth")
    return running_total(found.withColumn("_deal", F.floor(F.col("slot") / 100_000)), ["nth"], "_deal", ["slot"], F.lit(1), "rank").select("slot", "nth", "rank")


def block_of(at: Column) -> Column:
    """Which block of its source a word is in: the first `more` blocks hold `each` + 1 words, the others `each`."""
    edge = F.col("more") * (F.col("each") + 1)
    return F.when(at < edge, F.floor(at / (F.col("each") + 1))).otherwise(F.col("more") + F.floor((at - edge) / F.col("each"))).cast("long")


def mix_rows(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """What `mix` says, with the row's shuffle key."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"))
    rows = written(rows.withColumn("key", shuffle_key(F.col("doc_id"))).withColumn("rid", F.monotonically_increasing_id()), "sized")
    n_rows = rows.count()
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), limit)
    sources = sources.withColumn("words", F.least(F.round("target").cast("long"), F.col("source_size") * limit))
    sources = sources.withColumn("n", F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / BLOCK))).otherwise(0).cast("long"))
    sources = sources.withColumn("each", F.when(F.col("n") > 0, F.floor(F.col("words") / F.greatest("n", F.lit(1)))).otherwise(0)).withColumn("more", F.col("words") - F.col("n") * F.col("each"))
    sources = written(sources, "sources")
    n_sources, slots = sources.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    plan = schedule(sources.select("nth", "n"), slots)
    facts = sources.select(F.col("source").alias("_s"), "nth", "source_size", "target", "words", "each", "more")
    named = rows.join(F.broadcast(facts) if n_sources <= FEW else facts, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # The hash's leading bits deal a hot source into buckets.
    deal = buckets_for(n_rows)
    named = named.withColumn("_deal", F.shiftright("key", 60 - (deal.bit_length() - 1)))
    placed = written(running_total(named, ["nth"], "_deal", ["key", "doc_id", "size", "rid"], F.col("size"), "at"), "placed")
    # Each time that the endless row of the source's documents comes to this one before the target is reached; then each block there.
    passes = placed.where("size > 0 and at < words").withColumn("begin", F.explode(F.expr("transform(sequence(0, (words - 1 - at) div source_size), p -> at + p * source_size)")))
    passes = passes.withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("words")))
    parts = passes.withColumn("rank", F.explode(F.sequence(block_of(F.col("begin")), block_of(F.col("end") - 1))))
    opens = F.col("rank") * F.col("each") + F.least("rank", "more")
    closes = (F.col("rank") + 1) * F.col("each") + F.least(F.col("rank") + 1, F.col("more"))
    parts = parts.select("rid", "nth", "rank", (F.least("end", closes) - F.greatest("begin", opens)).alias("part"))
    taken = parts.join(plan, ["nth", "rank"]).groupBy("rid").agg(F.sum("part").alias("taken"), F.min("slot").alias("first_slot"))
    return placed.join(taken, "rid", "left").select("doc_id", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("first_slot", F.lit(-1)).cast("long").alias("first_slot"), "key")


def mix(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, first_slot for each row; `taken` counts repeats. `first_slot` is where in the mix
    the document is first met, -1 if it is not taken: read in this order, documents come in the schedule's proportions from the start."""
    return mix_rows(docs, limit).drop("key")


def mixed_documents(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The mix as rows of documents: each document as often as the mix takes its words, to the nearest whole number of times.

    Along a source's shuffled order these numbers fall by one at one place. So a row of each source says it all, and texts are not
    shuffled. Rows of one source with equal ids and sizes are taken alike."""
    src, base, cut, times, again, size = fresh(docs, "_src", "_base", "_cut", "_times", "_again", "_size")
    place = lambda key, doc_id, n: F.struct(key.alias("k"), F.coalesce(doc_id.cast("long"), F.lit(-1)).alias("i"), n.alias("n"))
    took = mix_rows(docs, limit).where("size > 0").withColumn("times", F.round(F.col("taken") / F.col("size")).cast("int"))
    took = written(took.select("source", "times", place(F.col("key"), F.col("doc_id"), F.col("size")).alias("place")), "times")
    low = took.groupBy("source").agg(F.min("times").alias("low"))
    tops = took.groupBy("source", "times").agg(F.max("place").alias("top"))
    rule = tops.join(low.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).groupBy("source").agg(F.min("low").alias(base), F.max(F.when(F.col("times") > F.col("low"), F.col("top"))).alias(cut))
    rule = written(rule.withColumnRenamed("source", src), "rule")
    own = docs.withColumn(size, word_count(F.col("text").cast("string")))
    joined = own.where(F.col(size) > 0).join(F.broadcast(rule) if rule.count() <= FEW else rule, F.col("source").cast("string").eqNullSafe(F.col(src)))
    more = F.coalesce(place(shuffle_key(F.col("doc_id")), F.col("doc_id"), F.col(size)) <= F.col(cut), F.lit(False))
    joined = joined.withColumn(times, F.col(base) + F.when(more, 1).otherwise(0)).where(F.col(times) > 0)
    return joined.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)
