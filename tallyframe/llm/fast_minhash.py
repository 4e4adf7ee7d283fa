"""Near-duplicates: fast similarity sketching, banding, exact verification.

Sketch (Dahlgaard, Knudsen, Thorup, "Fast similarity sketching"): round i throws every shingle into a hashed bin of the COORDINATES,
with value (i, hash); a bin keeps its least value, and rounds end when no bin is empty. From round COORDINATES on, round i throws all
into bin i - COORDINATES, so every coordinate fills. Two sets agree in a coordinate with probability their Jaccard similarity, and the
agreements concentrate as if drawn without replacement. Bands of ROWS coordinates give candidate buckets; with the defaults a pair at
the threshold shares no bucket with probability (1 - 0.75**5)**64 < 4e-8.

Documents with equal word sequences form a class first, so copies are never paired. Linking a bucket of classes needs no pairs of all
members: each class is tried against its hub, the mate whose buckets are the fullest. What a bucket of several components still holds
may share no more than a common passage, so these classes are dealt anew, by their rare shingles: of n shingles in order of rarity, two
sets that reach the threshold share one among the first n - ceil(0.75 n) + 1 of each, whatever the order, and behind the first that they
share either holds enough of the rest. Rarity is counted among these classes in COUNTERS hashed counters; of shingles that the same
classes share, the first in order stands for all. Groups are dealt by a hash into parts of about BLOCK members. Then, in every group that
still holds several components, the members of its parts outside the largest component are tried against the members of other
components: in rounds of one part, two, four and so on, until none is left untried. A pair is so either already connected or tried,
unless it cannot reach the threshold: the sizes differ too much, or their distances to one hub do (Jaccard distance obeys the triangle
inequality). Tried pairs whose sketches agree in fewer than AGREE of the coordinates, five deviations below what a pair at the threshold
has, are dropped before full sets are compared. Rows of one group are dealt to SALTS tasks, and what they meet is sent to all of these.

Shingles are compared as 64-bit hashes. Nulls: a null text has no shingles and links with nothing; null ids are rows like any other.
Repeated rows join one class. Empty tables give empty results; other columns are not read, but for `keep_one`, which passes all on.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._base import Scope, components, merged, mix64, only, settle, written

WORDS, NUM, DEN = 5, 75, 100
BANDS, ROWS = 64, 5
BLOCK, SALTS = 256, 16
AGREE = 0.628
COUNTERS = 1 << 18
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
FULL = np.uint64(2**64 - 1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def shingle_hashes(words: list[bytes], k: int = WORDS) -> np.ndarray:
    """The distinct hashes of all runs of k words, sorted; of the whole sequence if it is shorter; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    acc = np.full(n, min(k, len(words)), np.uint64)
    for j in range(min(k, len(words))):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n]
    return np.unique(mix64(acc))


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """A row of t coordinates for each non-empty set."""
    s = np.full(len(sets) * t, FULL, np.uint64)
    owner = np.repeat(np.arange(len(sets), dtype=np.int64), [len(x) for x in sets])
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for i in range(2 * t):
        h = mix64(values ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        place = np.uint64(i << 48) | (h >> np.uint64(16))
        column = ((h & np.uint64(0xFFFF)) * np.uint64(t) >> np.uint64(16)).astype(np.int64) if i < t else i - t
        np.minimum.at(s, owner * t + column, place)
        short = (s.reshape(-1, t) == FULL).any(axis=1)
        if not short.any():
            break
        live = short[owner]
        if not live.all():
            owner, values = owner[live], values[live]
    return s.reshape(-1, t)


def band_hashes(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    cut = s.reshape(len(s), bands, rows)
    acc = np.broadcast_to(np.arange(bands, dtype=np.uint64), cut.shape[:2]).copy()
    for k in range(rows):
        acc = mix64(acc * np.uint64(0xD6E8FEB86659FD93) ^ cut[:, :, k])
    return acc.view(np.int64)


SKETCHED = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])


def sketch_batches(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    def flush(ids, marks, digests, sets):
        full = [i for i, x in enumerate(sets) if len(x)]
        found = dict(zip(full, band_hashes(sketches([sets[i] for i in full], bands * rows), bands, rows), strict=True))
        return pa.record_batch([ids, marks, [len(x) for x in sets], digests, [found.get(i, ()) for i in range(len(sets))]], schema=SKETCHED)

    settle()
    for batch in batches:
        ids, marks, digests, sets, held = [], [], [], [], 0
        for doc_id, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = words_of(text.as_py())
            ids.append(doc_id)
            marks.append(mark)
            digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
            sets.append(shingle_hashes(words))
            held += len(sets[-1])
            if held > 600_000:
                yield flush(ids, marks, digests, sets)
                ids, marks, digests, sets, held = [], [], [], [], 0
        yield flush(ids, marks, digests, sets)


def set_batches(batches: Iterator[pa.RecordBatch], t: int) -> Iterator[pa.RecordBatch]:
    """(digest, shingles as sorted longs, the low bits of the sketch) of each text with words."""
    schema = pa.schema([("digest", pa.binary()), ("shingles", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int16()))])

    def flush(digests, sets):
        low = (sketches(sets, t) & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16)
        return pa.record_batch([digests, [x.view(np.int64) for x in sets], list(low)], schema=schema)

    settle()
    for batch in batches:
        digests, sets, held = [], [], 0
        for text in batch.column(0):
            words = words_of(text.as_py())
            if not words:
                continue
            digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
            sets.append(shingle_hashes(words))
            held += len(sets[-1])
            if held > 300_000 or len(sets) == 1000:
                yield flush(digests, sets)
                digests, sets, held = [], [], 0
        yield flush(digests, sets)


def likely(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """The pairs (a, b) whose sketches agree well enough."""
    left, right = sets.select(F.col("class").alias("a"), F.col("sketch").alias("ka")), sets.select(F.col("class").alias("b"), F.col("sketch").alias("kb"))
    same = F.aggregate(F.zip_with("ka", "kb", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return pairs.join(left, "a").join(right, "b").where(same >= int(AGREE * t)).select("a", "b")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds to the pairs (a, b) the sizes of the intersection and the union of their full sets."""
    left, right = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return both.select("a", "b", "both", (F.size("sa") + F.size("sb") - F.col("both")).alias("either"))


def of_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets of the classes in `pairs`, written: a small table if the pairs are few."""
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct(), "ends")
    return written(sets.join(ends, "class", "left_semi"), "sets")


def rarest(batches: Iterator[pa.RecordBatch], counts: Broadcast) -> Iterator[pa.RecordBatch]:
    """(class, s, rarity, pos) of each (class, shingles): those that a set reaching the threshold with it must share one of."""
    for batch in batches:
        kept = []
        for shingles in batch.column(1):
            x = shingles.values.to_numpy()
            c = counts.value[x & (COUNTERS - 1)]
            order = np.lexsort((x, c))[: len(x) - -(-len(x) * NUM // DEN) + 1]
            kept.append((x[order], c[order]))
        of = np.repeat(batch.column(0).to_numpy(), [len(x) for x, _ in kept])
        columns = [np.concatenate([np.zeros(0, np.int64), *k]) for k in (*zip(*kept, strict=True), [np.arange(1, len(x) + 1) for x, _ in kept])] if kept else [of] * 3
        yield pa.record_batch([of, *columns], names=["class", "s", "rarity", "pos"])


def by_rare_shingles(classes: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, class, pos) for the given classes: groups that share a rare shingle, the first of those that the same classes share."""
    own = written(sets.join(classes, "class", "left_semi").select("class", "shingles"), "rare-sets")
    slots = own.select(F.explode("shingles").alias("s")).groupBy(F.col("s").bitwiseAND(F.lit(COUNTERS - 1)).alias("slot")).agg(F.count("*").alias("n"))
    found = slots.toArrow()  # at most COUNTERS rows
    counts = np.zeros(COUNTERS, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    held = classes.sparkSession.sparkContext.broadcast(counts)
    rare = written(own.mapInArrow(lambda it: rarest(it, held), "class long, s long, rarity long, pos long"), "rare")
    mark = F.xxhash64("class")
    groups = rare.groupBy("s").agg(F.min("rarity").alias("rarity"), F.count("*").alias("full"), F.bit_xor(mark).alias("m1"), F.bit_xor(F.xxhash64(mark, F.lit(1))).alias("m2")).where("full > 1")
    groups = written(groups.groupBy("full", "m1", "m2").agg(F.min(F.struct("rarity", "s")).alias("first")).select("first.s", "full"), "groups")
    groups = groups.select(F.col("s").alias("bucket"), F.ceil(F.col("full") / BLOCK).alias("parts"))
    found = dealt(rare.select(F.col("s").alias("bucket"), "class", "pos"), groups)
    return found.withColumn("part", F.pmod(F.xxhash64("class", "bucket"), F.col("parts"))).drop("parts")


def dealt(members: DataFrame, facts: DataFrame) -> DataFrame:
    """The join of members with facts on `bucket`, each bucket's members dealt to SALTS tasks. Merged, never broadcast: copies for every
    task are so small in a shuffle that they would pass for a small table."""
    left = members.withColumn("_salt", F.pmod(F.xxhash64("class", F.lit(7)), F.lit(SALTS)))
    return left.join(facts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).hint("merge"), ["bucket", "_salt"]).drop("_salt")


def linked(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("both") * DEN >= F.col("either") * NUM).select("a", "b")


def unconnected(active: DataFrame, labels: DataFrame, join) -> DataFrame:
    """The rows of `active` in buckets of several components, with their component, and the bucket's largest as `main`."""
    named = active.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    per = named.groupBy("bucket", "label").agg(F.count("*").alias("_n"))
    top = per.groupBy("bucket").agg(F.count("*").alias("_labels"), F.max(F.struct(F.col("_n"), F.col("label"))).alias("_top"))
    return join(named, top.where("_labels > 1").select("bucket", F.col("_top.label").alias("main")))


def enough_left(n: str, pos: str, nx: str, px: str):
    """The first shingle in order that two sets share stands at `pos` and `px`; what follows must suffice for the threshold."""
    return (F.least(F.col(n) - F.col(pos), F.col(nx) - F.col(px)) + 1) * (NUM + DEN) >= (F.col(n) + F.col(nx)) * NUM


def near_size(x: str, y: str):
    """Sets whose sizes differ too much cannot reach the threshold."""
    return F.least(x, y) * DEN >= F.greatest(x, y) * NUM


def near_rows(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, mark (a hash of the text as it is), n_shingles, component_id for each row."""
    with Scope() as scope:
        text = F.col("text").cast("string")
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
        seen = written(source.mapInArrow(lambda it: sketch_batches(it, bands, rows), "doc_id long, mark long, n_shingles long, digest binary, bands array<long>"), "sketches")
        classes = seen.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("mark"))).alias("one"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"))
        classes = classes.select("digest", "one.doc_id", "one.mark", "n", "bands")
        classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
        labels = class_labels(source, classes, bands * rows)
        ends = classes.select("class", "digest", "doc_id").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("label", F.coalesce("label", "class"))
        ends = written(ends, "ends")
        least = ends.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        ends = ends.join(least, "label").select("digest", "label", "component_id")
        rows_of = seen.select("doc_id", "mark", "n_shingles", "digest")
        found = rows_of.where("n_shingles > 0").join(ends, "digest").select("doc_id", "mark", "n_shingles", "label", "component_id")
        alone = rows_of.where("n_shingles = 0").select("doc_id", "mark", "n_shingles", F.lit(None).cast("long").alias("label"), F.col("doc_id").alias("component_id"))
        return scope.stay(written(found.union(alone), "components"))


def class_labels(source: DataFrame, classes: DataFrame, t: int) -> DataFrame:
    """(node, label): the component of each class that has links."""
    buckets = classes.select("class", "n", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("full")).where("full > 1")
    active = written(buckets.join(shared, "bucket"), "buckets")
    fullness = active.groupBy("class").agg(F.sum("full").alias("score"))
    active = written(active.drop("full").join(fullness, "class"), "scored")
    # Full sets, of classes in shared buckets only, each from one row's text.
    wanted = written(active.select("class").distinct().join(classes.select("class", "doc_id", "mark", "digest"), "class"), "wanted")
    ones = wanted.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_m"))
    texts = source.join(ones, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_m")), "left_semi").select("text")
    sets = texts.mapInArrow(lambda it: set_batches(it, t), "digest binary, shingles array<long>, sketch array<short>").join(wanted.select("class", "digest"), "digest")
    sets = written(sets.dropDuplicates(["digest"]).select("class", "shingles", "sketch"), "sets")
    # Each class against its hub.
    top = F.max(F.struct(F.col("score"), (-F.col("class")).alias("least"))).alias("top")
    mates = active.join(active.groupBy("bucket").agg(top), "bucket").groupBy("class").agg(F.max("top").alias("top")).select((-F.col("top.least")).alias("hub"), "class")
    hubs = written(mates, "hubs")
    near = written(compared(hubs.where("hub <> class").select(F.least("hub", "class").alias("a"), F.greatest("hub", "class").alias("b")).distinct(), sets), "near")
    checked = near.select("a", "b")
    far = near.select("a", "b", (1 - F.col("both") / F.col("either")).alias("far"))
    hubs = hubs.withColumn("a", F.least("hub", "class")).withColumn("b", F.greatest("hub", "class")).join(far, ["a", "b"], "left").select("class", "hub", F.coalesce("far", F.lit(0.0)).alias("far"))
    facts = written(active.select("class", "n").distinct().join(hubs, "class"), "facts")
    labels = components(linked(near))
    left = written(unconnected(active.select("bucket", "class"), labels, lambda x, y: x.join(y, "bucket")).select("class").distinct(), "left")
    active = written(by_rare_shingles(left, sets).join(facts, "class"), "active")
    many = 1
    while True:
        named = written(unconnected(active, labels, dealt), "open")
        if named.isEmpty():
            break
        now = (F.col("part") < many) & (F.col("label") != F.col("main"))
        tried = named.where(now).select("bucket", F.col("class").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("hub").alias("hx"), F.col("far").alias("fx"))
        reach = (F.col("hub") != F.col("hx")) | (F.abs(F.col("far") - F.col("fx")) <= 1 - NUM / DEN + 1e-9)
        pairs = dealt(named.select("bucket", "class", "label", "n", "pos", "hub", "far"), tried).where((F.col("label") != F.col("lx")) & near_size("n", "nx") & enough_left("n", "pos", "nx", "px") & reach).select(F.least("x", "class").alias("a"), F.greatest("x", "class").alias("b")).distinct()
        pairs = written(pairs.join(checked, ["a", "b"], "left_anti"), "pairs")
        close = written(likely(pairs, sets, t), "likely")
        found = written(linked(compared(close, of_pairs(close, sets))), "links")
        checked = checked.union(pairs)
        if not found.isEmpty():
            labels = merged(labels, found)
        active = named.where(~now).drop("label", "main")
        many = 2 * many + 1
    return labels


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    return near_rows(docs, bands, rows).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def row_key(doc_id: Column, mark: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), mark.cast("string"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest id (null ids last, then by a hash of the text), with all its columns. Rows
    without words stay, each once if id and text are repeated."""
    found = near_rows(docs)
    nobody = F.col("n_shingles") == 0
    best = found.where(~nobody).groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("mark"))).alias("b"))
    keys = best.select(row_key(F.col("b.doc_id"), F.col("b.mark")).alias("key")).union(found.where(nobody).select(row_key(F.col("doc_id"), F.col("mark")).alias("key")))
    return only(docs, row_key(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))), keys)
