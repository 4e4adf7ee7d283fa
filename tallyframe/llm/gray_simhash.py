"""SimHash near-duplicates through a Gray-order hierarchical index.

A fingerprint's bit is set if it is set in over half the hashes of the text's shingles. The distinct fingerprints are sorted by Gray
rank, so that neighbours share long bit patterns, and cut into leaves of equal size. A node of the index holds the bits that all below it
have in common: a mask of the places and their value; FANOUT neighbours make one node of the level above. Two nodes whose patterns
already differ in more than DISTANCE of the places that both fix cannot hold a near pair, so the whole product of the groups is pruned.
Pairs of nodes are taken down from the root level by level, as joins with the children of both; the patterns' differences are all that a
row needs. What is left are pairs of leaves; their tasks go on with the same index inside (groups of 4096, 256, 16 and one), a whole array
of node pairs at once. The work is then about that of the trie of the fingerprints: N times the ways to differ in DISTANCE of log2 N bits.

A task hands on a spanning forest of the links it found, no more edges than its two leaves have members, and skips groups that it has
joined already: a group of thousands of near copies does not become all its pairs. Components of the forests are the result; they lose no
link, since two fingerprints are compared unless a pattern excludes them or they are connected.

Rows: null and empty texts have fingerprint zero and are linked like any other. Equal rows count each; rows without an id join their
component but cannot name it, so component_id is null if no row of it has an id. Very long texts are read whole, in pieces of CHUNK
shingles. Other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._base import Scope, components, ranked, settle, written
from tallyframe.llm.fast_minhash import words_of

SHINGLE, SEED, DISTANCE = 4, 42, 4
FANOUT, CHUNK = 16, 50_000
#: Members of a leaf: as many as make about LEAVES leaves, within these bounds.
LEAVES, LEAST_LEAF, MOST_LEAF = 32, 1024, 1 << 16
SALTS = 8


def fingerprint(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a sequence of words; zero without words."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        h = np.array([digest(joined[a:b], seed) for a, b in spans], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    settle()
    for batch in batches:
        found = np.fromiter((fingerprint(words_of(text.as_py()), shingle, seed) for text in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.record_batch([batch.column(0), found.view(np.int64)], names=["doc_id", "fp"])


def gray_rank(fp: Column) -> Column:
    """The place of a fingerprint in Gray order as an unsigned number, moved so that signed order is its order."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def from_rank(rank: np.ndarray) -> np.ndarray:
    """The fingerprints of ranks as gray_rank gives them."""
    r = rank.view(np.uint64) ^ np.uint64(1 << 63)
    return r ^ (r >> np.uint64(1))


class Leaf:
    """A leaf's fingerprints in Gray order with the patterns of its groups: levels[0] is single ones, levels[k] groups of FANOUT**k."""

    def __init__(self, ranks: np.ndarray):
        self.fp = from_rank(ranks)
        self.levels = [(np.full(len(self.fp), ~np.uint64(0)), self.fp)]
        size = FANOUT
        while size < FANOUT * len(self.fp):
            at = np.arange(0, len(self.fp), size)
            every, some = np.bitwise_and.reduceat(self.fp, at), np.bitwise_or.reduceat(self.fp, at)
            self.levels.append((~(every ^ some), every))
            size *= FANOUT


def joined_labels(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """`label` (each member's least known mate) after links between members u and v."""
    while True:
        a, b = label[u], label[v]
        new = a != b
        if not new.any():
            return label
        u, v, a, b = u[new], v[new], a[new], b[new]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]


def forest(ranks_a: np.ndarray, ranks_b: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links within `distance` between the two leaves connect (within one leaf, if there is no second)."""
    one, a = ranks_b is None, Leaf(ranks_a)
    b = a if one else Leaf(ranks_b)
    shift = 0 if one else len(a.fp)
    fp = a.fp if one else np.concatenate([a.fp, b.fp])
    state = {"label": np.arange(len(fp))}
    step = np.arange(FANOUT)

    def met(i: np.ndarray, j: np.ndarray) -> None:
        state["label"] = joined_labels(state["label"], i, j + shift)

    def open_groups(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether two groups of the lowest level are not yet of one component."""
        label = state["label"]
        at = np.arange(0, len(a.fp), FANOUT)
        low_a, high_a = np.minimum.reduceat(label[: len(a.fp)], at), np.maximum.reduceat(label[: len(a.fp)], at)
        at = np.arange(0, len(b.fp), FANOUT)
        low_b, high_b = np.minimum.reduceat(label[shift:], at), np.maximum.reduceat(label[shift:], at)
        return np.minimum(low_a[i], low_b[j]) != np.maximum(high_a[i], high_b[j])

    def descend(la: int, lb: int, i: np.ndarray, j: np.ndarray) -> None:
        """Node pairs (i, j) of levels la, lb that are not pruned: their children, a bounded number at once."""
        if la == lb == 0:
            met(i, j)
            return
        for at in range(0, len(i), 4096):
            p, q = i[at : at + 4096], j[at : at + 4096]
            if max(la, lb) == 1:
                still = open_groups(p if la else p // FANOUT, q if lb else q // FANOUT)
                p, q = p[still], q[still]
            x = (p[:, None] * FANOUT + step)[:, :, None] if la == max(la, lb) else p[:, None, None]
            y = (q[:, None] * FANOUT + step)[:, None, :] if lb == max(la, lb) else q[:, None, None]
            na, nb = (la - 1 if la == max(la, lb) else la), (lb - 1 if lb == max(la, lb) else lb)
            (mask_a, value_a), (mask_b, value_b) = a.levels[na], b.levels[nb]
            cx, cy = np.minimum(x, len(value_a) - 1), np.minimum(y, len(value_b) - 1)
            apart = value_a[cx] ^ value_b[cy]
            if na or nb:
                apart &= mask_a[cx] & mask_b[cy]
            near = np.bitwise_count(apart) <= distance
            near &= (x < len(value_a)) & (y < len(value_b))
            if one and na == nb:
                near &= (x < y) if na == 0 else (x <= y)
            k, s, t = np.nonzero(near)
            descend(na, nb, x[k, s if x.shape[1] > 1 else 0, 0], y[k, 0, t if y.shape[2] > 1 else 0])

    top_a, top_b = len(a.levels) - 1, len(b.levels) - 1
    if len(fp):
        descend(top_a, top_b, np.zeros(1, np.int64), np.zeros(1, np.int64))
    label = state["label"]
    moved = np.nonzero(label != np.arange(len(label)))[0]
    return fp[moved].view(np.int64), fp[label[moved]].view(np.int64)


def forest_batches(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Edges of each pair of leaves (ra, rb); rb is null where a leaf meets itself."""
    settle()
    for batch in batches:
        for ra, rb in zip(batch.column(0), batch.column(1), strict=True):
            x, y = forest(ra.values.to_numpy(), rb.values.to_numpy() if rb.is_valid else None, distance)
            yield pa.record_batch([x, y], names=["a", "b"])


def leaf_pairs(leaves: DataFrame, count: int, distance: int) -> DataFrame:
    """(a, b), a <= b: the leaves (leaf, mask, value), numbered below `count`, whose patterns do not exclude a near pair.

    The levels above are aggregates of the leaves' patterns; from the root on, each pair meets the children of both."""
    level = leaves.select(F.col("leaf").alias("node"), "mask", "value")
    levels = [level]
    while count > FANOUT:
        count = -(-count // FANOUT)
        up = levels[-1].groupBy(F.floor(F.col("node") / FANOUT).alias("node")).agg(F.bit_and("value").alias("every"), F.bit_or("value").alias("some"), F.bit_and("mask").alias("fixed"))
        levels.append(written(up.select("node", F.expr("fixed & ~(every ^ some)").alias("mask"), F.col("every").alias("value")), "gray-level"))
    pairs = leaves.sparkSession.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    for level in reversed(levels):
        kids = level.withColumn("up", F.lit(0).cast("long") if level is levels[-1] else F.floor(F.col("node") / FANOUT))
        left = kids.select(F.col("up").alias("a"), F.col("node").alias("ca"), F.col("mask").alias("ma"), F.col("value").alias("va"))
        right = kids.select(F.col("up").alias("b"), F.col("node").alias("cb"), F.col("mask").alias("mb"), F.col("value").alias("vb"))
        found = pairs.join(left, "a").join(right, "b").where((F.col("ca") <= F.col("cb")) & (F.expr("bit_count((va ^ vb) & ma & mb)") <= distance))
        pairs = written(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")), "gray-pairs")
    return pairs


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): edges that connect the distinct fingerprints `fp` (long) of `prints` just as their links within `distance` do."""
    spark = prints.sparkSession
    total = prints.count()
    size = min(MOST_LEAF, max(LEAST_LEAF, 1 << (max(1, total) // LEAVES).bit_length()))
    count = -(-total // size)
    if not total:
        return spark.createDataFrame([], "a long, b long")
    placed, place = ranked(prints.select("fp", gray_rank(F.col("fp")).alias("rank")), ["rank"], "gray")
    leaves = placed.groupBy(F.floor(F.col(place) / size).alias("leaf")).agg(
        F.array_sort(F.collect_list("rank")).alias("ranks"), F.expr("~(bit_and(fp) ^ bit_or(fp))").alias("mask"), F.expr("bit_and(fp)").alias("value"))
    leaves = written(leaves, "leaves")
    pairs = leaf_pairs(leaves, count, distance)
    # Each pair is dealt by its second leaf and the first one's number, so that no leaf's pairs are one task's.
    tasks = min(4096, max(64, SALTS * count))
    first = leaves.select(F.col("leaf").alias("a"), F.col("ranks").alias("ra"))
    second = leaves.select(F.col("leaf").alias("b"), F.col("ranks").alias("rb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    held = pairs.join(first, "a").withColumn("salt", F.pmod("a", F.lit(SALTS)))
    both = held.repartition(tasks, "b", "salt").join(second.repartition(tasks, "b", "salt").hint("merge"), ["b", "salt"])
    both = both.select("ra", F.when(F.col("a") != F.col("b"), F.col("rb")).alias("rb"))
    return written(both.mapInArrow(lambda it: forest_batches(it, distance), "a long, b long"), "forest")


def near_rows(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (long), component_id for each row."""
    with Scope() as scope:
        source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        seen = written(source.mapInArrow(lambda it: fingerprint_batches(it, shingle, seed), "doc_id long, fp long"), "fingerprints")
        prints = written(seen.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "prints")
        labels = components(links(prints, distance), "gray-cc").select(F.col("node").alias("fp"), "label")
        named = written(prints.join(labels, "fp", "left").select("fp", "n", "first", F.coalesce("label", "fp").alias("label")), "named")
        least = named.groupBy("label").agg(F.min("first").alias("component_id"))
        named = written(named.join(least, "label").select("fp", "n", "component_id"), "least")
        # A fingerprint of a hundredth of the rows is one of a hundred at most: these are broadcast, the others shuffled.
        rows = named.agg(F.sum("n")).first()[0] or 0
        hot = F.col("n") * 100 > rows
        heavy = F.broadcast(named.where(hot).select("fp", F.col("component_id").alias("_heavy"), F.lit(True).alias("_hot")))
        marked = seen.join(heavy, "fp", "left")
        light = marked.where("_hot is null").select("doc_id", "fp").join(named.where(~hot).select("fp", "component_id"), "fp")
        found = light.select("doc_id", "fp", "component_id").union(marked.where("_hot").select("doc_id", "fp", F.col("_heavy").alias("component_id")))
        return scope.stay(written(found, "gray-components"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for each row."""
    found = near_rows(docs, shingle, distance)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
