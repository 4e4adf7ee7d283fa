"""Document fingerprints from statistically improbable features (after Roussev, "Data fingerprinting with similarity digests").

Every window of WIDTH bytes has an entropy, in thousandths of its maximum. Over the whole corpus the entropies are counted; the rarer
an entropy, the better the rank of its windows. Each run of RUN neighbouring windows votes for its best-ranked one (the first, if
several), and windows with VOTES votes are the document's features. Their hashes fill a chain of Bloom filters of BITS bits, FULL
features in each. Two chains are compared filter by filter: shared bits beyond what chance would share, as a part of the most that could
be shared; each filter of the shorter chain counts with its best partner.

Windows of hardly any entropy (under LEAST) are passed over; a text in which no window has VOTES votes has its most voted ones, and its
first if none has any. Texts shorter than a window are filled up with zero bytes to one. Texts of all lengths so have features of one
kind. An empty text has an empty fingerprint, and only equal fingerprints are alike then.

Nulls: a null text is empty; null ids come last in the order of ids. Rows with equal ids are ordered by a hash of their texts. The
document after the last is the first, and a lone document is its own neighbour. Repeated rows are rows of their own; empty tables give
empty results; other columns are not read.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._base import mix64

WIDTH, RUN, VOTES, LEAST, SCALE = 16, 16, 4, 100, 1000
BITS, HASHES, FULL, CUTOFF = 2048, 5, 160, 0.1
#: Bytes of text whose windows are computed together, and windows that one lane passes over.
TOGETHER, LANE = 1_500_000, 384
#: Bytes of text in a block of rows that are neighbours in the order of ids. There are as many tasks as blocks, and some have a few.
PER_BLOCK = 8_000_000

def entropies(flat: np.ndarray, width: int = 64) -> np.ndarray:
    """Of each window of `width` bytes the entropy, 0 to SCALE. Lanes of windows advance together, each keeping its bytes' counts."""
    n = len(flat) - width + 1
    if n <= 0:
        return np.zeros(0, np.int16)
    # The sum of c * log2(c) over bytes' counts c, in 4096ths, and what it changes by as a count falls or rises.
    terms = np.array([0] + [round(c * np.log2(c) * 4096) for c in range(1, width + 1)], dtype=np.int32)
    less, more, top = np.concatenate([[0], terms[:-1] - terms[1:]]).astype(np.int32), np.concatenate([terms[1:] - terms[:-1], [0]]).astype(np.int32), terms[width]
    lanes = -(-n // LANE)
    text = np.zeros(lanes * LANE + width, np.uint8)
    text[: len(flat)] = flat
    # Column j holds byte j of every lane.
    lane = np.lib.stride_tricks.as_strided(text, (lanes, LANE + width - 1), (LANE, 1)).T.copy()
    base = np.arange(lanes, dtype=np.int32) * 256
    counts = np.zeros(lanes * 256, np.uint8)
    total = np.zeros(lanes, np.int32)
    out = np.empty((LANE, lanes), np.int32)

    def add(column: np.ndarray) -> None:
        at = base + column
        c = counts[at]
        np.add(total, more[c], out=total)
        counts[at] = c + 1

    for j in range(width):
        add(lane[j])
    out[0] = total
    for j in range(1, LANE):
        at = base + lane[j - 1]
        c = counts[at]
        np.add(total, less[c], out=total)
        counts[at] = c - 1
        add(lane[j + width - 1])
        out[j] = total
    return ((top - out.T.reshape(-1)[:n]) * SCALE // top).astype(np.int16)


def filled(text: str) -> bytes:
    """Its bytes, at least a window of them if there are any."""
    return text.encode().ljust(WIDTH, b"\0") if text else b""


def gather(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts to compute together."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > TOGETHER:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, where each text begins, and for each window within one text its entropy; -1 for others."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    e = np.full(len(flat), -1, np.int16)
    found = entropies(flat, WIDTH)
    e[: len(found)] = found
    for end in starts[1:]:
        e[max(0, end - WIDTH + 1) : end] = -1
    return flat, starts, e


def count_entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SCALE + 1, np.int64)
    for batch in batches:
        texts = [filled(t.as_py() or "") for t in batch.column(0)]
        for a, b in gather(texts):
            e = windows(texts[a:b])[2]
            total += np.bincount(e[e >= 0], minlength=SCALE + 1)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["entropy", "n"])


def ranks(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy over all windows of all texts: the fewer windows have it, the lower. SCALE + 1 numbers."""
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count_entropies, "entropy int, n long").groupBy("entropy").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(SCALE + 1, np.int64)
    for r in counts:
        n[r["entropy"]] = r["n"]
    rank = np.empty(SCALE + 1, np.int32)
    rank[np.lexsort((np.arange(SCALE + 1), n))] = np.arange(SCALE + 1)
    return rank


def in_order(hashes: np.ndarray) -> np.ndarray:
    """Distinct ones, each where it comes first."""
    _, first = np.unique(hashes, return_index=True)
    return hashes[np.sort(first)]


def hashed(found: np.ndarray) -> np.ndarray:
    """Hashes of windows, a row of bytes each."""
    words = found.copy().view(np.uint64)
    h = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        h = mix64(h ^ words[:, k])
    return h


def feature_hashes(originals: list[str], rank: np.ndarray) -> list[np.ndarray]:
    """The hashes of each text's distinct features, in order."""
    out: list[np.ndarray] = []
    texts = list(map(filled, originals))
    for a, b in gather(texts):
        flat, starts, e = windows(texts[a:b])
        worst = np.int32(SCALE + 1)
        key = np.where(e >= LEAST, rank[np.maximum(e, 0)], worst)
        # The least (rank, position) of every run, by doubling; runs beyond a text's end meet only windows that don't count.
        least = np.concatenate([key.astype(np.int64) << 32 | np.arange(len(key)), np.full(RUN, int(worst) << 32)])
        step = 1
        while step < RUN:
            least[:-step] = np.minimum(least[:-step], least[step:])
            step *= 2
        voters = least[: len(key)][e >= 0]
        voters = voters[voters >> 32 < worst] & 0xFFFFFFFF
        votes = np.bincount(voters, minlength=len(key))
        chosen = np.flatnonzero(votes >= VOTES)
        bounds = np.searchsorted(chosen, starts)
        wide = np.lib.stride_tricks.sliding_window_view(flat, WIDTH) if len(flat) >= WIDTH else np.zeros((0, WIDTH), np.uint8)
        h = hashed(wide[chosen])
        for i in range(b - a):
            own = h[bounds[i] : bounds[i + 1]]
            if texts[a + i] and not len(own):
                most = votes[starts[i] : starts[i + 1]]
                own = hashed(wide[starts[i] + (np.flatnonzero(most == most.max()) if most.max() else np.zeros(1, np.int64))])
            out.append(in_order(own))
    return out


def chain(features: np.ndarray) -> np.ndarray:
    """Bloom filters, a row of bytes each."""
    n = -(-len(features) // FULL)
    bits = np.zeros((n, BITS), np.uint8)
    owner = np.arange(len(features)) // FULL
    for k in range(HASHES):
        bits[owner, (features >> np.uint64(11 * k)) & np.uint64(BITS - 1)] = 1
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return float(len(b) == 0)
    x, y = a.view(np.uint64), b.view(np.uint64)
    px, py = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    total = 0.0
    for i in range(len(x)):
        shared = np.bitwise_count(x[i] & y).sum(axis=1, dtype=np.int64)
        most = np.minimum(px[i], py)
        floor = px[i] * py / BITS
        floor = floor + CUTOFF * (most - floor)
        total += max(0.0, float(((shared - floor) / np.maximum(most - floor, 1e-9)).max()))
    return min(1.0, total / len(x))


def written_out(filters: np.ndarray) -> str:
    return f"{len(filters)}:{base64.b64encode(filters.tobytes()).decode()}" if len(filters) else ""


def edited(text: str, following: str) -> str:
    """The last third replaced by as many of the first code points of the next text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def in_blocks(docs: DataFrame) -> DataFrame:
    """block, extra, down, tie, doc_id, text: each block's rows are neighbours in the order of (down, tie), which is that of falling ids;
    the row after its last one follows it as `extra`.

    The blocks' borders are quantiles of that order, one pair of numbers a block, found by range-partitioning the pairs alone; so ids may
    lie anywhere, and many rows may share one."""
    order = F.bitwise_not(F.coalesce("doc_id", F.lit(-(2**63))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("down", order).withColumn("tie", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 100)).first()[0] or 0
    wanted = max(1, -(-size // PER_BLOCK))
    firsts = rows.select("down", "tie").repartitionByRange(wanted, "down", "tie").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("down", "tie")).alias("first")).collect()
    borders = sorted((r["first"]["down"], r["first"]["tie"]) for r in firsts)

    @F.pandas_udf("array<int>")
    def places(down: pd.Series, tie: pd.Series) -> pd.Series:
        """The row's block; if it is a block's first, also the block before, as -1 - its number."""
        out = []
        for key in zip(down.tolist(), tie.tolist(), strict=True):
            block = bisect_right(borders, key) - 1
            out.append([block, -1 - (block - 1) % len(borders)] if key == borders[block] else [block])
        return pd.Series(out)

    rows = rows.withColumn("to", F.explode(places("down", "tie")))
    to = F.col("to")
    return rows.select(F.when(to < 0, -1 - to).otherwise(to).alias("block"), (to < 0).alias("extra"), "down", "tie", "doc_id", "text").repartition(max(1, len(borders)), "block")


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_text", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def fingerprint_rows(batches: Iterator[pa.RecordBatch], rank: np.ndarray, keep_text: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block, order and `extra`; each row but an extra one is paired with the next row of its block."""
    import hashlib

    held: list[tuple] = []

    def work(rows: list[tuple]) -> pa.RecordBatch:
        pairs = [(i, i + 1) for i in range(len(rows) - 1) if not rows[i][3]]
        prints = [chain(f) for f in feature_hashes([r[1] for r in rows], rank)]
        changed = [edited(rows[i][1], rows[j][1]) for i, j in pairs]
        others = [chain(f) for f in feature_hashes(changed, rank)]
        last = changed if keep_text else [hashlib.sha256(c.encode()).hexdigest() for c in changed]
        return pa.record_batch([[rows[i][0] for i, _ in pairs], [len(rows[i][1]) for i, _ in pairs], last, [written_out(prints[i]) for i, _ in pairs], [written_out(o) for o in others], [likeness(prints[i], o) for (i, _), o in zip(pairs, others, strict=True)], [likeness(prints[i], prints[j]) for i, j in pairs]], schema=OUT)

    size = 0
    for batch in batches:
        for doc_id, text, block, extra in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if extra and held and held[-1][3] and held[-1][2] == block:
                continue  # several rows share the highest id: the first follows
            held.append((doc_id, text.as_py() or "", block, extra))
            size += len(held[-1][1])
            if size > TOGETHER and len(held) > 1:
                yield work(held)
                held, size = held[-1:], len(held[-1][1])
    if held:
        yield work(held)


def fingerprints(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_chars, edited_text (its SHA-256 unless keep_text), fingerprint, edited_fingerprint, near_edited, near_next."""
    rank = ranks(docs)
    rows = in_blocks(docs).sortWithinPartitions("block", "extra", "down", "tie").select("doc_id", "text", "block", "extra")
    return rows.mapInArrow(lambda it: fingerprint_rows(it, rank, keep_text), "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
