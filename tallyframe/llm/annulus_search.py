"""Hard negatives by inner product, through one-dimensional distance keys.

One coordinate is added to each vector, so that all have the norm M of the longest; an anchor's is zero. The distance of an anchor q to an
augmented vector x then orders vectors by inner product: |q - x|^2 = |q|^2 + M^2 - 2 q.x. A vector's key is its nearest pivot and its
distance from that pivot. Rows are stored in that order: a cell is one ring of keys of one pivot, dealt into blocks of at most a few
thousand rows, sorted by distance within. By the triangle inequality a row with key (p, r) is no nearer to q than |d(q, p) - r| and no
farther than d(q, p) + r, so a ring of keys bounds the scores of all its rows.

A search has windows: scores from `low` to `high`, of the anchor's own label or of other labels, the best k. Its intervals of keys expand
in rounds over annuli of growing lower bound, each reaching SHARES of the rows; cells whose bounds miss the window, or fall short of
the k best found so far, are left out, and a search ends when that holds for all that remain. What remains is certified, not guessed:
results are exact. Bounds are computed in doubles and loosened by SLACK; scores are exact integers (in doubles up to 2**53, beyond
that in Python's integers, then held within a long).

The pivots come from k-means over the SAMPLE rows at most whose hashes are lowest; they only steer the search. The directory of cells
(CELLS at most, a few numbers each) is all that tasks get whole. Anchors travel in packs of PACK, to the blocks that they want.

Rows: those with a null label, id or vector, or a null component, take no part. Shorter vectors count as ending in zeros; an empty one
scores zero with all. Each row is its own, also where an id is repeated: an anchor's positives may hold its repetition, and a repeated
anchor has its results again. Ties go to the smaller id. Other columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm._base import Scope, settle, written

POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
SAMPLE, PIVOTS, RINGS, CELLS = 2048, 256, 16, 4096
BLOCK, PACK = 1024, 32
SHARES = (0.125, 0.5, 1.0)
SLACK = 1e-6
LONG = 2**63 - 1
EXACT = 2.0**53


def matrix(rows, width: int) -> np.ndarray:
    """Rows of integers, zeros behind the shorter ones."""
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def stacked(column: pa.Array, width: int) -> np.ndarray:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    flat = flat[ends[0] : ends[-1]]
    if len(flat) == width * len(column) and (np.diff(ends) == width).all():
        return flat.reshape(len(column), width)
    return matrix([flat[a - ends[0] : b - ends[0]] for a, b in zip(ends[:-1], ends[1:], strict=True)], width)


class Index:
    """What every task knows: pivots in the augmented space, the common norm, the rings' widths, and later the directory of cells."""

    def __init__(self, pivots: np.ndarray, norm2: float, width: int):
        self.pivots, self.norm2, self.width = pivots, norm2, width
        self.low = self.step = None
        self.cells: np.ndarray = np.zeros((0, 5))

    def distances(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """From each row (with its added coordinate) to each pivot."""
        wide = np.hstack([x.astype(float), extra[:, None]])
        d2 = (wide**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None] - 2 * wide @ self.pivots.T
        return np.sqrt(np.maximum(d2, 0))

    def added(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm2 - (x.astype(float) ** 2).sum(axis=1), 0))


def means(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means from evenly spread starts."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        d2 = (centres**2).sum(axis=1)[None] - 2 * points @ centres.T
        near = d2.argmin(axis=1)
        for c in np.unique(near):
            centres[c] = points[near == c].mean(axis=0)
    return centres


def tasks_for(total: int) -> int:
    """Tasks that rows are dealt to: more with more rows."""
    return max(16, total // (4 * BLOCK))


def scores_of(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: doubles if no partial sum can leave their integers, else Python's integers."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * q.shape[1]
    if most < EXACT:
        return q.astype(float) @ x.astype(float).T
    exact = q.astype(object) @ x.astype(object).T
    return np.vectorize(lambda s: max(-LONG, min(LONG, int(s))), otypes=[object])(exact) if exact.size else exact


def key_batches(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """Adds (pivot, dist) to rows (row, id, label, vector)."""
    settle()
    for batch in batches:
        x = stacked(batch.column(3), index.width)
        d = index.distances(x, index.added(x))
        pivot = d.argmin(axis=1)
        yield pa.record_batch([*batch.columns, pa.array(pivot.astype(np.int32)), pa.array(d[np.arange(len(x)), pivot])], names=["row", "id", "label", "vector", "pivot", "dist"])


BLOCKS = "cell int, part int, rows binary, ids binary, labels binary, vectors binary, n int"


def block_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """One row for each (cell, part) of rows sorted by them."""
    settle()
    held: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        x = stacked(table.column("vector").combine_chunks(), width)
        as_bytes = lambda name: pa.array([table.column(name).to_numpy().astype(np.int64).tobytes()], pa.binary())
        out = pa.record_batch([table.column("cell")[:1].combine_chunks(), table.column("part")[:1].combine_chunks(), as_bytes("row"), as_bytes("id"), as_bytes("label"), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()), pa.array([len(x)], pa.int32())], names=["cell", "part", "rows", "ids", "labels", "vectors", "n"])
        held.clear()
        return out

    for batch in batches:
        cell, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.nonzero(np.diff(cell) | np.diff(part))[0] + 1 if len(cell) else []
        if held and len(cell) and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (cell[0], part[0]):
            yield flush()
        for nth, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(cell)], strict=True)):
            if nth:
                yield flush()
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield flush()


def stored(rows: DataFrame, index: Index, total: int) -> DataFrame:
    """The blocks of `rows` (row, id, label, vector), written in key order; fills in the index's directory."""
    spark, kept = rows.sparkSession, index
    keyed = written(rows.mapInArrow(lambda it: key_batches(it, kept), "row long, id long, label long, vector array<long>, pivot int, dist double"), "keyed")
    k = len(index.pivots)
    spread = keyed.groupBy("pivot").agg(F.min("dist"), F.max("dist")).collect()  # one row a pivot
    low, high = np.zeros(k), np.zeros(k)
    for pivot, a, b in spread:
        low[pivot], high[pivot] = a, b
    index.low, index.step = low, np.maximum((high - low) / RINGS, 1e-9)
    facts = spark.createDataFrame([(p, float(low[p]), float(index.step[p])) for p in range(k)], "pivot int, _low double, _step double")
    ringed = keyed.join(F.broadcast(facts), "pivot").withColumn("cell", (F.col("pivot") * RINGS + F.least(F.lit(RINGS - 1), F.floor((F.col("dist") - F.col("_low")) / F.col("_step")))).cast("int"))
    cells = ringed.groupBy("cell").agg(F.count("*").alias("n"), F.min("dist").alias("a"), F.max("dist").alias("b")).collect()  # CELLS at most
    # cell, least and greatest distance, rows, parts
    size = max(16, min(BLOCK, (1 << 20) // max(1, index.width)))
    index.cells = np.array([(c, a, b, n, -(-n // size)) for c, n, a, b in cells]).reshape(-1, 5)
    parts = spark.createDataFrame([(int(c[0]), int(c[4])) for c in index.cells], "cell int, _parts int")
    dealt = ringed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id", "row"), F.col("_parts")).cast("int"))
    dealt = dealt.select("cell", "part", "row", "id", "label", "vector", "dist")
    ordered = dealt.repartition(tasks_for(total), "cell", "part").sortWithinPartitions("cell", "part", "dist", "id").drop("dist")
    return written(ordered.mapInArrow(lambda it: block_batches(it, kept.width), BLOCKS), "blocks")


#: A window: own label (1) or others (0), scores from low to high, the best k. `best` has (window, score, id, row) found so far.
WINDOWS = "array<struct<own:int,low:long,high:long,k:int>>"
BEST = "array<struct<window:int,score:long,id:long,row:long>>"
ASKED = f"row long, id long, label long, vector array<long>, windows {WINDOWS}"


def wanted(q: np.ndarray, windows: list[list[dict]], best: list[list[dict]], index: Index, nth: int) -> np.ndarray:
    """Which cells (columns) each anchor visits in round `nth`."""
    x = q.astype(float)
    q2 = (x**2).sum(axis=1)
    cell, a, b, n, _ = index.cells.T
    pivot = cell.astype(int) // RINGS
    d = index.distances(q, np.zeros(len(q)))[:, pivot]
    scale = SLACK * (1 + np.sqrt(q2)[:, None] + np.sqrt(index.norm2))
    near = np.maximum(np.maximum(d - b, a - d), 0) - scale
    far = d + b + scale
    # Scores of a cell's rows lie between these.
    loose = SLACK * (1 + q2[:, None] + index.norm2)
    top = (q2[:, None] + index.norm2 - np.maximum(near, 0) ** 2) / 2 + loose
    bottom = (q2[:, None] + index.norm2 - far**2) / 2 - loose
    out = np.zeros((len(q), len(cell)), bool)
    for i, asked in enumerate(windows):
        for w, window in enumerate(asked):
            have = sorted((r["score"] for r in best[i] if r["window"] == w), reverse=True)
            short = have[window["k"] - 1] if len(have) >= window["k"] else -np.inf
            fits = (top[i] >= window["low"]) & (bottom[i] <= window["high"])
            # Annuli in order of what they could still give: the rounds' shares of the rows among those that fit.
            order = np.argsort(-np.minimum(top[i], window["high"]), kind="stable")
            order = order[fits[order]]
            share = np.cumsum(n[order]) - n[order]
            upto, since = SHARES[nth] * n[order].sum(), SHARES[nth - 1] * n[order].sum() if nth else 0
            now = order[(share < upto) & (share >= since)]
            out[i, now[np.minimum(top[i, now], window["high"]) >= short]] = True
    return out


def visit_batches(batches: Iterator[pa.RecordBatch], index: Index, nth: int) -> Iterator[pa.RecordBatch]:
    """A pack of anchors for each block that some of them want: (cell, part, anchors as Arrow bytes)."""
    settle()
    for batch in batches:
        for at in range(0, batch.num_rows, PACK):
            pack = batch.slice(at, PACK)
            table = pack.to_pydict()
            hits = wanted(stacked(pack.column(3), index.width), table["windows"], [b or [] for b in table["best"]], index, nth)
            for c in np.nonzero(hits.any(axis=0))[0]:
                some = pack.take(pa.array(np.nonzero(hits[:, c])[0]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, some.schema) as writer:
                    writer.write_batch(some)
                raw, parts = sink.getvalue().to_pybytes(), int(index.cells[c, 4])
                yield pa.record_batch([pa.array([int(index.cells[c, 0])] * parts, pa.int32()), pa.array(range(parts), pa.int32()), pa.array([raw] * parts, pa.binary())], names=["cell", "part", "pack"])


FOUND = "anchor long, window int, score long, id long, row long"


def score_batches(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """The best of each block for each window of the anchors that visit it."""
    settle()
    names = [f.split()[0] for f in FOUND.split(", ")]
    for batch in batches:
        for raw, rows, ids, labels, vectors in zip(*(batch.column(k) for k in range(5)), strict=True):
            pack = pa.ipc.open_stream(raw.as_py()).read_all().combine_chunks()
            rows, ids, labels = (np.frombuffer(z.as_py(), np.int64) for z in (rows, ids, labels))
            x = np.frombuffer(vectors.as_py(), np.int64).reshape(len(rows), index.width)
            order = np.lexsort((rows, ids))  # equal scores: the smaller id first
            rows, ids, labels, x = rows[order], ids[order], labels[order], x[order]
            table = pack.select(["row", "label", "windows", "best"]).to_pydict()
            q = stacked(pack.column("vector").combine_chunks(), index.width)
            scores = scores_of(q, x)
            out: list[list[np.ndarray]] = [[] for _ in names]
            for i, asked in enumerate(table["windows"]):
                own = labels == table["label"][i]
                other = rows != table["row"][i]
                s = scores[i]
                for w, window in enumerate(asked):
                    mine = [r for r in table["best"][i] or [] if r["window"] == w]
                    known = sorted((r["score"] for r in mine), reverse=True)
                    least = max(window["low"], known[window["k"] - 1] if len(known) >= window["k"] else -np.inf)
                    at = np.nonzero((own if window["own"] else ~own) & other & (s >= least) & (s <= window["high"]))[0]
                    if mine and len(at):  # a cell may be visited again for another window
                        at = at[~np.isin(rows[at], [r["row"] for r in mine])]
                    if len(at) > window["k"]:
                        at = at[np.argsort(-s[at], kind="stable")[: window["k"]]]
                    if len(at):
                        for column, values in zip(out, (np.full(len(at), table["row"][i]), np.full(len(at), w), s[at].astype(np.int64), ids[at], rows[at]), strict=True):
                            column.append(values)
            if out[0]:
                columns = [np.concatenate(c) for c in out]
                columns[1] = columns[1].astype(np.int32)
                yield pa.record_batch(columns, names=names)


def searched(asked: DataFrame, blocks: DataFrame, index: Index, total: int, most: int) -> DataFrame:
    """`asked` (row, id, label, vector, windows) with `best`: for each window its best rows, `most` at most, found in rounds."""
    state = asked.withColumn("best", F.lit(None).cast(BEST))
    tasks = tasks_for(total)
    for nth in range(len(SHARES)):
        visits = state.mapInArrow(lambda it, nth=nth: visit_batches(it, index, nth), "cell int, part int, pack binary").repartition(tasks, "cell", "part")
        met = visits.join(blocks.repartition(tasks, "cell", "part").hint("merge"), ["cell", "part"]).select("pack", "rows", "ids", "labels", "vectors")
        found = met.mapInArrow(lambda it: score_batches(it, index), FOUND)
        # A block gives k rows a window at most; the best k of all blocks and rounds stay.
        before = state.where("best is not null").select(F.col("row").alias("anchor"), F.explode("best").alias("b")).select("anchor", "b.window", "b.score", "b.id", "b.row")
        limits = state.select(F.col("row").alias("anchor"), F.posexplode("windows").alias("window", "w")).select("anchor", "window", F.col("w.k").alias("k"))
        kept = best_of(found.union(before), most).join(limits, ["anchor", "window"]).where("place <= k")
        best = kept.groupBy("anchor").agg(F.collect_list(F.struct("window", "score", "id", "row")).alias("best"))
        state = written(state.drop("best").join(best.withColumnRenamed("anchor", "row"), "row", "left").select(*asked.columns, F.col("best").cast(BEST).alias("best")), "searched")
    return state


def best_of(found: DataFrame, most: int) -> DataFrame:
    """Each (anchor, window)'s rows with their `place`, the first `most`: partial limits before the shuffle keep it small."""
    ranked = found.withColumn("place", F.expr("row_number() over (partition by anchor, window order by score desc, id, row)"))
    return ranked.where(F.col("place") <= most)


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from `vectors` (vec_id, label, embedding: integers).

    Anchors are the rows where `anchor` holds. Of a positive with score p, negatives have other labels and scores s with
    low * p <= 100 * s <= high * p."""
    spark = vectors.sparkSession
    with Scope() as scope:
        clean = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
        rows = clean.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<long>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("asks"))
        rows = written(rows, "vectors")
        square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        total, norm2, width = rows.agg(F.count("*"), F.max(square), F.max(F.size("vector"))).first()
        if not total:
            return spark.createDataFrame([], T.StructType([T.StructField(n, t) for n, t in (("anchor_id", T.LongType()), ("positive_id", T.LongType()), ("rank", T.IntegerType()), ("negative_id", T.LongType()), ("positive_score", T.LongType()), ("negative_score", T.LongType()))]))
        width = max(1, width)
        sample = matrix([r.vector for r in rows.orderBy(F.xxhash64("id", "row")).limit(max(1, min(SAMPLE, (1 << 21) // width))).select("vector").collect()], width)
        index = Index(np.zeros((0, width + 1)), float(norm2), width)
        k = int(max(4, min(PIVOTS, total**0.5 / 16, len(sample)))) if len(sample) >= 4 else 1
        index.pivots = means(np.hstack([sample.astype(float), index.added(sample)[:, None]]), k)
        own = rows.drop("asks")
        blocks = stored(own, index, total)
        asking = rows.where("asks").select(*own.columns)
        first = F.array(F.struct(F.lit(1).alias("own"), F.lit(-LONG).alias("low"), F.lit(LONG).alias("high"), F.lit(positives).alias("k")))
        near = searched(written(asking.withColumn("windows", first.cast(WINDOWS)), "anchors"), blocks, index, total, positives)
        # Positives in order become the windows of the second search: integers s with low * p <= 100 s <= high * p.
        order = F.array_sort("best", lambda a, b: F.when(a.score > b.score, -1).when(a.score < b.score, 1).when(a.id < b.id, -1).when(a.id > b.id, 1).when(a.row < b.row, -1).when(a.row > b.row, 1).otherwise(0))
        near = written(near.where("best is not null").withColumn("pos", order).drop("best", "windows"), "positives")
        window = lambda p: F.struct(F.lit(0).alias("own"), F.ceil(p.score.cast("decimal(38,0)") * low / 100).cast("long").alias("low"), F.floor(p.score.cast("decimal(38,0)") * high / 100).cast("long").alias("high"), F.lit(negatives).alias("k"))
        asked = near.select(*own.columns, F.transform("pos", window).cast(WINDOWS).alias("windows"))
        far = searched(written(asked, "windows"), blocks, index, total, negatives)
        pairs = far.where("best is not null").select("row", F.explode("best").alias("b")).select("row", "b.window", F.col("b.score").alias("negative_score"), F.col("b.id").alias("negative_id"), F.col("b.row").alias("brow"))
        ranked = pairs.withColumn("rank", F.expr("row_number() over (partition by row, window order by negative_score desc, negative_id, brow)").cast("int"))
        of = near.select("row", F.col("id").alias("anchor_id"), F.posexplode("pos").alias("window", "p")).select("row", "anchor_id", "window", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
        found = of.join(ranked, ["row", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        return scope.stay(written(found, "negatives"))
