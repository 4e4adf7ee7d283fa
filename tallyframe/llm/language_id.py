"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a text (A-Z lower-cased, all others as they are) in both directions, labels every position with a
distribution over the languages, and a document's distribution is the mean over all positions of its whole text. So that long texts keep
to bounded memory and many positions are computed at once, a text is read in lanes of LANE bytes, each with CONTEXT bytes more at both
sides: these bring the states up and are labelled in their own lanes.

Training is backpropagation through time in numpy, on the driver, over SAMPLE_DOCS documents of each language at most, those with the
lowest hashes of their ids; their texts are read whole. Only text and lang are learned from, and only text is read to predict.

Nulls and texts without letters are `und` with score 0; so is all where there is nothing to learn from. A null doc_id is not held out
and not learned from. Repeated rows get equal results; ties go to the first language by code point. Empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm._base import settle

HIDDEN, LANE, CONTEXT = 6, 512, 32
#: Lanes that are computed together, and bytes of text that are gathered for them.
TOGETHER, GATHER = 1024, 2_000_000
SAMPLE_DOCS = 60
#: Steps of training, each over BATCH lanes of TRAIN_LANE bytes; the sample is gone through as often as they ask for.
STEPS, BATCH, TRAIN_LANE, RATE = 300, 128, 64, 0.02
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def soft(x: np.ndarray, room: np.ndarray) -> None:
    """x / (1 + |x|) in place: the squashing function, in place of tanh, which takes most of the time else. Its slope is (1 - |y|)**2."""
    np.abs(x, out=room)
    room += 1
    x /= room


def slope(y: np.ndarray) -> np.ndarray:
    return np.square(1 - np.abs(y))


@dataclass
class Network:
    """`weights`: per direction what a byte adds to the gates (256, 3 x hidden) and the recurrent weights (hidden, 3 x hidden), then the
    output layer (2 x hidden, languages) and its offsets. States are (hidden, lanes)."""

    langs: list[str]
    weights: list[np.ndarray]

    @classmethod
    def fresh(cls, langs: list[str], hidden: int = HIDDEN, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        one = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        return cls(langs, [one(256, 3 * hidden), one(hidden, 3 * hidden), one(256, 3 * hidden), one(hidden, 3 * hidden), one(2 * hidden, len(langs)), np.zeros(len(langs), np.float32)])

    def direction(self, x: np.ndarray, there: np.ndarray, e: np.ndarray, u: np.ndarray, steps, keep: list | None = None) -> np.ndarray:
        """States after every position; x and there are (length, lanes). Where nothing is there, the state is nil."""
        hidden, e, u = len(u), np.ascontiguousarray(e.T), np.ascontiguousarray(u.T)
        h = np.zeros((hidden, x.shape[1]), e.dtype)
        out = np.empty((len(x), *h.shape), e.dtype)
        whole = there.all(axis=1)
        a, room = np.empty((3 * hidden, x.shape[1]), e.dtype), np.empty((2 * hidden, x.shape[1]), e.dtype)
        for t in steps:
            np.take(e, x[t], axis=1, out=a, mode="clip")
            g = u @ h
            zr = a[: 2 * hidden] + g[: 2 * hidden]
            soft(zr, room)
            zr *= 0.5
            zr += 0.5
            n = zr[hidden:] * g[2 * hidden :]
            n += a[2 * hidden :]
            soft(n, room[:hidden])
            if keep is not None:
                keep.append((t, h, zr[:hidden], zr[hidden:], n, g[2 * hidden :]))
            h = h - n
            h *= zr[:hidden]
            h += n
            if not whole[t]:
                h *= there[t]
            out[t] = h
        return out

    def backward(self, x: np.ndarray, there: np.ndarray, kept: list, dout: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Through time, from the last step that was taken to the first: the gradients of e and u."""
        dh, du = np.zeros_like(dout[0]), np.zeros_like(u)
        at, gates = [], []
        for t, h, z, r, n, gn in reversed(kept):
            new = (dh + dout[t]) * there[t]
            dn = new * (1 - z) * slope(n)
            dz, dr = new * (h - n) * 0.5 * slope(2 * z - 1), dn * gn * 0.5 * slope(2 * r - 1)
            dg = np.concatenate([dz, dr, dn * r])
            du += h @ dg.T
            dh = new * z + u @ dg
            at.append(x[t])
            gates.append(np.concatenate([dz, dr, dn]))
        at, gates = np.concatenate(at), np.concatenate(gates, axis=1)
        return np.stack([np.bincount(at, row, 256) for row in gates], axis=1).astype(u.dtype), du

    def positions(self, x: np.ndarray, there: np.ndarray, keep: tuple[list, list] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The states of both directions and, for every position, the languages' probabilities (length, languages, lanes)."""
        ef, uf, eb, ub, w, b = self.weights
        n, hidden = len(x), len(uf)
        f = self.direction(x, there, ef, uf, range(n), keep and keep[0])
        g = self.direction(x, there, eb, ub, range(n - 1, -1, -1), keep and keep[1])
        p = np.matmul(np.ascontiguousarray(w[:hidden].T), f)
        p += np.matmul(np.ascontiguousarray(w[hidden:].T), g)
        p += b[:, None]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return f, g, p

    def gradients(self, x: np.ndarray, there: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """The mean loss of all positions, where lane i is of language y[i], and its gradients."""
        keep: tuple[list, list] = ([], [])
        f, g, p = self.positions(x, there, keep)
        total, lanes, w = there.sum(), np.arange(x.shape[1]), self.weights[4]
        loss = float(-(np.log(p[:, y, lanes] + 1e-9) * there).sum() / total)
        ds = p.copy()
        ds[:, y, lanes] -= 1
        ds *= there[:, None, :] / total
        hidden = f.shape[1]
        over = lambda h: np.tensordot(h, ds, ([0, 2], [0, 2]))
        de_f, du_f = self.backward(x, there, keep[0], np.matmul(w[:hidden], ds), self.weights[1])
        de_g, du_g = self.backward(x, there, keep[1], np.matmul(w[hidden:], ds), self.weights[3])
        return loss, [de_f, du_f, de_g, du_g, np.concatenate([over(f), over(g)]), ds.sum(axis=(0, 2))]

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """For each text the mean of its positions' probabilities; zeros for an empty one."""
        flat = np.frombuffer(b"".join(texts), np.uint8)
        owner, first, last, begin, end = lanes_of([len(t) for t in texts])
        sums = np.zeros((len(texts), len(self.langs)))
        order = np.argsort(end - begin, kind="stable")
        for k in range(0, len(order), TOGETHER):
            some = order[k : k + TOGETHER]
            x, there, at = lanes_at(flat, begin[some], end[some])
            own = there & (at >= first[some]) & (at < last[some])
            _, _, p = self.positions(x, there)
            np.add.at(sums, owner[some], np.einsum("tcl,tl->lc", p, own.astype(np.float32)))
        return sums / np.maximum(1, [[len(t)] for t in texts]) if texts else sums


def lanes_of(lengths: list[int], lane: int = LANE, context: int = CONTEXT) -> tuple[np.ndarray, ...]:
    """Of each lane: the number of its text, where in the joined texts its own bytes begin and end, and the same with context."""
    n = np.array(lengths, np.int64)
    ends = np.cumsum(n)
    owner = np.repeat(np.arange(len(n)), -(-n // lane))
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(-(-n // lane)) - -(-n // lane), -(-n // lane))
    low, high = (ends - n)[owner], ends[owner]
    first = low + nth * lane
    last = np.minimum(first + lane, high)
    return owner, first, last, np.maximum(first - context, low), np.minimum(last + context, high)


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each text as a lane of its own, and where its bytes are: (length, lanes) each."""
    ends = np.cumsum([len(t) for t in texts])
    x, there, _ = lanes_at(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends)
    return x, there


def lanes_at(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes begin..end of each lane, whether they are there, and their places; (length, lanes) each."""
    at = begin + np.arange((end - begin).max())[:, None]
    there = at < end
    return flat[np.where(there, at, 0)].astype(np.intp), there, at


def train(sample: list[tuple[str, bytes]], steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 11) -> Network | None:
    """From (language, text). The same sample, in whatever order, gives the same network."""
    sample = sorted((lang, text) for lang, text in sample if text)
    langs = sorted({lang for lang, _ in sample})
    if not langs:
        return None
    net = Network.fresh(langs)
    flat = np.frombuffer(b"".join(t for _, t in sample), np.uint8)
    owner, begin, end, _, _ = lanes_of([len(t) for _, t in sample], TRAIN_LANE)
    y = np.array([langs.index(lang) for lang, _ in sample])[owner]
    r = np.random.default_rng(seed)
    m, v, step = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights], 0
    while step < steps:
        order = r.permutation(len(owner))
        for k in range(0, len(order), batch):
            some = order[k : k + batch]
            x, there, _ = lanes_at(flat, begin[some], end[some])
            _, grads = net.gradients(x, there, y[some])
            step += 1
            now = rate * (1 - 0.9 * min(1.0, step / steps))
            for w, g, a, b in zip(net.weights, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def predict(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def flush(ids: list, held: list, texts: list[bytes], alpha: list[bool]) -> pa.RecordBatch:
        if net is None:
            return pa.record_batch([ids, held, ["und"] * len(ids), [0.0] * len(ids)], schema=schema)
        p = net.pooled(texts)
        best = p.argmax(axis=1) if len(p) else []
        return pa.record_batch([ids, held, [net.langs[b] if a else "und" for b, a in zip(best, alpha, strict=True)], [min(1.0, float(q[b])) if a else 0.0 for q, b, a in zip(p, best, alpha, strict=True)]], schema=schema)

    settle()
    for batch in batches:
        rows: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for i, held in enumerate(batch.column(1).to_pylist()):
            text = batch.column(2)[i].as_py()
            alpha = has_letter(text)
            raw = text.encode().translate(LOWER) if alpha else b""
            for column, value in zip(rows, (batch.column(0)[i].as_py(), held, raw, alpha), strict=True):
                column.append(value)
            size += len(raw)
            if size > GATHER:
                yield flush(*rows)
                rows, size = ([], [], [], []), 0
        yield flush(*rows)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """A network from `text` and `lang` of `docs`: of each language the sample_docs documents whose ids hash lowest.

    Languages are taken to be few enough for the driver, as a classifier's classes are; every one in the table is learned."""
    known = docs.where("lang is not null and doc_id is not null and text is not null and text <> ''")
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return None
    # First a draw by share, so that the window behind it ranks a few rows only: half as many again, and 40, are never too few.
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, (1.5 * sample_docs + 40) / r["count"])))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.withColumn("draw", draw).where(F.col("draw") < F.element_at(share, F.col("lang")))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))
    rows = drawn.withColumn("nth", nth).where(F.col("nth") <= sample_docs).select("lang", "text").collect()
    return train([(r["lang"], r["text"].encode().translate(LOWER)) for r in rows])


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of documents; learns from the rows that are not held out."""
    held = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    net = fit(rows.where(~F.col("held_out")))
    return rows.select("doc_id", "held_out", "text").mapInArrow(lambda it: predict(it, net), "doc_id long, held_out boolean, lang_pred string, score double")
