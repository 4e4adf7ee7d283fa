"""Quality by ordinal regression: P(grade <= k) = sigmoid(threshold_k - z), with one z for all grades and ordered thresholds.

A text's words are cut into pieces of at most PIECE bytes, so that texts without spaces have many pieces too. z is linear in hashed
features of the pieces: the mean over them of a weight for the piece's shape (letter case, digits, marks), plus the sum over the pieces of
distinct words of a weight for the piece, over the root of their number. Grades: 0 where quality is 0, 1 where it is 1 but the text
toxic, 2 otherwise. The model is fitted on the SAMPLE labelled rows at most whose ids hash lowest; fitting and scoring read texts whole.

A document is kept if its tail probability P(grade >= 1) is CUT at least. Nulls and texts without words: grade and tail 0, not kept.
With no labels at all nothing is rejected (tail 1). Rows without a quality label are not learned from; a document labelled twice has its
lowest grade, an id with several texts is learned from by the least of them. Repeated rows get equal results; empty tables give empty
results. `grade_documents` reads doc_id and text only; `keep_good` passes on every column, whatever its name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from tallyframe.llm._base import Bounded, fresh, remembered

BITS, SAMPLE, CUT, PIECE = 14, 3000, 0.5, 16
ROUNDS, RATE, RIDGE = 250, 0.1, 1e-4
#: Letters become a or A, digits 0; marks stay.
SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_again = re.compile(rb"(.)\1+", re.DOTALL)
_edges = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def pieces_of(word: bytes) -> list[bytes]:
    return [word[i : i + PIECE] for i in range(0, len(word), PIECE)]


def count_pieces(words) -> int:
    return len(words) + sum((len(w) - 1) // PIECE for w in words if len(w) > PIECE)


def shape_of(piece: bytes) -> int:
    return xxhash.xxh3_64_intdigest(_again.sub(rb"\1\1", piece.translate(SHAPE))) >> (64 - BITS)


def word_of(piece: bytes) -> int:
    return xxhash.xxh3_64_intdigest(piece.strip(_edges).lower(), seed=1) >> (64 - BITS)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values: shapes first, then words."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    distinct = set(words)
    shapes = np.bincount([shape_of(p) for w in words for p in pieces_of(w)], minlength=1 << BITS) / count_pieces(words)
    kinds = np.bincount([word_of(p) for w in distinct for p in pieces_of(w)], minlength=1 << BITS) / np.sqrt(count_pieces(distinct))
    both = np.concatenate([shapes, kinds])
    columns = np.flatnonzero(both)
    return columns.astype(np.int32), both[columns].astype(np.float32)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > grades[k]) for each k but the last."""
        return sigmoid(np.asarray(z)[..., None] - self.thresholds)

    def expected(self, z: np.ndarray) -> np.ndarray:
        return self.grades[0] + self.tails(z) @ np.diff(self.grades) if len(self.grades) > 1 else np.full(np.shape(z), float(self.grades[0]))

    def tail(self, z: np.ndarray, grade: int) -> np.ndarray:
        """P(grade >= `grade`)."""
        below = sum(g < grade for g in self.grades)
        if below == 0:
            return np.ones(np.shape(z))
        return self.tails(z)[..., below - 1] if below < len(self.grades) else np.zeros(np.shape(z))


def fit_ordinal(rows: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = ROUNDS, rate: float = RATE, ridge: float = RIDGE) -> Ordinal | None:
    """From (grade, columns, values); maximum likelihood with a ridge, by full gradients."""
    if not rows:
        return None
    grades = sorted({g for g, _, _ in rows})
    width = 2 << BITS
    k = len(grades) - 1
    w = np.zeros(width)
    y = np.array([grades.index(g) for g, _, _ in rows])
    # The first threshold, and logs of the steps to the next ones.
    t = np.zeros(max(k, 1))
    if not k:
        return Ordinal(grades, w, t[:0])
    t[0] = np.log((y == 0).sum() / (y > 0).sum())
    doc = np.repeat(np.arange(len(rows)), [len(c) for _, c, _ in rows])
    columns, values = np.concatenate([c for _, c, _ in rows]), np.concatenate([v for _, _, v in rows]).astype(float)
    m, v = [np.zeros_like(w), np.zeros_like(t)], [np.zeros_like(w), np.zeros_like(t)]
    for step in range(1, rounds + 1):
        edges = np.concatenate([[-np.inf], t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))]), [np.inf]])
        z = np.bincount(doc, values * w[columns], len(rows))
        hi, lo = sigmoid(edges[y + 1] - z), sigmoid(edges[y] - z)
        p = np.maximum(hi - lo, 1e-9)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p  # of log p by the upper edge, and minus that by the lower
        dz = (dhi - dlo) / len(rows)
        dedge = np.array([(dlo[y == j].sum() - dhi[y == j - 1].sum()) / len(rows) for j in range(1, k + 1)])
        dt = np.array([dedge.sum(), *(dedge[j:].sum() * np.exp(t[j]) for j in range(1, k))])
        for a, g, x, s in ((w, np.bincount(columns, dz[doc] * values, width) + ridge * w, m[0], v[0]), (t, dt, m[1], v[1])):
            x += 0.1 * (g - x)
            s += 0.01 * (g * g - s)
            a -= rate * (x / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Ordinal(grades, w, t[0] + np.concatenate([[0], np.cumsum(np.exp(t[1:]))]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal | None:
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, 1).otherwise(2)
    graded = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), grade.alias("grade"))
    draw = F.pmod(F.xxhash64(F.lit("grade"), "_id"), F.lit(1 << 30)) / float(1 << 30)
    # By share first, a fifth more than asked for, so that what is broadcast and collected is bounded; then by rank.
    share = min(1.0, (1.2 * sample + 100) / max(1, graded.count()))
    graded = graded.withColumn("draw", draw).where(F.col("draw") < share).groupBy("_id", "draw").agg(F.min("grade").alias("grade"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(graded), "_id").groupBy("_id", "draw", "grade").agg(F.min("text").alias("text")).select("draw", "_id", "grade", "text")

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [features(t) for t in pdf["text"]]
            yield pd.DataFrame({"draw": pdf["draw"], "_id": pdf["_id"], "grade": pdf["grade"], "columns": [c for c, _ in found], "values": [v for _, v in found]})

    got = rows.mapInPandas(extract, "draw double, _id long, grade int, columns array<int>, values array<float>").where("size(columns) > 0").orderBy("draw", "_id").limit(sample).select("grade", "columns", "values").toArrow()
    # Arrow's own arrays: as lists of Python numbers they would take many times the room.
    return fit_ordinal([(g.as_py(), c.values.to_numpy(), v.values.to_numpy()) for batch in got.to_batches() for g, c, v in zip(*batch.columns, strict=True)])


class Scorer:
    """z of texts; weights of recent words are remembered."""

    def __init__(self, model: Ordinal):
        shapes, words = model.weights[: 1 << BITS], model.weights[1 << BITS :]
        self.shape = Bounded(lambda w: float(sum(shapes[shape_of(p)] for p in pieces_of(w))), 300_000)
        self.word = Bounded(lambda w: float(sum(words[word_of(p)] for p in pieces_of(w))), 300_000)

    def z(self, text: str | None) -> float | None:
        words = (text or "").encode().split()
        if not words:
            return None
        distinct = set(words)
        return sum(map(self.shape.__getitem__, words)) / count_pieces(words) + math.fsum(map(self.word.__getitem__, distinct)) / count_pieces(distinct) ** 0.5


def scorer(model: Ordinal) -> Scorer:
    return remembered(("scorer", model.weights.tobytes()), lambda: Scorer(model))


def grades(batches: Iterator[pa.RecordBatch], model: Ordinal | None, grade: int, cut: float, at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Puts the expected grade, the tail probability and whether the row is kept behind each row; column `at` is the text."""
    own = scorer(model) if model else None
    for batch in batches:
        z = [own.z(t.as_py()) if own else 0.0 for t in batch.column(at)]
        there = np.array([x is not None for x in z])
        values = np.array([x or 0.0 for x in z])
        expected = np.where(there, model.expected(values), 0.0) if model else np.zeros(len(z))
        tail = np.where(there, model.tail(values, grade), 0.0) if model else np.ones(len(z))
        yield pa.record_batch([*batch.columns, pa.array(expected), pa.array(tail), pa.array(tail >= cut)], names=[*batch.schema.names, *names])


def grade_documents(docs: DataFrame, labels: DataFrame, grade: int = 1, cut: float = CUT) -> DataFrame:
    """doc_id, text, expected_grade, tail_prob, kept for each row."""
    model = fit(docs, labels)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(lambda it: grades(it, model, grade, cut, 1, ["expected_grade", "tail_prob", "kept"]), "doc_id long, text string, expected_grade double, tail_prob double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, grade: int = 1, cut: float = CUT) -> DataFrame:
    """The rows of `docs` that are kept, with all the columns they had."""
    model = fit(docs, labels)
    names = fresh(docs, "_expected", "_tail", "_kept")
    source, at = docs, docs.columns.index("text")
    if docs.schema["text"].dataType.typeName() != "string":
        source, at = docs.withColumn(*fresh(docs, "_text"), F.col("text").cast("string")), len(docs.columns)
    schema = StructType([*source.schema.fields, *map(StructField, names, (DoubleType(), DoubleType(), BooleanType()))])
    return source.mapInArrow(lambda it: grades(it, model, grade, cut, at, names), schema).where(F.col(names[2])).select(*docs.columns)
