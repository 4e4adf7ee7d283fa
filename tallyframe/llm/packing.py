"""Best-fit packing of token sequences by exact-complement hashing.

Only the counts of lengths matter for where pieces go, and there are at most LIMIT of them whatever the input's size. The sums of all
pairs of these lengths and of all triples are indexed by sum. From the longest length to the shortest, the gap up to LIMIT is looked up
as a single length, as a pair's sum, as a triple's; each combination found fills the gap exactly, and as many of it are consumed as the
counts of its members allow. What remains is packed best fit: the longest piece first, then again and again the longest length that
fits. Each combination is a row `pattern x times`; each uses up a length, so the plan is small, and pieces find their place by their rank
among those of their length.

A document: its ids plus END; documents over LIMIT are cut into pieces of LIMIT. Null texts are empty (one END). Repeated rows are rows
of their own; empty tables give empty results; null ids stay null; other columns are not read.
"""

from __future__ import annotations

import itertools
import os
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._base import buckets_for, remembered, running_total, written

LIMIT, END = 4096, 1
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters of ASCII that are neither letters, white space nor the apostrophe (which may begin a word's ending).
MARKS = "".join(chr(b) for b in range(33, 127) if not chr(b).isalpha() and chr(b) != "'")
_mark = re.escape(MARKS).encode()
#: Runs of letters, and of marks, if white space, the end or one of the other kind follows; else all up to the next white space.
_parts = re.compile(rb"[a-z]++(?![^a-z\s%s])|[%s]++(?![^a-z\s%s])|\S++" % (_mark, _mark, _mark)).findall


class Runs(dict):
    """Runs of text, by number, with their ids in one flat array.

    Runs end at ASCII white space, and at borders of a letter and a mark; `divides` holds the vocabulary to its never joining across
    these, so the ids of a text are those of its runs, one after the other. A vocabulary that joins is called with whole texts. New runs
    of plain letters go to the vocabulary's model at once, if that gives the same (`plain`); others are encoded many at once, divided by
    a special token that no run holds."""

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task is one thread
        self.known, self.most = Tokenizer.from_file(path), most
        same = lambda a, b: self.known.encode(a, add_special_tokens=False).ids == self.known.encode(b, add_special_tokens=False).ids
        self.folds = same("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        self.divides = self.folds and all(self.alone(a, "", b) and self.alone(b, "", a) for a in string.ascii_lowercase for b in MARKS) and all(self.alone(a, w, b) for w in " \t\n\r\v\f" for a in "az19.'" for b in "az19.'")
        self.plain = self.folds and all(self.by_model(x.encode()) == self.known.encode(x, add_special_tokens=False).ids for x in (*string.ascii_lowercase, string.ascii_lowercase, "the", "unhappily", "s", "ll"))
        self.marks = {t.content: i for i, t in self.known.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.normalized)}
        self.reset()

    def alone(self, a: str, between: str, b: str) -> bool:
        """Whether the ids of a and b together are those of a and those of b."""
        ids = lambda x: self.known.encode(x, add_special_tokens=False).ids
        return ids(a + between + b) == ids(a) + ids(b)

    def by_model(self, run: bytes) -> list[int]:
        return [t.id for t in self.known.model.tokenize(run.decode())]

    def reset(self) -> None:
        self.clear()
        self.pending: list[bytes] = []
        self.flat, self.starts, self.used, self.n = np.zeros(1 << 16, "<u4"), np.zeros(1 << 16, np.int64), 0, 0

    def __missing__(self, run: bytes) -> int:
        number = self[run] = len(self)
        self.pending.append(run)
        return number

    def learn(self) -> None:
        new, self.pending = self.pending, []
        if not new:
            return
        lengths, flats = np.zeros(len(new), np.int64), []
        plain = np.array([self.plain and r.isalpha() and r.islower() for r in new])
        for group, ids_of in ((np.flatnonzero(plain), self.of_letters), (np.flatnonzero(~plain), self.of_others)):
            if len(group):
                lengths[group], flat = ids_of([new[i] for i in group])
                flats.append(flat)
        # Back from both groups to the runs' own order.
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        begin = np.empty(len(new), np.int64)
        begin[order] = np.cumsum(lengths[order]) - lengths[order]
        flat = np.concatenate(flats)[np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(new) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[self.n + 1 : self.n + 1 + len(new)] = self.used + np.cumsum(lengths)
        self.used, self.n = self.used + len(flat), self.n + len(new)

    def of_letters(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each run has, and all of them."""
        ids = list(map(self.by_model, runs))
        return np.array([len(x) for x in ids]), np.array([i for x in ids for i in x], "<u4")

    def of_others(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        mark, divider = next(iter(self.marks.items()), (None, None))
        if mark is None or any(b"<" in r and any(m.encode() in r for m in self.marks) for r in runs):
            ids = [self.known.encode(r.decode(), add_special_tokens=False).ids for r in runs]
            return np.array([len(x) for x in ids]), np.array([i for x in ids for i in x], "<u4")
        groups = [mark.join([*(r.decode() for r in runs[k : k + 2000]), ""]) for k in range(0, len(runs), 2000)]
        flat = np.concatenate([np.array(e.ids, "<u4") for e in self.known.encode_batch_fast(groups, add_special_tokens=False)])
        ends = np.flatnonzero(flat == divider)  # one behind each run
        return np.diff(ends, prepend=-1) - 1, flat[flat != divider]

    def numbers(self, text: str) -> np.ndarray:
        raw = text.encode()
        if not self.divides:
            runs = [raw]
        elif any(m.encode() in raw for m in self.marks):
            runs = raw.split()
        else:
            runs = _parts(raw.lower())
        return np.fromiter(map(self.__getitem__, runs), np.int64, len(runs))

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of these runs, and END."""
        begin, lengths = self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        out = np.full(total + 1, END, "<u4")
        out[:-1] = self.flat[np.repeat(begin - (ends - lengths), lengths) + np.arange(total)]
        return out


def encoder(path: str) -> Runs:
    return remembered(("encoder", path), lambda: Runs(path))


def encode(texts: list[str], runs: Runs) -> Iterator[np.ndarray]:
    """Chunk by chunk: numbers first, then what is new is encoded, then the ids of each text."""
    waiting: list[np.ndarray] = []
    held = 0
    for i, text in enumerate(texts, 1):
        waiting.append(runs.numbers(text))
        held += len(waiting[-1])
        if held > 300_000 or i == len(texts):
            runs.learn()
            yield from (runs.ids(n) for n in waiting)
            waiting, held = [], 0
            if len(runs) > runs.most or runs.used > 20_000_000:
                runs.reset()


def tokenise(batches: Iterator[pa.RecordBatch], path: str, limit: int = LIMIT) -> Iterator[pa.RecordBatch]:
    runs, row = encoder(path), TaskContext.get().partitionId() << 40
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        out: list[list] = [[] for _ in schema]
        texts = [text or "" for text in batch.column(1).to_pylist()]
        for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts, runs), strict=True):
            for piece, start in enumerate(range(0, len(ids), limit)):
                part = ids[start : start + limit]
                for column, value in zip(out, (row, doc_id, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                    column.append(value)
            row += 1
        yield pa.record_batch(out, schema=schema)


class Sums:
    """The sums of pairs and of triples of `lengths`, up to `limit`, by sum: what combinations have it."""

    def __init__(self, lengths: np.ndarray, limit: int):
        if 2 * limit >= 1 << 15:
            raise ValueError("sums are held in 16 bits")
        lengths = np.sort(np.asarray(lengths, np.int16))
        larger = [np.full(np.searchsorted(lengths[: i + 1], limit - a, side="right"), a, np.int16) for i, a in enumerate(lengths)]
        smaller = [lengths[: len(x)] for x in larger]
        self.larger, self.smaller, self.pairs = self.by_sum(larger, smaller, limit)
        sums = np.flatnonzero(np.diff(self.pairs)).astype(np.int16)  # of pairs that there are
        longest = [np.full(np.searchsorted(sums, limit - c, side="right"), c, np.int16) for c in lengths]
        self.longest, self.rest, self.triples = self.by_sum(longest, [sums[: len(x)] for x in longest], limit)

    @staticmethod
    def by_sum(x: list[np.ndarray], y: list[np.ndarray], limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both parts in order of their sum, and where each sum begins."""
        a, b = (np.concatenate([np.zeros(0, np.int16), *v]) for v in (x, y))
        total = a + b
        order = np.argsort(total, kind="stable").astype(np.int32)
        return a[order], b[order], np.concatenate([[0], np.cumsum(np.bincount(total, minlength=limit + 1))])

    def of_two(self, total: int, have: np.ndarray) -> Iterator[list[int]]:
        """Pairs with that sum whose members there still are."""
        part = slice(self.pairs[total], self.pairs[total + 1])
        a, b = self.larger[part], self.smaller[part]
        alive = (have[a] > 0) & (have[b] > 0)
        yield from np.stack([a[alive], b[alive]], axis=1).tolist()

    def of_three(self, total: int, have: np.ndarray) -> Iterator[list[int]]:
        """Triples, each with its longest member first."""
        part = slice(self.triples[total], self.triples[total + 1])
        c, rest = self.longest[part], self.rest[part]
        alive = (have[c] > 0) & (rest <= 2 * c)
        for longest, pair in zip(c[alive].tolist(), rest[alive].tolist(), strict=True):
            if have[longest]:
                yield from ([longest, *two] for two in self.of_two(pair, have) if two[0] <= longest)


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[dict[int, int], int]]:
    """[({length: how often in one sequence}, sequences)], using up exactly `counts`. Where lengths are many and copies few, triples may
    use up short pieces that long ones would need: so gaps are filled by up to three, two and one pieces, and the best plan is taken."""
    sums = Sums(np.array(sorted(n for n, k in counts.items() if k), np.int64), limit)
    return min((plan_with(counts, sums, most, limit) for most in (3, 2, 1)), key=lambda out: sum(times for _, times in out))


def plan_with(counts: dict[int, int], sums: Sums, most: int, limit: int) -> list[tuple[dict[int, int], int]]:
    have = np.zeros(limit + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] = n
    out: list[tuple[dict[int, int], int]] = []

    def take(members: list[int]) -> None:
        use: dict[int, int] = {}
        for m in members:
            use[m] = use.get(m, 0) + 1
        times = int(min(have[m] // k for m, k in use.items()))
        if times:
            for m, k in use.items():
                have[m] -= k * times
            out.append((use, times))

    for top in range(limit, 0, -1):
        gap = limit - top
        ways = ([[]] if not gap else [[gap]], sums.of_two(gap, have), sums.of_three(gap, have))
        for way in itertools.chain.from_iterable(ways[:most]):
            if not have[top]:
                break
            take([top, *way])
    while have.any():  # best fit of what is left
        top = int(np.flatnonzero(have)[-1])
        left, members = have.copy(), []
        room = limit
        while room:
            fit = np.flatnonzero(left[: room + 1])
            if not len(fit):
                break
            best = int(fit[-1])
            k = int(min(left[best], room // best))
            members += [best] * k
            left[best] -= k
            room -= k * best
        assert members[0] == top
        take(members)
    return out


def layout(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Of each (length, range of ranks): its first rank, the first sequence, pieces a sequence and where they begin."""
    rows, used, sequence = [], {}, 0
    for use, times in patterns:
        at = 0
        for length, k in sorted(use.items(), reverse=True):
            begin = used.get(length, 0)
            rows.append((length, begin, sequence, k, at))
            used[length] = begin + k * times
            at += k * length
        sequence += times
    rows.sort()
    names = ("length", "begin", "sequence", "each", "at")
    table = {n: np.array([r[i] for r in rows], dtype=np.int64) for i, n in enumerate(names)}
    return table | {"key": (table["length"] << 48) + table["begin"]}


def place(batches: Iterator[pd.DataFrame], table: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            i = np.searchsorted(table["key"], (pdf["length"].to_numpy() << 48) + pdf["rank"].to_numpy(), side="right") - 1
            nth = pdf["rank"].to_numpy() - table["begin"][i]
            pdf["sequence_id"] = table["sequence"][i] + nth // table["each"][i]
            pdf["offset"] = table["at"][i] + nth % table["each"][i] * table["length"][i]
            yield pdf.drop(columns=["rank"])


def pack(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each row."""
    path = vocabulary or default_vocabulary()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(source.mapInArrow(lambda it: tokenise(it, path, limit), PIECES), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `limit` rows
    table = layout(plan(counts, limit))
    deal = buckets_for(sum(counts.values()))
    ranked = running_total(pieces.withColumn("_deal", F.pmod(F.xxhash64("row", "piece"), F.lit(deal))), ["length"], "_deal", ["row", "piece"], F.lit(1), "rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return ranked.mapInPandas(lambda it: place(it, table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
