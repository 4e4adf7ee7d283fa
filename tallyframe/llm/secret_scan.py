"""Secret scans over a trigram index.

Each rule's regex is parsed and turned into a Boolean query of the trigrams that any match must contain (an AND of ORs of ANDs, after
Cox, "Regular expression matching with a trigram index"). Each block of documents gets an inverted index: the sorted positions of every
trigram that some rule asks for, as documents' numbers. Rules' queries are answered by intersecting and uniting these postings, and only
the documents found are searched with the regex itself. A rule without mandatory trigrams scans every document.

Trigrams are of bytes with A-Z lower-cased, so that rules that ignore case share the index. Null texts are empty; every row gives a
result, repeated rows too; a document of any length is scanned whole. The index lives for one block of documents, which is closed when it
holds more than INDEX code points. Empty tables give empty results; other columns are not read. Patterns are parsed with the parser that
`re` itself uses.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INDEX = 8_000_000
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length must be `least` at least; 0 is the whole match.
    group: int
    least: int
    ignore_case: bool = False
    #: A faster pattern with the same matches of at least `least` characters, where there is one.
    search: str | None = None

    def compiled(self) -> re.Pattern:
        return re.compile(self.search or self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


# The three kinds of secrets.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ignore_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of this class are matched whole, so asking for 24 or more finds the runs that are long enough.
    Rule("hex", r"[0-9a-f]+", 0, 24, search=r"[0-9a-f]{24,}"),
)

#: A query is True (no demand), ("tri", trigram), ("and", queries) or ("or", queries).
Query = object


def both(parts: list[Query]) -> Query:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def either(parts: list[Query]) -> Query:
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def trigrams(text: str) -> Query:
    raw = text.encode().translate(LOWER)
    return both([("tri", raw[i : i + 3]) for i in range(len(raw) - 2)])


#: Beyond so many alternatives a run of literals is cut and its parts are asked for one by one.
MANY = 16


def query_of(pattern: str) -> Query:
    """The trigrams that every match must contain.

    Walks the parsed regex with the set of literal strings that the current run may be; whatever cannot be spelt out ends the run."""

    def walk(items) -> tuple[list[str] | None, list[Query]]:
        """The exact strings that the items may match, if few, and what is demanded besides."""
        runs, demands = [""], []

        def cut() -> None:
            nonlocal runs
            demands.append(either([trigrams(r) for r in runs]))
            runs = [""]

        whole = True
        for op, arg in items:
            if op is K.LITERAL:
                options = [chr(arg)]
            elif op is K.SUBPATTERN:
                options, more = walk(arg[3])
                demands += more
            elif op is K.BRANCH:
                found = [walk(branch) for branch in arg[1]]
                if all(o is not None and not d for o, d in found):
                    options = [x for o, _ in found for x in o]
                else:
                    options = None
                    demands.append(either([both([*d, *([either([trigrams(x) for x in o])] if o else [])]) for o, d in found]))
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[:2] == (0, 1):
                options, more = walk(arg[2])
                options = None if options is None or more else ["", *options]
            elif op in (K.MAX_REPEAT, K.MIN_REPEAT) and arg[0] > 0:
                options, more = walk(arg[2])
                demands += more
                if options is not None and arg[1] == 1:
                    pass
                else:
                    if options:
                        demands.append(either([trigrams(x) for x in options]))
                    options = None
            else:
                options = None
            if options is None or len(options) * len(runs) > MANY:
                cut()
                whole = False
                runs = options if options is not None and len(options) <= MANY else [""]
            else:
                runs = [r + o for r in runs for o in options]
        if whole:
            return runs, [d for d in demands if d is not True]
        cut()
        return None, [d for d in demands if d is not True]

    runs, demands = walk(_parser.parse(pattern))
    return both([*demands, *([either([trigrams(r) for r in runs])] if runs is not None else [])])


def asked(query: Query) -> set[bytes]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*map(asked, query[1]))


def code(tri: bytes) -> int:
    return tri[0] << 16 | tri[1] << 8 | tri[2]


def index(raws: list[bytes], wanted: set[bytes]) -> dict[bytes, np.ndarray]:
    """Postings: for each wanted trigram the sorted numbers of the documents that hold it."""
    ends = np.cumsum([len(r) + 1 for r in raws])
    flat = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    if len(flat) < 3:
        return {t: np.zeros(0, np.int64) for t in wanted}
    #: First a table of the leading byte pairs asked for: few places are left to compare in full.
    table = np.zeros(1 << 16, bool)
    for t in wanted:
        table[t[0] << 8 | t[1]] = True
    pair = flat[:-1].astype(np.uint16) << np.uint16(8) | flat[1:]
    at = np.flatnonzero(table[pair[:-1]])
    codes = pair[at].astype(np.int64) << 8 | flat[at + 2]
    docs = np.searchsorted(ends, at, side="right")
    return {t: np.unique(docs[codes == code(t)]) for t in wanted}


def answer(query: Query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    if query is True:
        return np.arange(n)
    if query[0] == "tri":
        return postings[query[1]]
    parts = [answer(q, postings, n) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


def find(rule: Rule, regex: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in regex.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan_block(texts: list[str], rules=RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, rule's number, end), sorted."""
    queries = [query_of(r.pattern) for r in rules]
    postings = index([t.encode().translate(LOWER) for t in texts], set().union(*map(asked, queries)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        regex = rule.compiled()
        for i in answer(query, postings, len(texts)):
            out[i] += [(a, k, b) for a, b in find(rule, regex, texts[i])]
    return [sorted(x) for x in out]


def scan_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, n_<kind> for each rule, spans (array of kind, start, end in code points; end exclusive) for each row."""
    kinds = [r.kind for r in rules]
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in kinds], ("spans", struct), ("joined", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True), 1):
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held > INDEX or i == batch.num_rows:
                    found = scan_block(texts, rules)
                    yield pa.record_batch([ids, *[[sum(s[1] == k for s in f) for f in found] for k in range(len(rules))], [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in f] for f in found], [",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in f) for f in found]], schema=schema)
                    ids, texts, held = [], [], 0

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, " + "".join(f"n_{k} long, " for k in kinds) + "spans array<struct<kind:string,start:long,end:long>>, joined string")
