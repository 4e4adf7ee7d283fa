"""Pages as nested elements: a tokenizer with an element stack, run over Arrow batches.

Elements of one name nest, void elements have no end, an end tag closes what is open above its own element, paragraphs, list items and
table parts end where the next begins, and scripts, styles and comments are no text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript")
#: An element of the first kind ends where one of the second begins.
ENDS = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option", "optgroup"])}
BOXES = frozenset("article aside blockquote body button dl div fieldset footer form header html main nav ol section select table ul".split())
BREAKS = frozenset("br p div li ul ol td th tr table h1 h2 h3 h4 h5 h6 section article".split())


class Element:
    __slots__ = ("attributes", "depth", "parts", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], depth: int):
        self.tag, self.attributes, self.depth, self.parts = tag, attributes, depth, []

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def walk(page: str) -> Iterator[tuple[str, object]]:
    """('start', Element), ('end', Element), ('text', str) and ('break', tag) events of a page, in order; all elements end."""
    stack: list[Element] = []
    at = 0

    def close(upto: int):
        while len(stack) > upto:
            yield "end", stack.pop()

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:]
            break
        if m.start() > at:
            yield "text", page[at : m.start()]
        at = m.end()
        tag = (m.group(2) or "").lower()
        if not tag:
            continue
        if tag in BREAKS:
            yield "break", tag
        if m.group(1):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    yield from close(k)
                    break
            continue
        k = len(stack) - 1
        while k >= 0:  # what ends here, with all that is open in it, up to the nearest box
            if tag in ENDS.get(stack[k].tag, ()):
                yield from close(k)
            elif stack[k].tag in BOXES:
                break
            k -= 1
        attributes = {a.group(1).lower(): html.unescape(a.group(2) or a.group(3) or a.group(4) or "") for a in ATTRIBUTE.finditer(m.group(3))}
        element = Element(tag, attributes, len(stack))
        yield "start", element
        if tag in VOID or m.group(3).endswith("/"):
            yield "end", element
        elif tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            inner = page[at : end.start() if end else len(page)]
            at = end.end() if end else len(page)
            if tag in ("textarea", "title"):
                element.parts.append(inner)
            yield "end", element
        else:
            stack.append(element)
    yield from close(0)


def fields_of(page: str, classes: dict[str, str], labels: dict[str, str]) -> dict[str, str]:
    """The text of the first element of each class, however elements nest in it, and what follows each bold label up to the next break or
    bold text; empty where there is none."""
    out = dict.fromkeys((*classes, *labels), "")
    open_: dict[str, Element] = {}
    done: set[str] = set()
    bold: list[tuple[Element, list[str]]] = []
    reading: dict[str, list[str]] = {}
    for kind, what in walk(page):
        if kind == "text":
            for element in open_.values():
                element.parts.append(what)
            for _, parts in bold[-1:]:
                parts.append(what)
            if not bold:
                for parts in reading.values():
                    parts.append(what)
        elif kind == "start":
            named = what.attributes.get("class", "").split()
            for name, wanted in classes.items():
                if wanted in named and name not in done and name not in open_:
                    open_[name] = what
            if what.tag in ("b", "strong"):
                bold.append((what, []))
                for name in list(reading):
                    out[name] = " ".join(html.unescape("".join(reading.pop(name))).split()).lstrip(": ")
        elif kind == "break":
            for element in open_.values():
                element.parts.append(" ")
            for name in list(reading):
                out[name] = " ".join(html.unescape("".join(reading.pop(name))).split()).lstrip(": ")
        else:
            for name in [n for n, e in open_.items() if e is what]:
                out[name] = open_.pop(name).text()
                done.add(name)
            if bold and bold[-1][0] is what:
                label = " ".join(html.unescape("".join(bold.pop()[1])).split()).rstrip(": ")
                for name, wanted in labels.items():
                    if label.lower() == wanted.lower() and name not in done:
                        reading[name] = []
                        done.add(name)
    for name, parts in reading.items():
        out[name] = " ".join(html.unescape("".join(parts)).split()).lstrip(": ")
    return out


def fields(pages: DataFrame, key: str, text: str, classes: dict[str, str], labels: dict[str, str] | None = None) -> DataFrame:
    """`key` and one string column for each class and label; a null page has none of them."""
    names = [*classes, *(labels or {})]
    source = pages.select(key, F.col(text).cast("string").alias("_text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fields_of(page.as_py() or "", classes, labels or {}) for page in batch.column(1)]
            yield pa.record_batch([batch.column(0), *[pa.array([r[n] for r in rows], pa.string()) for n in names]], names=[key, *names])

    return source.mapInArrow(read, f"{key} {source.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} string" for n in names))


def elements(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nth, depth, tag, id, classes): all elements of each page in order of their starts."""
    source = pages.select(key, F.col(text).cast("string").alias("_text"))
    kind = source.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = [e for what, e in walk(batch.column(1)[k].as_py() or "") if what == "start"]
                yield pa.record_batch(
                    [batch.column(0).take(pa.array([k] * len(found), pa.int64())), pa.array(range(len(found)), pa.int32()), pa.array([e.depth for e in found], pa.int32()), pa.array([e.tag for e in found], pa.string()), pa.array([e.attributes.get("id", "") for e in found], pa.string()), pa.array([" ".join(e.attributes.get("class", "").split()) for e in found], pa.string())],
                    names=[key, "nth", "depth", "tag", "id", "classes"])

    return source.mapInArrow(read, f"{key} {kind}, nth int, depth int, tag string, id string, classes string")
