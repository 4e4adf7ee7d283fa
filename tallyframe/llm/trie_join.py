"""Spelling variants: a self-join of the vocabulary's trie with active-node sets, at edit distance one.

Words are maximal runs of letters; the vocabulary counts them over all rows. The trie is partitioned by prefix. A prefix with more than MOST
code points below it is taken apart in Spark: at each depth of it, a node's active set is its own path (no edit yet) and the nodes that one
edit at this character reaches; with the only edit spent, such a node can follow its partner by equal characters alone, so their terminals
meet in an equi-join on what is left of the words. Depths are taken two, four, eight at a time, until no prefix is too large. Below it, one
task walks a prefix's trie: each node's active set comes from its parent's (a character followed, deleted, inserted or replaced), and a
terminal meets the terminals in its set. A word that is alone below its node keeps the rest of its letters as a tail, so long words
make no deep tries. Each near pair is found at the first character in which its words differ, hence once.

No key is hot: a key of the equi-join stands for words that differ in one character, so it has no more words than there are letters.

Rows: null texts have no words; equal rows count each, as do rows of one id; a null id reads as an empty string. Very long texts are read
whole; words of any length are kept. Ties between a word's near words of equal count go to the first in code-point order. Other columns
are not read."""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm._base import Scope, settle, written

LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, TIMES, EVERY = 7, 2, 10, 31
#: Code points of the words below one prefix that a task takes at once.
MOST = 200_000
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words_of(doc_id: int | None, text: str, least: int, every: int) -> Counter:
    """The words of a text with their counts; in a run whose checksum with the id is divisible by `every`, one letter is deleted."""
    text = text.lower() if text.isascii() else text.translate(LOWER)
    out: Counter = Counter()
    for run, n in Counter(re.findall(f"{LETTERS}{{{least},}}", text)).items():
        if every:
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) < least:
                    continue
        out[run] += n
    return out


def count_batches(batches: Iterator[pa.RecordBatch], least: int, every: int) -> Iterator[pa.RecordBatch]:
    settle()
    total: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if text.is_valid:
                total.update(words_of(doc_id, text.as_py(), least, every))
            if len(total) > 200_000:
                yield pa.record_batch([list(total), list(total.values())], names=["word", "n"])
                total.clear()
    yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): the words of at least `least` code points that come `count` times or more over all rows."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = source.mapInArrow(lambda it: count_batches(it, least, every), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


class Node:
    """A node of a trie: children by letter, and its terminal word. Without children, `tail` is the rest of its only word."""

    __slots__ = ("kids", "tail", "word")

    def __init__(self, word: int | None = None, tail: str = ""):
        self.kids: dict[str, Node] = {}
        self.word, self.tail = word, tail


def trie(words: list[str], start: int) -> Node:
    """The trie of distinct words that agree in their first `start` letters."""
    root = Node()
    for nth, word in enumerate(words):
        node, at = root, start
        while True:
            if node.tail:  # a word alone below its node makes room
                node.kids[node.tail[0]] = Node(node.word, node.tail[1:])
                node.word, node.tail = None, ""
            if at == len(word):
                node.word = nth
                break
            if word[at] not in node.kids:
                node.kids[word[at]] = Node(nth, word[at + 1 :])
                break
            node, at = node.kids[word[at]], at + 1
    return root


def near_pairs(words: list[str], start: int = 0) -> Iterator[tuple[int, int]]:
    """(i, j) for all words i, j at edit distance one, in both orders; words agree in their first `start` letters.

    Walks the trie with each node's active set: the nodes, and places in tails, that one edit away from it reaches. The node itself, at
    no edit, is not in the set but gives rise to its children's."""

    def follow(node: Node, off: int, letter: str):
        """The place after `letter`, or None."""
        if node.tail:
            return (node, off + 1) if off < len(node.tail) and node.tail[off] == letter else None
        kid = node.kids.get(letter)
        return None if kid is None else (kid, 0)

    def end_of(node: Node, off: int, rest: str) -> int | None:
        """The word that `rest` spells from here."""
        for nth, letter in enumerate(rest):
            if node.tail:
                return node.word if node.tail[off:] == rest[nth:] else None
            node = node.kids.get(letter)
            if node is None:
                return None
            off = 0
        return node.word if off == len(node.tail) else None

    root = trie(words, start)
    # The root's active set: what one inserted letter reaches.
    stack: list[tuple[Node, list[tuple[Node, int]]]] = [(root, [(kid, 0) for kid in root.kids.values()])]
    if root.tail:
        return
    while stack:
        node, active = stack.pop()
        if node.word is not None:
            met = set()
            for other, off in active:
                word = end_of(other, off, node.tail)
                if word is not None and word != node.word:
                    met.add(word)
            for word in met:
                yield node.word, word
        for letter, kid in node.kids.items():
            reached = {}
            for other, off in active:  # the letter followed
                place = follow(other, off, letter)
                if place is not None:
                    reached[id(place[0]), place[1]] = place
            reached[id(node), 0] = (node, 0)  # the letter deleted
            for other in node.kids.values():  # replaced
                if other is not kid:
                    reached[id(other), 0] = (other, 0)
            for other in kid.kids.values():  # one more inserted behind it
                reached[id(other), 0] = (other, 0)
            stack.append((kid, list(reached.values())))


def walk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n) of rows (prefix, word, n) sorted by prefix."""
    settle()

    def flush(prefix, words, counts):
        if len(words) < 2:
            return
        left, right = [], []
        for i, j in near_pairs(words, len(prefix)):
            left.append(i)
            right.append(j)
            if len(left) >= 200_000:
                yield out(words, counts, left, right)
                left, right = [], []
        yield out(words, counts, left, right)

    def out(words, counts, left, right):
        return pa.record_batch([pa.array([words[i] for i in left], pa.string()), pa.array([words[j] for j in right], pa.string()), pa.array([counts[j] for j in right], pa.int64())], names=["word", "near", "near_n"])

    held, words, counts = None, [], []
    for batch in batches:
        for prefix, word, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if prefix != held:
                yield from flush(held or "", words, counts)
                held, words, counts = prefix, [], []
            words.append(word)
            counts.append(n)
    yield from flush(held or "", words, counts)


def edits_at(words: DataFrame, start: int, stop: int) -> DataFrame:
    """(word, near, near_n): the near pairs whose words first differ at a place from `start` to before `stop`.

    With the letter at that place taken out of either word (replaced), or of the longer one only (inserted, deleted), they are equal."""
    at = words.select("word", "n", F.explode(F.sequence(F.lit(start), F.lit(stop - 1))).alias("i")).where("i <= char_length(word)")
    letter = F.expr("substring(word, i + 1, 1)")
    less = at.where("i < char_length(word)").select("i", F.expr("concat(substring(word, 1, i), substring(word, i + 2))").alias("key"), "word", "n", letter.alias("c"), F.lit(True).alias("cut"))
    whole = at.select("i", F.col("word").alias("key"), "word", "n", letter.alias("c"), F.lit(False).alias("cut"))
    # Only keys of more than one word are joined.
    keyed = less.union(whole).withColumn("h", F.xxhash64("i", "key"))
    shared = keyed.groupBy("h").agg(F.count_if("cut").alias("cuts"), F.count("*").alias("every")).where("every > 1 and cuts > 0").select("h")
    live = written(keyed.join(shared, "h"), "edits")
    a = live.select("i", "key", F.col("word").alias("x"), F.col("n").alias("xn"), F.col("c").alias("xc"), F.col("cut").alias("xcut"))
    b = live.select("i", "key", F.col("word").alias("y"), F.col("n").alias("yn"), F.col("c").alias("yc"), F.col("cut").alias("ycut"))
    pairs = a.join(b, ["i", "key"]).where("(xcut or ycut) and xc <> yc")
    return pairs.select(F.col("x").alias("word"), F.col("y").alias("near"), F.col("yn").alias("near_n"))


def near_words(vocab: DataFrame, most: int = MOST) -> DataFrame:
    """(word, near, near_n) for all pairs of words (word, n) at edit distance one, in both orders."""
    open_, depth, step, found, closed, letters = vocab, 0, 2, [], [], 0
    while True:
        keyed = open_.withColumn("prefix", F.substring("word", 1, depth))
        full = keyed.groupBy("prefix").agg(F.sum(F.char_length("word")).alias("size"), F.count("*").alias("k"))
        sizes = written(full.select("prefix", "k", "size", (F.col("size") > most).alias("large")), "prefixes")
        named = written(keyed.join(sizes.drop("size"), "prefix"), "trie")
        closed.append(named.where("not large and k > 1").select("prefix", "word", "n"))
        open_ = named.where("large").select("word", "n")
        whole = sizes.agg(F.sum(F.when(~F.col("large"), F.col("size"))), F.count_if("large")).first()
        letters += whole[0] or 0
        if not whole[1]:
            break
        found.append(edits_at(open_, depth, depth + step))
        depth, step = depth + step, step * 2
        open_ = open_.where(F.char_length("word") >= depth)
    below = closed[0]
    for part in closed[1:]:
        below = below.union(part)
    tasks = max(64, letters // most)
    walked = below.repartition(tasks, "prefix").sortWithinPartitions("prefix", "word").mapInArrow(walk_batches, "word string, near string, near_n long")
    for part in found:
        walked = walked.union(part)
    return walked


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): what following forms leads to. Pointers are doubled, so the rounds are the logarithm of a chain."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(at.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, least: int = LEAST_LENGTH, count: int = LEAST_COUNT, times: int = TIMES, every: int = EVERY, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary."""
    with Scope() as scope:
        vocab = written(vocabulary(docs, least, count, every), "vocabulary")
        near = near_words(vocab, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("top"))
        known = vocab.join(near, "word", "left").withColumn("fits", -F.col("top.less") >= times * F.col("n"))
        known = known.select("word", F.when(F.col("fits"), F.col("top.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("fits"), -F.col("top.less")).alias("form_n"))
        known = written(known, "forms")
        to = roots(known.where("form is not null").select("word", "form"))
        return scope.stay(written(known.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants"))
