"""Main text of web pages: flat text blocks, classified by a decision tree (after Kohlschuetter, Fankhauser, Nejdl, "Boilerplate
detection using shallow text features").

A page becomes a flat sequence of blocks, cut at block-level tags. A block has its word count and its link density (the share of its
words inside links), those of its two neighbours, and what its tags say: whether it is a heading, whether it is inside the article, and
whether it is in a menu, side, foot or form element or one that its class, id or role names so, or an advert, a notice or remarks (NAMES;
whole names only, so that "share-price" is none). A decision tree, grown by Gini impurity on the
labelled table PAGES, says which blocks are main text.

The article is what `article` elements hold, or `main` where a page has none; on pages with neither, all blocks are on a par. Elements
around an article (a form around the whole page, say) say nothing about what it holds; an article inside an article is a remark on it.
Scripts, styles and form controls have no blocks; all else that an element holds is text.

A tag whose quotes never close ends at the next `>`; after SPOILT such tags all the page's tags do. A tag or comment that never ends is
no text. Time is linear in a page's length but for SPOILT scans. Null html is empty and gives an empty text; pages of any length are
read whole; every row gives a result, repeated rows too; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
SPOILT = 50
# Fixed values of HTML. First those whose content is no markup, then those whose content is not shown as text.
RAW = frozenset("script style title textarea iframe noscript template".split())
MUTE = frozenset("button select option datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym audio b bdi bdo big button canvas cite code data datalist del dfn em font i img input ins kbd label mark math meter object option output picture progress q rp rt ruby s samp select small span strike strong sub sup svg time tt u var video wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("nav aside footer form dialog menu".split())
#: What the start of a tag ends if it is open.
CLOSES = {t: frozenset({"p"}) for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()} | {"li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"})}
#: Elements that such an end does not look beyond.
WALLS = frozenset("table ul ol dl article section div main body html nav aside header footer form td th".split())
CLOSING = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>|</{t}[^>]*\Z", re.IGNORECASE) for t in RAW}


LETTER = re.compile(r"[^\W_]")
ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
#: What an element's class, id or role may call it that is not of the text: as a whole name, or as the first part of one.
NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies footer menu nav navbar navigation newsletter notice popup promo promoted related remarks respond search share sharing sidebar social sponsor sponsored subscribe".split())
FIRST = frozenset("ad ads advert advertisement comment comments cookie cookies newsletter sidebar".split())


def has_letter(word: str) -> bool:
    return any(c.isalnum() for c in word)


def named_aside(attributes: str) -> bool:
    """Whether a tag's class, id or role says that it holds an advert, a notice, remarks or the like."""
    for m in ATTRIBUTE.finditer(attributes):
        for name in m[1].strip("\"'").lower().split():
            if name in NAMES or re.split("[-_]", name)[0] in FIRST:
                return True
    return False


@dataclass
class Block:
    text: str
    words: int = 0
    density: float = 0.0
    article: int = 0
    section: int = 0
    heading: int = 0
    main: bool = False


class Page:
    """Reads a page from its start to its end; `blocks` are what it has found."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        #: Text of the block at work, and whether it is inside a link.
        self.parts: list[tuple[str, bool]] = []
        #: Open elements, each with the count of sections around it; and how often each tag is open.
        self.stack: list[tuple[str, int]] = []
        self.open: Counter[str] = Counter()
        #: Elements open that say that their text is of a menu, side, foot, form or remark.
        self.sections = 0

    def text(self, raw: str) -> None:
        if raw and not any(self.open[t] for t in MUTE if t in self.open):
            self.parts.append((html.unescape(raw) if "&" in raw else raw, self.open["a"] > 0))

    def flush(self) -> None:
        words = " ".join("".join(t for t, _ in self.parts).split())
        if words:
            # Words are those with a letter or digit; one is linked if all of it is inside links, wherever it stands in the block.
            n = max(1, sum(map(has_letter, words.split(" "))))
            linked = sum(has_letter(w) for w in "".join(t if a else LETTER.sub("\0", t) for t, a in self.parts).split() if "\0" not in w) if any(a for _, a in self.parts) else 0
            heading = any(self.open[t] for t in HEADINGS)
            self.blocks.append(Block(words, n, min(1.0, linked / n), int(self.open["article"] > 0), int(self.sections > 0), int(heading), self.open["main"] > 0))
        self.parts.clear()

    def push(self, tag: str, aside: bool = False) -> None:
        self.stack.append((tag, self.sections))
        inside = self.open["article"]
        if tag == "article":
            self.sections = self.sections + 1 if inside else 0
        elif aside and tag not in ("html", "body", "main"):
            self.sections += 1
        elif tag == "main" and not inside:
            self.sections = 0
        elif tag in SECTIONS or tag == "header" and not inside:
            self.sections += 1
        self.open[tag] += 1

    def pop(self) -> str:
        tag, self.sections = self.stack.pop()
        self.open[tag] -= 1
        return tag

    def start(self, tag: str, attributes: str = "") -> None:
        closes = CLOSES.get(tag, frozenset())
        if any(self.open[t] for t in closes):
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth][0] in closes:
                    while len(self.stack) > depth:
                        self.pop()
                    break
                if self.stack[depth][0] in WALLS:
                    break
        self.push(tag, bool(attributes) and tag not in INLINE and named_aside(attributes))

    def end(self, tag: str) -> None:
        while self.open[tag] and self.pop() != tag:
            pass

    def read(self, page: str) -> list[Block]:
        at, spoilt, never = 0, 0, set()
        while (lt := page.find("<", at)) >= 0:
            self.text(page[at:lt])
            if page.startswith("<!--", lt):
                stop = page.find("-->", lt + 2)
                at = len(page) if stop < 0 else stop + 3
                continue
            if page.startswith(("<!", "<?"), lt):
                stop = page.find(">", lt)
                at = len(page) if stop < 0 else stop + 1
                continue
            m = TAG.match(page, lt) if spoilt < SPOILT else None
            if m:
                at, closing, tag, alone, said = m.end(), m[1], m[2].lower(), m[3].endswith("/"), m[3]
            elif m := NAME.match(page, lt):
                spoilt += 1
                stop = page.find(">", m.end())
                at, closing, tag, alone = len(page) if stop < 0 else stop + 1, m[1], m[2].lower(), False
                said = ""
            else:
                self.text("<")
                at = lt + 1
                continue
            if tag == "br":
                self.parts.append((" ", False))
            elif tag not in INLINE:
                self.flush()
            if tag in RAW:
                # What an element of raw text holds is passed over; one that never ends is passed over alone, but a script or style to the page's end.
                if not closing and not alone and tag not in never:
                    if stop := CLOSING[tag].search(page, at):
                        at = stop.end()
                    elif tag in ("script", "style"):
                        at = len(page)
                    else:
                        never.add(tag)
            elif closing:
                self.end(tag)
            elif tag not in VOID:
                self.start(tag, said)
        self.text(page[at:])
        self.flush()
        return self.blocks


def blocks_of(page: str) -> list[Block]:
    blocks = Page().read(page)
    if not any(b.article for b in blocks):
        for b in blocks:
            b.article = int(b.main)
    if any(b.article for b in blocks):
        for b in blocks:
            b.article = 1 if b.article else -1
    return blocks


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "section", "article")
#: The labelled table: pages, with @ between them. Each block's text begins with its label, + for main text and - for other.
PAGES = """
<nav><ul><li><a href="/">-Home</a><li><a href="/n">-News</a><li><a href="/c">-Contact us</a></ul></nav><div>-Save a third on boots until the end of May</div>
<article><h1>+The bridge at the old mill opens again</h1><p>+After two winters of work the stone bridge at the old mill was opened on Sunday. Several hundred people walked across it in the rain, and the band of the fire brigade played until noon.</p>
<p>+The arches had to be taken down one by one.</p><p>+Who paid?</p><p>+The town paid half of it, and the rest came from a fund for monuments, from lotteries and from the people of the valley, who had collected for eleven years.</p></article><footer>-&copy; The Valley Paper, all rights reserved</footer>
@
<div><a href="/">-Home</a></div><div><a href="/shop">-Shop</a></div><div><a href="/about">-About</a></div><div>-Free delivery for orders of more than thirty pounds</div>
<div><h1>+How to keep bees in a small garden</h1><p>+A hive needs less room than most people think. A corner of six feet by six is enough if the bees fly out over a hedge, so that they are well above the heads of those who pass.</p><p>+Start in spring.</p>
<p>+Buy one colony from a keeper near you, and ask to see it first. Look for brood in all its stages, for calm bees, and for a queen of this year or the last. A good keeper shows you all of that with pleasure.</p>
<p>+Read <a href="/feed">our page on feeding</a> before the first frost, because a colony that has too little to eat in autumn is seldom there in spring.</p></div><div>-Garden Letters, 4 Mill Lane, Ely, write to us if you keep bees too</div>
@
<div><a href="/">-Home</a> <a href="/a">News</a> <a href="/b">Shop</a> <a href="/c">Help</a> <a href="/d">Jobs</a></div>
<p>+It rained for nine days and then the river came over the wall. We carried the piano upstairs, which took six of us, and sat there with candles until the water went down again on the fourth evening.</p>
@
<div><a href="/">-Front page</a> | <a href="/a">Sport</a> | <a href="/b">Culture</a> | <a href="/c">Travel</a></div><h2>+A short walk round the lake</h2>
<p>+The path begins behind the station. It is flat for the first mile and then climbs through oaks to a meadow, from which you can see the whole of the lake and, on clear days, the hills beyond the border.</p><p>+Dogs are welcome.</p>
<p>+Allow three hours with a rest, and carry water, since the only inn on the way is closed on Mondays and in winter.</p><div><a href="/p">-Print</a> <a href="/m">Mail</a> <a href="/s">Save</a></div>
@
<ul><li><a href="/1">-Recipes</a><li><a href="/2">-Menus for two</a><li><a href="/3">-Wine</a></ul><h1>+Leek soup</h1><p>+Serves four.</p><ul><li>+three leeks<li>+one large potato<li>+a litre of stock</ul>
<p>+Cut the leeks into rings, wash them twice, and let them soften in butter for ten minutes without taking colour. Add the potato in cubes and the stock, and boil it all for a quarter of an hour.</p><p>+Then puree it, add cream, and season.</p>
<ul><li><a href="/4">-Onion soup</a><li><a href="/5">-Pea soup with mint</a><li><a href="/6">-Fish soup</a></ul><p>-Cooks and Co, London</p>
@
<header><a href="/">-The Harbour Gazette</a></header><article><h1>+Ferry stays in port</h1><p>+The evening ferry did not sail on Friday because of ice.</p><p>+Passengers were taken to the hotel at the pier, where the company paid for their rooms. <a href="/t">The timetable</a> for the weekend has not been settled, a speaker said.</p>
<aside>-Most read: fog on the coast road, new quay for the lifeboat</aside><p>+A storm is expected on Sunday.</p><section class="comments"><p>-They never sail when it matters, do they</p><p>-My aunt sat there for seven hours with nothing but tea and an old newspaper, and nobody told her a thing about it.</p></section></article><footer>-About us, terms, privacy</footer>
@
<article><h2>+Minutes of the spring meeting</h2><div class="cookie-notice"><p>-We use cookies to make this site better for you, read more or accept</p></div><p>+Present: nineteen members.</p><div class="ad">-Shoes at half price this week only</div>
<p>+The treasurer read the accounts, which were approved. The roof of the hut will be mended in June; volunteers should write to the secretary.</p><p>+Next meeting in autumn.</p></article>
@
<div><a href="/x">-Archive</a></div><div><a href="/y">-Search</a></div><div><a href="/z">-Sign in</a></div><h1>+On being late</h1><p>+I have been late for trains, weddings and once for my own party.</p><p>+It is not laziness. It is that I always believe there is time for one thing more, and so there is, and for the thing after that there is not, but by then I have begun it.</p>
<h3>+A cure</h3><p>+My sister sets her clocks forward. I know mine are wrong, so I add the minutes back, and leave later than before, with a good conscience and wet hair.</p><h3>-More from this author</h3><div><a href="/q">-On queues and those who stand in them</a></div><div><a href="/r">-On umbrellas</a></div>
@
<ul><li><a href="/1">-Storm closes the northern pass until Thursday</a><li><a href="/2">-Council votes on the new school</a><li><a href="/3">-Ten books for long evenings</a><li><a href="/4">-Where to swim this summer</a></ul><p>-Updated daily</p>
@
<table><tr><td><a href="/">-Start</a><td><a href="/m">-Members</a><td><a href="/l">-Links</a></table><table><tr><td>+The club was founded in 1921 by seven teachers who wished to row on Saturdays. They had one boat and no landing stage, and for ten years they carried the boat down through the orchard of the inn.</table><div>-Rowing Club, Lower Quay 3</div>
@
<div><a href="/">-Home</a></div><div><a href="/k">-Kitchen</a></div><div>-Our spring catalogue is here, ask for it today</div><h1>+Painting a door</h1><p>+<b>Painting a door in one day</b><br>can be done if the weather is dry.</p><p>+Sand it, wash it, let it dry.</p><p>+Use a small roller for the flat parts and a brush for the edges, and work from the top to the bottom so that you can catch the drops before they set.</p><p>+Wait.</p><p>+A second coat after six hours gives the best finish, and the handle can go on in the evening.</p><div>-Brush and Roller Ltd, 12 Canal Street, Leeds, open on weekdays</div>
@
<div><a href="/">-Start</a></div><div><a href="/f">-Forum</a></div><div>-Win a week by the sea</div><h1>+Owls</h1><p>+They hear better than they see.</p><div>-Site by Marsh and Daughters</div>
@
<div><a href="/">-Overview</a></div><div><a href="/g">-Galleries</a></div><div>-Half price on frames until Saturday night</div><h1>+Light in the north</h1><p>+Light in the north is never the same for long, and painters have gone there for two hundred years to see it change.</p><p>+Some stayed. They built huts with large windows, learned to fish, sent their pictures south by boat in autumn, and were paid, if at all, in spring, when the ice let the boats through again with letters and paint.</p><p>+It was a hard life.</p><div>-Printed in Bergen by Olsen</div>
@
<main><h1>+Opening hours</h1><p>+Monday to Friday, nine to five.</p><p>+On holidays the house is closed.</p></main><nav><a href="/">-Home</a></nav>
@
<form>-Name <input> Mail <input></form><p>+Dear friends, the concert of the third of May is moved to the church, since the hall has been without heating from the middle of April and will be until June.</p><p>+Tickets stay valid.</p><form>-Send us a message <input></form>
@
<p>+A single paragraph is all that some pages have, and it should be kept whether it is long or not.</p>
@
<h1>+Errata</h1><p>+On page nine, for mile read smile.</p><p>+On page forty the map is upside down.</p>
@
<article><h1>+Notes</h1><p>+See <a href="/1">the first part</a>.</p><p><a href="/2">+The second part of these notes</a></p><p>+None.</p><p>+What follows was written down on the train, without books, and is to be taken as it is.</p></article><p>-The writer lives in Kent with two dogs and has written nine novels and a book about gardens, which was read on the radio.</p><p>-Sign up for our letter and get it each Friday before breakfast</p>
@
<ul><li><a href="/">-Title</a><li><a href="/a">-Authors</a><li><a href="/b">-Shelves</a><li><a href="/c">-Rooms</a></ul><div>-Borrow six books and keep them all summer</div><h1>+The library moves to the old customs house</h1><p>+The library moves to the old customs house in March, and will be closed for two weeks.</p><p>+Books that are due in that time may be brought back later without a fine, and readers who need one for school can fetch it from the van, which stands at the market on Tuesdays and at the station on Thursdays.</p><p>+The cellar is dry.</p><div>-&copy; 2009 Town Library, open daily but Monday, from nine in the morning</div>
@
<ul><li><a href="/">-Weather</a><li><a href="/a">-Roads</a><li><a href="/b">-Fires</a></ul><div>-New tyres fitted while you wait, ring us</div><h1>+Snow down to the villages is expected for tonight and tomorrow</h1><p>+Drivers should keep to the main roads.</p><p>+Ploughs have been out since five in the morning, but the wind blows the snow back over the open stretch between the two farms, where a bus stood for an hour before a tractor came.</p><p>+More will fall by noon.</p><div>-Weather desk, Alpine Radio</div>
@
<ul><li><a href="/">-Chess</a><li><a href="/a">-Draughts</a><li><a href="/b">-Go</a><li><a href="/c">-Cards</a><li><a href="/d">-Dice</a></ul><div>-Boards and clocks at the lowest price in town.</div><h1>+A draw in fourteen moves</h1><p>+It was over before the coffee came.</p><p>+Both said that they had wanted to play on.</p><p>+The audience, some forty people who had paid for the evening, was not amused, and the organiser asked the two to play a second game at ten minutes each, which white won with a rook ending that will be in the books.</p><div>-The Chess Club meets on Wednesdays</div>
@
<ul><li><a href="/">-Map</a><li><a href="/a">-Huts</a><li><a href="/b">-Guides</a></ul><div>-Ropes, axes and boots to hire by the day or the week</div><h1>+The north face</h1><p>+The first to climb it were three brothers and their cousin, who had no map and one rope, and who were taken for smugglers when they came down on the other side.</p><div>-&copy; Alpine Section of the University, and of those who took the pictures</div>
@
<article><div><a href="/1">-Part one</a> <a href="/2">Part two</a> <a href="/3">Part three</a></div><h1>+Letters from the ice</h1><p>+We have been fast in the ice since Tuesday, and the dogs are glad of it.</p><p>+Write to my mother.</p><p><a href="/4">-Read on: the ship is given up</a></p><p><a href="/5">-Share this</a></p><p><a href="/6">-Print it out</a></p></article>
@
<article><h1>+Bread</h1><p>+Flour, water, salt and time.</p><p>+See <a href="/s">sourdough</a> too.</p><ul><li><a href="/7">-Rolls</a><li><a href="/8">-Pretzels and other things with lye</a></ul></article><div>-Bakers of the North</div>
@
<ul><li><a href="/">-Stamps</a><li><a href="/a">-Coins</a></ul><div>-Buy two and get one more for nothing</div><h1>+Found in a drawer</h1><p>+Three letters.</p><p>+They were never sent.</p><div>-&copy; Dealers in stamps and coins since 1931, catalogue sent on request, all rights reserved</div>
"""
NOTHING = Block("")


def examples() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of PAGES, as the reader finds them."""
    rows, labels = [], []
    for page in PAGES.split("\n@\n"):
        marked = blocks_of(page)
        labels += [int(b.text[0] == "+") for b in marked]
        rows += [features(marked, i) for i in range(len(marked))]
    return np.array(rows, float), np.array(labels)


def features(blocks: list[Block], i: int) -> tuple:
    b, before, after = blocks[i], blocks[i - 1] if i else NOTHING, blocks[i + 1] if i + 1 < len(blocks) else NOTHING
    return b.words, b.density, before.words, before.density, after.words, after.density, b.heading, b.section, b.article


#: Asked first, in this order: what tags say counts before what counts say.
TAGS = (("section", 0.5), ("article", -0.5), ("article", 0.5))


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, tags: tuple = TAGS):
    """A tree: a class, or (feature, threshold, tree at or below it, tree above). Ties go to the first feature and threshold."""
    if depth == 0 or len(set(y)) == 1:
        return int(y.mean() >= 0.5)
    if tags:
        (name, cut), *rest = tags
        low = x[:, FEATURES.index(name)] <= cut
        if low.all() or not low.any():
            return grow(x, y, depth, tuple(rest))
        return (FEATURES.index(name), cut, grow(x[low], y[low], depth, tuple(rest)), grow(x[~low], y[~low], depth, tuple(rest)))

    def impurity(part: np.ndarray) -> float:
        p = part.mean()
        return len(part) * 2 * p * (1 - p)

    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            score = impurity(y[low]) + impurity(y[~low])
            if best is None or score < best[0] - 1e-9:
                best = (score, f, cut, low)
    if best is None or best[0] > impurity(y) - 1e-9:
        return int(y.mean() >= 0.5)
    _, f, cut, low = best
    return (f, float(cut), grow(x[low], y[low], depth - 1, ()), grow(x[~low], y[~low], depth - 1, ()))


def classify(tree, row: tuple) -> int:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def main_text(page: str | None, tree) -> tuple[str, int, int]:
    """The main text, and how many blocks the page has and how many of them it is made of."""
    blocks = blocks_of(page or "")
    kept = [b.text for i, b in enumerate(blocks) if classify(tree, features(blocks, i))]
    return "\n".join(kept), len(blocks), len(kept)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, blocks, kept_blocks for each row of pages."""
    tree = grow(*examples())
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("blocks", pa.int32()), ("kept_blocks", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [main_text(x.as_py(), tree) for x in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1).cast(pa.string()), [t for t, _, _ in found], [len(t) for t, _, _ in found], [b for _, b, _ in found], [k for _, _, k in found]], schema=schema)

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long, blocks int, kept_blocks int")
