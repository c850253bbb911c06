"""Main text of web pages by the maximum-scoring run of words and tags.

A page is a sequence of words and tags. A word scores the log odds, learnt from
labelled pages, that text in its surroundings (enclosing tags, class names, roles,
share of link text) is content; each tag costs a fixed amount. One linear scan finds
the contiguous stretch with the largest sum; blocks in it that score below zero,
such as adverts inside an article, are left out.

Surroundings that no labelled page shows have prior weights: a table of tags,
roles and common names, whose say ends where pages teach otherwise.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewell.llm.scratch import column, packed, unpacked


TAG_COST = 0.2
FOR, AGAINST = 2.0, 4.0  # bounds of the weight of one surrounding, and FOR of a word's score
BLOCK_COST = 20.0  # most that one block can count against a stretch
WRAPPED = 8  # tenths of a page's words from which an element wraps it
TAUGHT = 20  # words with a surrounding in labelled pages, from which its learnt weight counts

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
SILENT = frozenset("script style noscript template textarea select option datalist svg math canvas iframe object audio video head title button".split())
PLAIN = frozenset("html body div section center table tbody tr td ul ol li".split())
RAW = frozenset("script style textarea title".split())
ONLY_P = frozenset(["p"])
ITEMS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "tr": frozenset(["td", "th", "tr"])}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())

HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())  # what a head may hold

#: Elements that belong to a page but not to its article; what they hold isn't labelled as content.
NOT_ARTICLE = frozenset("nav aside footer form dialog menu".split())

#: Prior weights of surroundings: fixed values, by how often they hold content on the web at large.
PRIOR: dict[str, float] = {"<article>": 2.0, "<main>": 2.0, "<h1>": 1.0, "<h2>": 0.5, "<h3>": 0.5, "<p>": 0.5, "<header>": -1.0, "links:most": -1.5}
PRIOR |= {f"<{tag}>": -3.0 for tag in NOT_ARTICLE}
PRIOR |= {f"role:{role}": -3.0 for role in "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split()}
PRIOR |= dict.fromkeys("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo comment comments commentlist disqus reply replies respond cookie cookies consent gdpr newsletter subscribe subscription signup popup overlay".split(), -4.0)
PRIOR |= dict.fromkeys("promotion banner nav navbar navigation menu menubar sidebar aside footer header masthead topbar discussion notice notices alert modal share sharing social related recommended recommendations breadcrumb breadcrumbs widget toolbar login search pagination pager copyright skip".split(), -1.0)

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<[a-zA-Z/][^>]*(?:>|\Z)|[^<]+|<", re.S)
#: A tag's attributes one after another, so that none is looked for inside another's name or value.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|\"[^\"]*\"|'[^']*'")
SPACE = re.compile(r"[\s ]+")


@dataclass
class Block:
    text: str
    words: int
    links: str
    tags: int


@dataclass
class Element:
    """An open element: ``features`` and ``names`` count for what it holds unless it turns out to wrap the page."""

    tag: str
    features: frozenset
    names: frozenset
    silent: bool
    words: int = 0  # of the page before it, then in it
    marks: tuple[int, int] = (0, 0)  # main and article elements of the page before it, then in it

    def wraps(self, total: int) -> bool:
        """Whether it holds a main element, or is a form that holds an article or most of the page's words."""
        return self.marks[0] > 0 or self.tag == "form" and (self.marks[1] > 0 or 2 * self.words > total)

    def names_page(self, total: int, marks: list[int]) -> bool:
        """Whether its names are those of the whole page: it is or holds every article and main element, or, on a page without any, most words."""
        own = (self.tag == "main") + (self.tag == "article")
        return not self.silent and (sum(self.marks) + own == sum(marks) if sum(marks) else 10 * self.words > WRAPPED * total)


@dataclass
class Weights:
    prior: float = 0.5
    odds: dict = field(default_factory=dict)

    def of(self, feature: str) -> float:
        found = self.odds.get(feature)
        return PRIOR.get(feature, 0.0) if found is None else found


def _attributes(raw: str) -> tuple[list[str], bool]:
    """Names and role as features, and whether the element is hidden."""
    names, hidden = [], False
    for m in ATTRIBUTE.finditer(raw) if raw.strip() else ():
        key, value = (m[1] or "").lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            names += [n for n in re.split(r"[^a-z0-9]+", value) if n]
        elif key == "role":
            names.append(f"role:{value}")
        elif key == "style":
            hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            hidden = True
    return names, hidden


class Page:
    """One pass over a page: its blocks, and the elements that open and close between them, in order.

    Every step costs the same whatever the nesting: closing tags look only for
    elements that are open, and surroundings are counted as elements come and go.
    """

    def __init__(self, page: str) -> None:
        self.events: list[Element | Block | None] = []  # None closes the last open element
        self.stack: list[Element] = []
        self.open: Counter = Counter()
        self.silent = self.links = self.total = 0
        self.marks = [0, 0]
        self.parts: list[str] = []
        self.linked = self.tags = 0
        self._read(page)
        self._flush()
        while self.stack:
            self._pop()

    def _flush(self) -> None:
        text = SPACE.sub(" ", html.unescape("".join(self.parts))).strip() if self.parts else ""
        if text:
            density = self.linked / len(text)
            words = text.count(" ") + 1
            self.events.append(Block(text, words, "links:none" if not self.linked else "links:some" if density < 0.5 else "links:most", self.tags))
            self.total += words
            self.tags = 0
        self.parts, self.linked = [], 0

    def _push(self, tag: str, raw: str) -> None:
        names, hidden = _attributes(raw)
        own = [] if tag in INLINE or tag in PLAIN else [f"<{tag}>"]
        roles = [n for n in names if n.startswith("role:")]
        element = Element(tag, frozenset([*own, *roles]), frozenset(names) - frozenset(roles), tag in SILENT or hidden, self.total, (self.marks[0], self.marks[1]))
        if tag in ("main", "article") and not self.silent:
            self.marks[tag == "article"] += 1
        self.silent += element.silent
        self.links += tag == "a"
        self.open[tag] += 1
        self.stack.append(element)
        self.events.append(element)

    def _pop(self) -> None:
        element = self.stack.pop()
        self.open[element.tag] -= 1
        self.silent -= element.silent
        self.links -= element.tag == "a"
        element.words = self.total - element.words
        own = (element.tag == "main", element.tag == "article") if not element.silent else (0, 0)
        element.marks = (self.marks[0] - element.marks[0] - own[0], self.marks[1] - element.marks[1] - own[1])
        self.events.append(None)

    def _close(self, depth: int) -> None:
        while len(self.stack) > depth:
            self._pop()

    def _close_within(self, closed: frozenset) -> None:
        """Close the innermost of these elements if only inline ones and paragraphs are open in it."""
        if not any(self.open[t] for t in closed):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag in closed:
                self._close(i)
                return
            if self.stack[i].tag not in INLINE and self.stack[i].tag != "p":
                return

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            m = TOKEN.match(page, at)
            if m is None:
                return
            at = m.end()
            token, tag = m[0], (m[2] or "").lower()
            if not tag:
                if token[0] != "<" or token == "<":
                    if self.stack and self.stack[-1].tag == "head" and token.strip():
                        self._pop()
                    if not self.silent:
                        self.parts.append(token)
                        self.linked += len(token) if self.links else 0
                continue
            if not token.endswith(">"):
                return  # the page ends inside a tag
            self.tags += 1
            block = tag not in INLINE
            if m[1]:
                if block:
                    self._flush()
                if self.open[tag]:
                    depth = next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag == tag)
                    self._close(depth)
                continue
            if tag == "br":
                if self.stack and self.stack[-1].tag == "head":
                    self._pop()
                self.parts.append(" ")
                continue
            if block:
                self._flush()
            if self.open["head"] and (tag == "body" or self.stack[-1].tag == "head" and tag not in HEAD):
                self._close(next(i for i, e in enumerate(self.stack) if e.tag == "head"))
            if tag in CLOSES_P:
                self._close_within(ONLY_P)
            elif tag in ITEMS:
                self._close_within(ITEMS[tag])
            if tag in VOID or m[3].rstrip().endswith("/") and tag not in RAW and tag in INLINE:
                continue
            self._push(tag, m[3])
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
                self._pop()

    def walk(self) -> Iterator[tuple[str, bool, Block | None]]:
        """What comes, goes or is met in order: (surrounding, whether it comes, None) and ("", True, block).

        A surrounding comes with the outermost element that has it and goes with it.
        """
        held: Counter = Counter()
        opened: list[frozenset] = []
        for e in self.events:
            if isinstance(e, Block):
                yield "", True, e
            elif e is None:
                for f in opened.pop():
                    held[f] -= 1
                    if not held[f]:
                        yield f, False, None
            else:
                names = frozenset() if e.names_page(self.total, self.marks) else e.names
                opened.append(frozenset() if e.wraps(self.total) else e.features | names)
                for f in opened[-1]:
                    held[f] += 1
                    if held[f] == 1:
                        yield f, True, None


def scored(page: str, weights: Weights) -> list[tuple[str, float, float]]:
    """The page's text blocks in order, with the score of a word of each and of all its words and the tags before them."""
    out, around = [], weights.prior
    for feature, comes, block in Page(page).walk():
        if block is None:
            around += weights.of(feature) if comes else -weights.of(feature)
        else:
            word = min(FOR, around + weights.of(block.links))
            out.append((block.text, word, max(-BLOCK_COST, word * block.words - TAG_COST * block.tags)))
    return out


def learn(pages: list[str]) -> Weights:
    """Log odds of content by surroundings, in words, from pages that mark their article.

    Content is what an article or main element holds, less navigation, asides,
    footers, forms, dialogs and menus in it.
    """
    counts = (Counter(), Counter())  # words with a surrounding, in articles and elsewhere
    total = [0, 0]
    for page in pages:
        read = Page(page)
        if not sum(read.marks):
            continue
        marked = parted = 0
        since: dict[str, tuple[int, int]] = {}
        here = [0, 0]
        for feature, comes, block in read.walk():
            if block is not None:
                other = not marked or bool(parted)
                here[other] += block.words
                counts[other][block.links] += block.words
                continue
            step = 1 if comes else -1
            marked += step * (feature in ("<article>", "<main>"))
            parted += step * (feature[1:-1] in NOT_ARTICLE and feature[0] == "<")
            if comes:
                since[feature] = (here[0], here[1])
            else:
                first = since.pop(feature)
                for i in (0, 1):
                    counts[i][feature] += here[i] - first[i]
        for i in (0, 1):
            total[i] += here[i]
    if not total[0] or not total[1]:
        return Weights()
    odds = {}
    for f in {*counts[0], *counts[1]}:
        if counts[0][f] + counts[1][f] >= TAUGHT:
            value = math.log((counts[0][f] + 1) / (total[0] + 2)) - math.log((counts[1][f] + 1) / (total[1] + 2))
            odds[f] = max(-AGAINST, min(FOR, value))
    return Weights(0.5, odds)


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """The first shortest range of the largest positive sum; empty if there is none."""
    best, best_range, sum_, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if sum_ <= 0:
            sum_, start = 0.0, i
        sum_ += score
        if sum_ > best:
            best, best_range = sum_, (start, i + 1)
    return best_range


def main_text(page: str, weights: Weights) -> str:
    """Text of the best contiguous stretch without its blocks whose words score below zero; blocks by line breaks."""
    found = scored(page, weights)
    return "\n".join(text for text, word, _ in found[slice(*best_stretch([score for *_, score in found]))] if word > 0)


def _extract(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py() or "", weights) for page in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["rest", "text", "n_chars"])


def labelled_sample(pages: DataFrame, html_col: str, most: int) -> list[str]:
    """At most ``most`` different pages with an article or main element, by hash of the page.

    A threshold on the hash, from the number of different such pages, thins them out
    first, so that tasks send the driver little more than what it keeps.
    """
    marked = pages.select(F.col(html_col).alias("html")).where(F.col("html").rlike("(?i)<(article|main)[\\s>]"))
    slot = F.pmod(F.xxhash64("html"), F.lit(1 << 40))
    different = marked.agg(F.approx_count_distinct(slot)).first()[0]
    share = min(1.0, 4 * most / max(1, different))
    chosen = marked.where(slot < int(share * (1 << 40))).distinct()
    return [r.html for r in chosen.orderBy(F.xxhash64("html"), "html").limit(most).collect()]


def extract_text(pages: DataFrame, *, html_col: str = "html", training: DataFrame | None = None, sample: int = 400) -> DataFrame:
    """``pages`` without ``html_col``, with ``text`` and ``n_chars`` (code points).

    Weights are learnt from ``sample`` pages at most of ``training`` (by default
    the pages themselves) that mark their article. Character references are
    decoded, white space inside a block becomes one space, blocks are joined by a
    line break. A null or empty page, or one without content, gives an empty text.
    Repeated rows repeat; an empty table gives an empty result; other columns stay,
    except ones named text or n_chars, which are replaced.
    """
    weights = learn(labelled_sample(pages if training is None else training, html_col, sample))
    apart = (html_col, "text", "n_chars")
    rows = pages.select(packed(pages, *apart), column(html_col).alias("html"))
    schema = StructType([rows.schema["rest"], StructField("text", StringType()), StructField("n_chars", LongType())])
    return rows.mapInArrow(lambda it: _extract(it, weights), schema).select(*unpacked(pages, *apart), "text", "n_chars")
