"""Main-text extraction by minimum cut.

A page becomes a row of text blocks with their chain of open elements. A linear classifier gives each block a cost
of being called content and one of being called boilerplate: prose (length, a full stop, few links) speaks for
content, and so do article and main elements; tags, roles and class or id words of menus, adverts, notices and the
like speak against. A class or id, or a form, does so the less the more of the page's running text it holds: a wrapper
around everything says nothing, whatever its name. The costs are the capacities to the two terminals. Neighbouring blocks,
and blocks of one tag that follow each other under one parent, are joined by edges whose capacity falls with their
distance in the tree and with the difference of the voices against them. The maximum flow separates content from boilerplate, so a short line among paragraphs goes with them, and
one among menus does not.

A block is the text between two block-level tags; inside it, white space (Unicode's, and a line break) is one
space. Scripts, styles, templates, and hidden, input and media elements hold no text at all.

Defined results: a null or empty html gives the empty text, and so does a page of boilerplate only; plain
text without markup is one block of content; unclosed and stray tags, and pages that are cut off, are read
as far as they go; ties at the cut go to content; repeated rows are extracted each for itself; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

EXTRACTED = "page_id long, url string, text string, n_chars long"

# fixed values: element names and words of class, id and role
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul head title".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style template noscript head title button select option textarea input iframe object svg canvas audio video math noframes datalist".split())
BOILER_TAGS = frozenset("nav footer aside header menu dialog form".split())
CONTENT_TAGS = frozenset("article main".split())
ROLES = {"navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "form": -1, "dialog": -1, "alertdialog": -1, "alert": -1, "menu": -1, "menubar": -1, "toolbar": -1, "main": 1, "article": 1}
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login sidebar aside widget menu nav navbar navigation breadcrumb breadcrumbs pager pagination share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies discussion footer foot header masthead topbar copyright disclaimer toolbar search skip".split()
)
CONTENT_WORDS = frozenset("article content post entry story main body text articlebody postcontent maincontent".split())
STATE_WORDS = frozenset("no not non has have with without is open closed off on enabled disabled hide hidden show toggle active".split())  # beside them a word names no part of a page
PARENT_LESS = frozenset("p li dt dd option tr td th".split())  # a second one closes the first
_CUT_OFF = re.compile(r"<[!/?a-zA-Z]")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")


@dataclass
class Costs:
    """Weights of the classifier and of the edges."""

    base: float = -0.4
    tag: float = 7.0  # an element whose tag or role says boilerplate
    word: float = 6.0  # or a word of its class or id
    content: float = 2.5  # an element whose tag or role says content
    content_word: float = 1.0  # or a word
    outside: float = 3.0  # the page's text is in article or main elements, and the block is not
    links: float = 5.0  # times the share of link characters over 0.3
    prose: float = 2.0  # times the words over `full_words`, up to 1
    full_words: float = 25.0
    stop: float = 0.3  # the text ends like a sentence
    heading: float = 0.4
    lone: float = 0.5  # nothing on the page is prose: what no element speaks against is taken
    next_to: float = 3.0  # smoothness between neighbours
    sibling: float = 2.0  # and between followers under one parent


@dataclass
class Element:
    tag: str
    parent: "Element | None"
    depth: int
    silent: bool = False
    article: bool = False
    tag_against: bool = False
    word_against: bool = False
    tag_for: bool = False
    word_for: bool = False
    doubtful: bool = False  # a paragraph whose name says boilerplate, but only beside words that say something else
    chars: int = 0  # of running text inside
    against: float = 0.0  # the strongest voice among the element and those around it
    speaks_for: float = 0.0


@dataclass
class Block:
    parent: Element
    text: str = ""
    link_chars: int = 0
    heading: bool = False

    @property
    def chars(self) -> int:
        return max(1, len(self.text) - self.text.count(" "))


def is_prose(b: Block) -> bool:
    """A sentence of several words without links."""
    return b.text.count(" ") >= 5 and b.text[-1] in ".!?…»”\"'" and not b.link_chars


class Page(HTMLParser):
    """Blocks of a page, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", None, 0)
        self.at, self.link = self.root, 0
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.link_chars = 0
        self.elements = [self.root]

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.blocks.append(Block(self.holder(), text, self.link_chars, self.holder().tag in ("h1", "h2", "h3")))
            self.parts, self.link_chars = [], 0

    def holder(self) -> Element:
        e = self.at
        while e.tag and e.tag not in BLOCK_TAGS:
            e = e.parent
        return e

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID_TAGS:
            return
        if tag in PARENT_LESS:
            self.leave(tag, until=BLOCK_TAGS - PARENT_LESS)
        elif tag in BLOCK_TAGS:
            self.leave("p", until=BLOCK_TAGS - {"p"})
        up = self.at
        a = {k: v or "" for k, v in attrs}
        role = ROLES.get(a.get("role", "").strip().lower(), 0)
        hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
        e = self.at = Element(tag, up, up.depth + 1, up.silent or tag in SILENT_TAGS or hidden, up.article or tag in CONTENT_TAGS or role > 0)
        for name in (a.get("class", "") + " " + a.get("id", "")).split():
            words = {w.lower() for w in _WORD.findall(name)}
            if not words & STATE_WORDS:
                if words & BOILER_WORDS:
                    e.doubtful = tag == "p" and bool(words - BOILER_WORDS - CONTENT_WORDS) and (e.doubtful or not e.word_against)
                e.word_against |= bool(words & BOILER_WORDS)
                e.word_for |= bool(words & CONTENT_WORDS) and not words & BOILER_WORDS
        e.tag_for = tag in CONTENT_TAGS or role > 0
        e.tag_against = role < 0 or tag in BOILER_TAGS and not (tag == "header" and up.article)
        self.elements.append(e)
        self.link += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing on elements that are not void

    def leave(self, tag: str, until: frozenset = frozenset()) -> None:
        e = self.at
        while e.tag and e.tag != tag:
            if e.tag in until:
                return
            e = e.parent
        if e.tag:
            while self.at is not e.parent:
                self.link -= self.at.tag == "a"
                self.at = self.at.parent

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        if tag == "p" or tag in VOID_TAGS:
            self.leave(tag, until=BLOCK_TAGS - {"p"})
        elif tag in BLOCK_TAGS:
            self.leave(tag)
        else:
            self.leave(tag, until=BLOCK_TAGS)

    def handle_data(self, data: str) -> None:
        if not self.at.silent:
            self.parts.append(data)
            if self.link:
                self.link_chars += len("".join(data.split()))


    def weigh(self, c: Costs) -> None:
        """Count the running text of every element, and pass the voices for and against down the tree."""
        for b in self.blocks:
            b.parent.chars += max(0, b.chars - b.link_chars)
            if b.parent.doubtful and is_prose(b):
                b.parent.word_against = False  # what it says counts for more than what it is called
        for e in reversed(self.elements[1:]):
            e.parent.chars += e.chars
        whole = max(1, self.root.chars)
        self.in_article = sum(e.chars for e in self.elements[1:] if e.article and not e.parent.article) / whole
        for e in self.elements[1:]:
            part = min(1.0, 2.0 * (1.0 - e.chars / whole))
            if e.tag_against and not e.tag == "form":
                part = 1.0  # only a form, or a name, is ever put around a whole page
            e.against = max(e.parent.against, part * (c.tag if e.tag_against else c.word if e.word_against else 0.0))
            e.speaks_for = max(e.parent.speaks_for, c.content if e.tag_for else c.content_word if e.word_for else 0.0)


def balance(b: Block, page: Page, c: Costs) -> float:
    """How much cheaper it is to call the block content than boilerplate, by itself. The page is weighed."""
    words = b.text.count(" ") + 1
    score = c.base + c.prose * min(1.0, words / c.full_words) + c.stop * (b.text[-1] in ".!?…»”\"'") + c.heading * b.heading
    score -= c.links * max(0.0, b.link_chars / b.chars - 0.3)
    score += b.parent.speaks_for - b.parent.against
    if not b.parent.article:
        score -= c.outside * min(1.0, 2.0 * page.in_article)
    return score


def balances(page: Page, c: Costs) -> list[float]:
    """The balance of every block."""
    page.weigh(c)
    scores = [balance(b, page, c) for b in page.blocks]
    if scores and max(scores) < 0:
        scores = [c.lone if not b.parent.against and s > -1.0 else s for b, s in zip(page.blocks, scores, strict=True)]
    return scores


def distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def unlikeness(a: Element, b: Element) -> float:
    """Distance in the tree, and by how much one element's names speak against it more than the other's."""
    return distance(a, b) + abs(a.against - b.against) / 3


@dataclass
class Flow:
    """Maximum flow by blocking flows on level graphs; node 0 is the source, node 1 the sink."""

    n: int
    to: list[int] = field(default_factory=list)
    room: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.out: list[list[int]] = [[] for _ in range(self.n)]

    def edge(self, a: int, b: int, forth: float, back: float = 0.0) -> None:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [forth, back]

    def levels(self) -> list[int]:
        level = [-1] * self.n
        level[0] = 0
        queue = deque([0])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                b = self.to[e]
                if self.room[e] > 1e-9 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def source_side(self) -> list[bool]:
        """Run to the maximum; whether each node is not cut off towards the sink's side: ties count as source."""
        while (level := self.levels())[1] >= 0:
            nxt, path = [0] * self.n, []
            a = 0
            while True:
                if a == 1:
                    push = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= push
                        self.room[e ^ 1] += push
                    cut = next(i for i, e in enumerate(path) if self.room[e] <= 1e-9)
                    a = self.to[path[cut] ^ 1]
                    del path[cut:]
                elif nxt[a] < len(self.out[a]):
                    e = self.out[a][nxt[a]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[a] + 1:
                        path.append(e)
                        a = self.to[e]
                    else:
                        nxt[a] += 1
                elif path:
                    a = self.to[path.pop() ^ 1]
                    nxt[a] += 1
                else:
                    break
        reaches = [False] * self.n  # the sink can be reached from it
        reaches[1] = True
        queue = deque([1])
        while queue:
            b = queue.popleft()
            for e in self.out[b]:
                a = self.to[e]
                if self.room[e ^ 1] > 1e-9 and not reaches[a]:
                    reaches[a] = True
                    queue.append(a)
        return [not r for r in reaches]


def label(page: Page, c: Costs) -> list[bool]:
    """Whether each block is content."""
    blocks = page.blocks
    g = Flow(len(blocks) + 2)
    last_under: dict[tuple[int, str], int] = {}
    for i, (b, score) in enumerate(zip(blocks, balances(page, c), strict=True)):
        g.edge(0, i + 2, max(0.0, score)) if score >= 0 else g.edge(i + 2, 1, -score)
        if i:
            near = c.next_to / (1 + unlikeness(blocks[i - 1].parent, b.parent))
            g.edge(i + 1, i + 2, near, near)
        group = id(b.parent.parent or b.parent), b.parent.tag
        if (j := last_under.get(group, i)) < i - 1:
            far = c.sibling / (1 + unlikeness(blocks[j].parent, b.parent))
            g.edge(j + 2, i + 2, far, far)
        last_under[group] = i
    return g.source_side()[2:]


def parse(html: str | None) -> Page:
    page = Page()
    page.feed(html or "")
    if _CUT_OFF.match(page.rawdata):  # a tag or comment that never ends is no text
        page.rawdata = ""
    page.close()
    page.flush()
    return page


def extract(html: str | None, costs: Costs = Costs()) -> str:
    """Main text of a page."""
    page = parse(html)
    return "\n".join(b.text for b, keep in zip(page.blocks, label(page, costs), strict=True) if keep)


def extract_main_text(pages: DataFrame, costs: Costs = Costs(), page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [extract(h, costs) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    ship(pages.sparkSession)
    return pages.select(F.col(page_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInPandas(run, EXTRACTED)
