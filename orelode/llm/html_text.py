"""Main text of web pages: blocks are classified by stop words, length and links, then unsure ones by their neighbours."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.common import slabs, small_batches

#: Frequent function words of four languages (fixed values).
STOP_WORDS = frozenset(
    "a an and are as at be been but by for from had has have he her his i in into is it its not of on or our she so than that the their them then there these they this to was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer eines er es für hat haben ich ihr im in ist kann mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war werden wie wir wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle elles en est et être eux fait il ils je la le les leur leurs lui mais ne nous on ont ou où par pas plus pour qu que qui sa sans se ses son sont sur un une vous y "
    "al como con cuando de del desde el ella ellos en entre era es esta este esto fue ha hay la las le les lo los más me mi muy no nos o para pero por que se ser si sin sobre son su sus también todo un una uno y ya".split()
)
#: Elements that begin a new block (fixed values).
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is no text of the page (fixed values).
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select head".split())
#: Of these, what a page's end closes; the others, if never closed, are no such elements.
SWALLOWING = frozenset("script style textarea title".split())
#: Elements that hold no part of an article (fixed values).
APART = frozenset("nav header footer aside form menu dialog button fieldset".split())
#: Words in a class, id or role that say the same (fixed values).
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side nav navbar navigation navigate menu breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing social comment comments discussion disqus reply replies respond related recommended footer foot header masthead topbar widget pagination pager login search toolbar contentinfo complementary skip legal copyright disclaimer".split()
)
#: Of these, words of parts that may be articles themselves (fixed values): an article element within them isn't the page's.
STRONG_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion comment comments discussion disqus reply replies respond related recommended".split())
#: Words in a class, id or role of an element that holds the article (fixed values).
MAIN_WORDS = frozenset("article content main post entry story body articlebody maincontent postcontent".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Parts of a class name that turn such a word into a statement about the layout (fixed values): ``with-sidebar``, ``comment-free``.
LAYOUT_WORDS = frozenset("with has no not non without free layout".split())
#: What ends a sentence, in languages whose function words aren't known too (fixed values).
SENTENCE_ENDS = frozenset(".!?\u2026\u3002\uff01\uff1f\u0964\u061f")

#: Block rules: lengths in characters, densities as shares.
SHORT, LONG, LOW_STOPS, HIGH_STOPS, MOST_LINKS = 70, 200, 0.15, 0.25, 0.33
#: Blocks with a smaller share of function words, all taken together, are in a language that isn't known.
KNOWN_STOPS, KNOWN_WORDS = 0.08, 20
#: Marked elements that may be taken back, one in the other, where a page has no good block without them.
MOST_PEELS = 4

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What follows a tag's name up to its end; quoted values may hold ``>``. Possessive, so a tag is read once.
_REST = re.compile(r"(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+>")
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_COMMENT_END = re.compile(r"--!?>")
_PARTS = re.compile(r"[a-z]+", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ENDS: dict[str, re.Pattern[str]] = {}

GOOD, BAD, UNSURE = "good", "bad", "unsure"


@dataclass
class Block:
    apart: bool
    inside: bool
    #: The elements around the block that are apart by a weak word, outermost first (numbers in page order).
    marks: tuple[int, ...] = ()
    parts: list[str] = field(default_factory=list)
    links: int = 0
    text: str = ""
    words: int = 0
    stops: int = 0

    def close(self) -> None:
        self.text = " ".join(html.unescape("".join(self.parts)).split())
        words = self.text.lower().split()
        self.words, self.stops = len(words), sum(map(STOP_WORDS.__contains__, words))

    def label(self, known: bool = True) -> str:
        """What the block is by its length, links and function words; elements and marks that hold no article are judged before.

        Inside an article element a block is good if few of its letters are links and it has some function words, else unsure.
        Elsewhere link-dense blocks are bad, as are short ones that hold a link or a copyright sign; longer ones are good with many
        function words, unsure with some, bad with few. Where the language isn't known, longer ones are good if they
        hold a sentence's end and have few links.
        """
        size = len(self.text)
        links = self.links / max(1, size)
        stops = self.stops / max(1, self.words)
        if self.inside:
            return GOOD if links <= MOST_LINKS and (stops >= LOW_STOPS or not known and size > LONG) else UNSURE
        if links > MOST_LINKS:
            return BAD
        if size < SHORT:
            return BAD if links or "\u00a9" in self.text else UNSURE
        if not known:
            return GOOD if size > LONG and links <= MOST_LINKS / 2 and not SENTENCE_ENDS.isdisjoint(self.text) else UNSURE
        if stops >= HIGH_STOPS:
            return GOOD if size > LONG or links <= MOST_LINKS / 2 else UNSURE
        return UNSURE if stops >= LOW_STOPS else BAD


def _marks(attributes: str) -> tuple[bool, bool, bool]:
    """Whether a class, id or role says that the element is apart, that it is so by a strong word, and that it holds the article.

    A name with a word of APART_WORDS is apart, unless another part of it speaks of the layout.
    """
    apart = strong = main = False
    for m in _MARK.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = {p.lower() for p in _PARTS.findall(_CAMEL.sub(" ", name))}
            if parts & LAYOUT_WORDS:
                continue
            apart |= not parts.isdisjoint(APART_WORDS)
            strong |= not parts.isdisjoint(STRONG_WORDS)
            main |= not parts.isdisjoint(MAIN_WORDS)
    return apart, strong, main


@dataclass
class _Open:
    """An element that isn't closed yet, with what holds for all within it."""

    name: str
    apart: bool
    inside: bool
    marks: tuple[int, ...]
    #: The outermost apart element around it (itself at most).
    outer: _Open | None = None
    strong: bool = False
    #: Whether the element is closed after the articles in it (None: not asked yet).
    closes: bool | None = None


class _Reader:
    """One pass over a page: every character is looked at a bounded number of times, however the page is broken."""

    def __init__(self, page: str):
        self.page, self.blocks = page, []
        self.stack: list[_Open] = []
        self.open_names: dict[str, int] = {}
        self.now, self.link, self.n_marks = Block(False, False), 0, 0
        #: Names whose end isn't found from some place on, so needn't be looked for again.
        self.never: set[str] = set()
        self.places: dict[str, int] = {}
        self.quotes = True

    def text(self, piece: str) -> None:
        if piece:
            self.now.parts.append(piece)
            if self.link:
                self.now.links += len("".join(piece.split()))

    def cut(self) -> None:
        if self.now.parts:
            self.blocks.append(self.now)
        top = self.stack[-1] if self.stack else None
        self.now = Block(top.apart, top.inside, top.marks) if top else Block(False, False)

    def pop(self) -> None:
        name = self.stack.pop().name
        self.open_names[name] -= 1

    def tag_end(self, at: int) -> int:
        """The place after the tag whose name ends at ``at``; -1 without one.

        If quotes are never closed, they are no quotes from there to the page's end, so that the search fails only once.
        """
        if self.quotes:
            m = _REST.match(self.page, at)
            if m:
                return m.end()
            self.quotes = False
        return self.page.find(">", at) + 1 or -1

    def raw_end(self, name: str, at: int) -> int:
        if name in self.never:
            return -1
        if name not in _ENDS:
            _ENDS[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*>" + (r"|(?=<body\b)" if name == "head" else ""), re.I)
        m = _ENDS[name].search(self.page, at)
        if not m:
            self.never.add(name)
        return m.end() if m else -1

    def place(self, needle: str, at: int) -> int:
        """The first place of ``needle`` from ``at`` on (-1: none), for places asked in ascending order: nothing is searched twice."""
        known = self.places.get(needle, 0)
        if 0 <= known < at or needle not in self.places:
            known = self.places[needle] = self.page.find(needle, at)
        return known

    def encloses(self, element: _Open, at: int) -> bool:
        """Whether ``element`` is closed only after the article that begins at ``at``: if not, its end tag is missing."""
        if element.closes is None:
            e = self.place("</article", at)
            c = self.place(f"</{element.name}", max(e, at))
            again = self.place(f"<{element.name}", max(e, at))
            element.closes = e >= 0 and c >= 0 and not 0 <= again < c
        return element.closes

    def enter(self, name: str, attributes: str, at: int) -> None:
        if name == "p":  # a paragraph ends where the next begins
            while self.stack and self.stack[-1].name == "p":
                self.pop()
        article = name in ("article", "main")
        if article and self.stack and (outer := self.stack[-1].outer):
            # A form or page header may hold the article; so does a menu or sidebar whose end tag is missing.
            if name == "main" or not outer.strong and (outer.name in ("form", "header", "fieldset", "dialog") or not self.encloses(outer, at)):
                while self.stack and self.stack[-1].apart:
                    self.pop()
        top = self.stack[-1] if self.stack else None
        own = _Open(name, top.apart, top.inside, top.marks, top.outer) if top else _Open(name, False, False, ())
        says_apart, says_strong, says_main = _marks(attributes) if name not in ("body", "html") else (False, False, False)
        if article:
            own.inside, own.marks, says_apart = True, (), False
        if says_strong or name in APART and not (name == "header" and own.inside):
            own.apart, own.outer, own.strong = True, own.outer or own, says_strong
        elif says_apart:
            if len(own.marks) <= MOST_PEELS:
                own.marks = (*own.marks, self.n_marks)
            self.n_marks += 1
        elif says_main:
            own.inside = True
        self.stack.append(own)
        self.open_names[name] = self.open_names.get(name, 0) + 1

    def leave(self, name: str) -> None:
        if self.open_names.get(name):
            while self.stack[-1].name != name:
                self.pop()
            self.pop()

    def read(self) -> list[Block]:
        page, at = self.page, 0
        while (start := page.find("<", at)) >= 0:
            self.text(page[at:start])
            at = start
            if page.startswith("<!--", at):
                m = _COMMENT_END.search(page, at + 2)
                at = m.end() if m else len(page)
                continue
            if page.startswith("<![CDATA[", at):
                end = page.find("]]>", at)
                self.text(page[at + 9 : end if end >= 0 else len(page)])
                at = end + 3 if end >= 0 else len(page)
                continue
            closing = page.startswith("</", at)
            m = _NAME.match(page, at + 1 + closing)
            if not m:
                if page[at + 1 : at + 2] in ("!", "?", "/"):
                    at = page.find(">", at) + 1 or len(page)
                else:  # no tag, but a sign in the text
                    self.text("<")
                    at += 1
                continue
            end = self.tag_end(m.end())
            if end < 0:  # the page's end cuts the tag
                at = len(page)
                break
            attributes = page[m.end() : end - 1]
            at = self.tag(m[0].lower(), closing, attributes, start, end)
        self.text(page[at:])
        self.cut()
        for b in self.blocks:
            b.close()
        return [b for b in self.blocks if b.text]

    def tag(self, name: str, closing: bool, attributes: str, start: int, at: int) -> int:
        """Take in a tag from ``start`` to ``at``; where reading goes on."""
        if name in RAW and not closing:
            if name in BLOCKS:
                self.cut()
            if not attributes.endswith("/") or name not in ("svg", "math"):
                end = self.raw_end(name, at)
                return end if end >= 0 else len(self.page) if name in SWALLOWING else at
        elif name == "a":
            self.link = 0 if closing else 1
        elif name == "br":
            self.text("\n")
        elif name in BLOCKS:
            if closing:
                self.leave(name)
            elif name not in VOID:
                self.enter(name, attributes, start)
            self.link = 0
            self.cut()
        return at


def page_blocks(page: str) -> list[Block]:
    """The blocks of a page with their text: character references decoded, white space as single spaces, none empty.

    An element whose end is missing ends with the element around it. A tag that isn't closed at all goes with what follows it, as in a browser.
    """
    return _Reader(page).read()


def label_blocks(blocks: list[Block]) -> list[str]:
    """Good or bad for each block, in two passes.

    First each is labelled by itself (:meth:`Block.label`); those in apart or marked elements are bad. Then each unsure one takes
    the label of the nearest decided block before and after it: where they differ, the nearer one's, at equal distance the
    good one's if both are no further than one block. Inside an article element only blocks of that kind count as neighbours;
    an unsure block without any is good there and bad elsewhere.
    """
    long = [b for b in blocks if not b.apart and len(b.text) >= SHORT and b.links <= MOST_LINKS * len(b.text)]
    words = sum(b.words for b in long)
    known = words < KNOWN_WORDS or sum(b.stops for b in long) >= KNOWN_STOPS * words
    own = [b.label(known) for b in blocks]
    # Weak words in the markup only choose between texts: where nothing else is good, the marked element with most good text is taken back.
    taken: set[int] = set()
    for peeled in range(MOST_PEELS + 1):
        apart = [b.apart or not taken.issuperset(b.marks) for b in blocks]
        if peeled == MOST_PEELS or any(not a and (x == GOOD or x == UNSURE and b.inside) for b, x, a in zip(blocks, own, apart, strict=True)):
            break
        sizes: dict[int, int] = {}
        for b, x in zip(blocks, own, strict=True):
            rest = [m for m in b.marks if m not in taken]
            if x == GOOD and not b.apart and rest:
                sizes[rest[0]] = sizes.get(rest[0], 0) + len(b.text)
        if not sizes:
            break
        taken.add(max(sizes, key=lambda m: (sizes[m], -m)))
    first = [BAD if a else x for x, a in zip(own, apart, strict=True)]
    before: dict[bool, tuple[int, str] | None] = {True: None, False: None}
    following: dict[bool, tuple[int, str] | None] = {True: None, False: None}
    after: list[tuple[int, str] | None] = [None] * len(blocks)
    for i in range(len(blocks) - 1, -1, -1):
        after[i] = following[blocks[i].inside]
        if first[i] != UNSURE and not (blocks[i].inside and apart[i]):
            following[blocks[i].inside] = (i, first[i])
    out = []
    for i, (b, label) in enumerate(zip(blocks, first, strict=True)):
        if label == UNSURE:
            near = [n for n in (before[b.inside], after[i]) if n]
            if not near:
                label = GOOD if b.inside else BAD
            else:
                least = min(abs(i - n[0]) for n in near)
                nearest = {n[1] for n in near if abs(i - n[0]) == least}
                label = nearest.pop() if len(nearest) == 1 else GOOD if least <= 1 else BAD
        elif not (b.inside and apart[i]):
            before[b.inside] = (i, label)
        out.append(label)
    return out


def main_text(page: str | None) -> str:
    """The good blocks of a page (:func:`label_blocks`), joined by single spaces."""
    if not isinstance(page, str) or not page:
        return ""
    blocks = page_blocks(page)
    return " ".join(b.text for b, label in zip(blocks, label_blocks(blocks), strict=True) if label == GOOD)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page, from the whole html.

    Null or empty html, or html without a good block, gives an empty text. Tags that aren't closed, or that the page's end cuts,
    do no harm. Equal rows give equal rows; other columns are dropped.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slabs(frames, "html"):
            text = part["html"].map(main_text, na_action=None)
            yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": text, "n_chars": text.str.len().astype("int64")})

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
