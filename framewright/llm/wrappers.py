"""HTML extraction by union-free regular-expression inference.

Pages of one host share templates. A page is a tree of elements (tags with their first class or id
word) and text slots (``#text``); inline formatting is part of its text. A wrapper is a union-free
regular expression over such streams: sequences, optional groups ``(..)?`` and repeated groups
``(..)+``. It starts as one page's stream, in which adjacent equal squares become repeated groups, and
is aligned with each further stream of the host; mismatches become optional groups, and new squares
fold again. Every step only widens the language, so a host's wrapper matches all its pages.

A host's distinct folded streams are counted before they are gathered, and are merged in ``PARTS``
parts of a host first, so a host with a third of all pages sends one row per task and stream and one
wrapper per part.

Then each page is matched against its host's wrapper: an automaton over each element's children deals
them to the wrapper's groups, so every text of the page falls into one of its slots. Main text is what
falls into the content slots. These lie in the host's content element (an article, a main element, or an
element with a content class word, the first that the wrapper has; without any, the whole page), and
outside menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments. Inside the
content element, headings, paragraphs and other text elements are never taken for chrome by their names.
A slot that isn't a text element of the article and whose text is the same on all pages that fill it
is a constant of the template and dropped, if at least ``LEAST`` distinct articles and the ``SHARE``
of the host's distinct articles fill it; copies of an article count once.
"""

from __future__ import annotations

import hashlib
import html as html_codec
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import checkpointed

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?>[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp svg math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that never hold main text.
CHROME = frozenset(
    "nav header footer aside form script style noscript template iframe button select option textarea title head svg math menu dialog object canvas audio video map label input".split()
)
#: Words in a class, id or role that mark chrome.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side "
    "widget footer header masthead topbar cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup share sharing social "
    "comment comments disqus reply replies respond related recommended recommendations pagination pager toolbar search login alert disclaimer copyright legal complementary "
    "contentinfo skip hidden toc".split()
)
#: Those that mark adverts, on text elements too.
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsored".split())
#: Words that say nothing beside one that marks chrome.
PLAIN_WORDS = frozenset("box block container wrapper wrap inner outer area section list buttons button links link bar top bottom left right slot unit group item items icons holder panel".split())
#: Words that mark the content element where there is no article or main element.
CONTENT_WORDS = frozenset("article content main post entry story body text prose page".split())
CLOSES = {
    "p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "option": frozenset(["option"]), "head": frozenset(["body"]),
}
_FORMATTING = frozenset("a b i em strong u s small big span font code tt abbr cite q sub sup mark ins del kbd samp var time".split())
#: Elements that are text of an article by their kind.
TEXTUAL = HEADINGS | frozenset("p li dt dd td th tr blockquote pre figcaption caption".split())
LEAST, SHARE = 3, 0.9
#: Elements nested deeper than so many levels are text of the wrapper's last level; whether they are
#: chrome is still told from their own labels.
MAX_LEVELS = 200
#: Squares of up to so many groups become repeated groups.
MAX_SQUARE = 8
#: Parts in which a host's streams are merged first.
PARTS = 32
#: Wrappers of up to so many bytes are broadcast to their pages.
MAX_BROADCAST = 8 << 20
#: Marks at a label's end: hidden or an advert; a name that says nothing but chrome; one with a word of chrome.
HIDDEN, STRONG, WEAK = "^", "!", "~"


@lru_cache(1 << 14)
def _label(name: str, attributes: str) -> str:
    """An element's label: tag, first class or id word, mark. Ids of text elements mark nothing."""
    first, mark = "", ""
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), html_codec.unescape(m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            mark = HIDDEN
        elif key in ("class", "id", "role"):
            first = first or "-".join(re.findall(r"[a-z]+", value)[:2])
            if key == "class" or name not in TEXTUAL:
                for words in (re.findall(r"[a-z]+", x) for x in value.split()):
                    if CHROME_WORDS.intersection(words) and not set(words) - CHROME_WORDS - PLAIN_WORDS and words != ["header"]:
                        mark = HIDDEN if mark == HIDDEN or key == "class" and name not in HEADINGS and ADVERT_WORDS.intersection(words) else STRONG
                    elif not mark and CHROME_WORDS.intersection(words):
                        mark = WEAK
    return name + ("." + first if first else "") + mark


@lru_cache(1 << 14)
def _split(label: str) -> tuple[str, frozenset[str], str]:
    """(tag, name words, mark) of a label."""
    mark = label[-1] if label[-1] in (HIDDEN, STRONG, WEAK) else ""
    tag, _, first = label.removesuffix(mark).partition(".")
    return tag, frozenset(first.split("-")) - {""}, mark


class Page:
    """Elements in the order of their starts (0 is the page), with their children and texts.

    ``kids`` holds, for elements that are levels of the wrapper, their children: elements as their
    numbers, text as -1. ``level`` is the nearest such element, or the element itself."""

    def __init__(self) -> None:
        self.labels, self.parents, self.level, self.depth, self.kids = ["page"], [-1], [0], [0], [[]]
        self.texts: list[tuple[int, int, str]] = []

    def open(self, label: str, parent: int) -> int:
        at, level = len(self.labels), self.level[parent]
        tag, _, mark = _split(label)
        self.labels.append(label)
        self.parents.append(parent)
        if tag in _FORMATTING and not mark or self.depth[level] >= MAX_LEVELS:
            self.level.append(level)
            self.depth.append(self.depth[level])
            self.kids.append([])
        else:
            self.level.append(at)
            self.depth.append(self.depth[level] + 1)
            self.kids.append([])
            self.kids[level].append(at)
        return at

    def text(self, owner: int, block: int, raw: str) -> None:
        self.texts.append((owner, block, raw))
        if not raw.isspace():
            kids = self.kids[self.level[owner]]
            if not kids or kids[-1] != -1:
                kids.append(-1)

    def streams(self) -> list[Group | None]:
        """The stream of each element that is a level, as a group without repeats."""
        out: list[Group | None] = [None] * len(self.labels)
        for e in range(len(out) - 1, -1, -1):
            if self.level[e] == e:
                out[e] = Group(self.labels[e], tuple(TEXT if k < 0 else out[k] for k in self.kids[e]))
        return out


def parse(source: str) -> Page:
    """Reads a page leniently: implied ends are closed, unknown ends ignored, comments and raw text dropped."""
    page, block, at, size = Page(), 0, 0, len(source)
    stack, tags, blocks = [0], ["page"], [-1]  # open elements, their tags, and the place of the nearest block element
    opened: dict[str, list[int]] = {}

    def close(k: int) -> None:
        nonlocal block
        for i in range(len(stack) - 1, k - 1, -1):
            block += tags[i] in BLOCK
            if (places := opened[tags[i]]) and places[-1] == i:
                places.pop()
        del stack[k:], tags[k:], blocks[k:]

    while at < size:
        m = _TOKEN.search(source, at)
        end = m.start() if m else size
        if end > at:
            raw = source[at:end]
            page.text(stack[-1], block, html_codec.unescape(raw) if "&" in raw else raw)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            places = opened.get(name)
            if places and name in _FORMATTING and blocks[-1] > places[-1]:
                places.pop()  # it ends with the blocks that were opened in it
            elif places:
                close(places[-1])
            else:
                block += name in BLOCK
            continue
        if name in ("html", "body") and opened.get(name):
            continue
        if name in BLOCK:
            block += 1
            k, i = len(stack), blocks[-1]
            while i > 0:
                if name in CLOSES.get(tags[i], ()):
                    k = i
                elif tags[i] not in ("tr", "td", "th", "tbody"):
                    break
                i = blocks[i - 1]
            close(k)
        attributes = m[3] or ""
        if name in VOID or attributes.rstrip().endswith("/") and name not in BLOCK:
            if name == "br":
                page.text(stack[-1], block, " ")
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            at = stop.end() if stop else size
            continue
        opened.setdefault(name, []).append(len(stack))
        blocks.append(len(stack) if name in BLOCK else blocks[-1])
        stack.append(page.open(_label(name, attributes) if attributes else name, stack[-1]))
        tags.append(name)
    return page


class Group:
    """An element, a text slot (``#text``) or a sequence (label "") of a wrapper; ``card`` is "", "?",
    "+" or "*". Equal groups are one object."""

    __slots__ = ("label", "kids", "card", "sign")
    _known: dict[tuple, Group] = {}
    _merged: dict[tuple, Group] = {}
    _folded: dict[Group, Group] = {}

    def __new__(cls, label: str, kids: tuple[Group, ...] = (), card: str = "") -> Group:
        key = (label, kids, card)
        found = cls._known.get(key)
        if found is None:
            if len(cls._known) > 200_000:
                cls._known.clear()
                cls._merged.clear()
                cls._folded.clear()
            found = super().__new__(cls)
            found.label, found.kids, found.card = key
            found.sign = label or f"({','.join(k.sign for k in kids)})"
            cls._known[key] = found
        return found

    @property
    def optional(self) -> bool:
        return self.card in ("?", "*")

    @property
    def repeated(self) -> bool:
        return self.card in ("+", "*")

    def __str__(self) -> str:
        inner = "".join(map(str, self.kids))
        inner = "#text" if self.label == "#text" else f"<{self.label}>{inner}</{self.label}>" if self.label else inner
        return f"({inner}){self.card}" if self.card else inner

    def carded(self, optional: bool, repeated: bool) -> Group:
        return Group(self.label, self.kids, ("*" if optional else "+") if repeated else "?" if optional else "")


def merge(a: Group, b: Group, beside: bool = False) -> Group:
    """One group that covers two of one sign; ``beside``: they stand side by side."""
    key = (a, b, beside)
    found = Group._merged.get(key)
    if found is None:
        optional = a.optional and b.optional if beside else a.optional or b.optional
        kids = tuple(map(merge, a.kids, b.kids)) if not a.label else align(a.kids, b.kids)
        found = Group._merged[key] = Group(a.label, kids).carded(optional, a.label != "#text" and (beside or a.repeated or b.repeated))
    return found


def squares(kids: tuple[Group, ...] | list[Group]) -> tuple[Group, ...]:
    """The sequence with adjacent runs of equal signs as repeated groups."""
    out: list[Group] = []
    for kid in kids:
        out.append(kid)
        while _fold_end(out):
            pass
    return tuple(out)


def _fold_end(out: list[Group]) -> bool:
    n = len(out)
    for width in range(1, min(MAX_SQUARE, n - 1) + 1):
        last = out[n - width :]
        before = out[n - width - 1]
        if width > 1 and not before.label and len(before.kids) == width and all(x.sign == y.sign for x, y in zip(before.kids, last)):
            out[n - width - 1 :] = [Group("", tuple(map(merge, before.kids, last)), "+")]
            return True
        if n >= 2 * width and all(x.sign == y.sign for x, y in zip(out[n - 2 * width : n - width], last)):
            first = out[n - 2 * width : n - width]
            out[n - 2 * width :] = [merge(first[0], last[0], beside=True)] if width == 1 else [Group("", tuple(map(merge, first, last)), "+")]
            return True
    return False


def align(xs: tuple[Group, ...], ys: tuple[Group, ...]) -> tuple[Group, ...]:
    """Aligns two sequences by a longest common subsequence of signs; what one side lacks is optional."""
    if xs == ys:
        return xs
    a, b = [g.sign for g in xs], [g.sign for g in ys]
    if a == b:
        return squares(tuple(map(merge, xs, ys)))
    places: dict[str, int] = {}
    for i, sign in enumerate(a):
        places[sign] = places.get(sign, 0) | 1 << i
    rows, row = [], (1 << len(a)) - 1  # bit i of a row is 0 where one more group of xs can be matched
    full = row
    for sign in b:
        rows.append(row)
        hit = row & places.get(sign, 0)
        row = (row + hit | row - hit) & full
    rows.append(row)

    def common(i: int, j: int) -> int:
        return i - (rows[j] & (1 << i) - 1).bit_count()

    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            out.append(merge(xs[i - 1], ys[j - 1]))
            i, j = i - 1, j - 1
        elif not j or i and common(i - 1, j) >= common(i, j - 1):
            out.append(xs[i - 1].carded(True, xs[i - 1].repeated))
            i -= 1
        else:
            out.append(ys[j - 1].carded(True, ys[j - 1].repeated))
            j -= 1
    return squares(out[::-1])


TEXT = Group("#text")


def fold(group: Group) -> Group:
    """A stream with its squares as repeated groups, at every level."""
    found = Group._folded.get(group)
    if found is None:
        found = Group._folded[group] = Group(group.label, squares([fold(k) for k in group.kids])) if group.kids else group
    return found


def folded(page: Page) -> Group:
    """A page's stream as a wrapper of its own."""
    return fold(page.streams()[0])


_GROUP = re.compile(r"(\()(?=[<#(])|\)([?+*])|</[^>]*>|<([^>]*)>|#text")


def read_wrapper(text: str) -> Group:
    """The wrapper that ``str`` gave this text."""
    stack: list[tuple[str, list[Group]]] = [("", [])]
    for m in _GROUP.finditer(text):
        if m[1]:
            stack.append(("", []))
        elif m[2]:
            kids = stack.pop()[1]
            group = kids[0] if len(kids) == 1 and not kids[0].card else Group("", tuple(kids))
            stack[-1][1].append(Group(group.label, group.kids, m[2]))
        elif m[0] == "#text":
            stack[-1][1].append(Group("#text"))
        elif m[0].startswith("</"):
            label, kids = stack.pop()
            stack[-1][1].append(Group(label, tuple(kids)))
        else:
            stack.append((m[3], []))
    return stack[0][1][0]


_RULES = (lambda t, w: t == "article", lambda t, w: t == "main", lambda t, w: bool(w & CONTENT_WORDS) and t in ("div", "section", "td"))
#: The rank of pages without any content element.
WHOLE = len(_RULES)
OUT, IN, DROP = 0, 1, 2


def _starts(label: str, rank: int) -> bool:
    tag, words, mark = _split(label)
    return rank < WHOLE and (not mark or mark == WEAK and tag in ("article", "main")) and _RULES[rank](tag, words)


@lru_cache(1 << 16)
def step(state: int, label: str, rank: int, holds: bool = False) -> int:
    """The state of an element by its parent's: outside the content element, inside, or chrome.
    ``holds``: it holds a content element further down, so that a weak mark isn't one of chrome."""
    tag, _, mark = _split(label)
    if state == DROP:
        return DROP
    if tag not in ("html", "body", "page"):
        if mark == HIDDEN or tag in CHROME and not (state == IN and tag == "header" and not mark):
            return DROP
        if mark == STRONG and not (tag in TEXTUAL and (state == IN or tag in HEADINGS)):
            return DROP
        if mark == WEAK and state == OUT and tag not in TEXTUAL and tag not in ("article", "main") and not holds:
            return DROP
    return IN if state == IN or _starts(label, rank) else OUT


class Slot:
    """An element of a wrapper with its number, and the automaton over its children: positions are its
    text slots and elements in order, ``follow`` their successors."""

    def __init__(self, group: Group, number: list[int]):
        self.label, self.number = group.label, number[0]
        number[0] += 1
        self.labels: list[str] = []
        self.slots: list[Slot | None] = []
        self.follow: list[list[int]] = []
        self.first, last, self.nullable = self._sequence(group.kids, number)
        self.last = frozenset(last)
        self.dealt: dict[tuple[Group, ...], tuple[Slot | None, ...]] = {}
        self.fits: dict[Group, bool] = {}
        self.starts = tuple(_starts(self.label, r) or any(s is not None and s.starts[r] for s in self.slots) for r in range(WHOLE + 1))
        self.states = [OUT] * (WHOLE + 1)

    def _sequence(self, kids: tuple[Group, ...], number: list[int]) -> tuple[list[int], list[int], bool]:
        first, last, nullable = [], [], True
        for kid in kids:
            if kid.label:
                own = [len(self.labels)]
                self.labels.append(kid.label)
                self.follow.append([])
                self.slots.append(None)
                if kid.label != "#text":
                    self.slots[own[0]] = Slot(kid, number)
                begin, end, empty = own, own, False
            else:
                begin, end, empty = self._sequence(kid.kids, number)
            if kid.repeated:
                self._link(end, begin)
            empty = empty or kid.optional
            self._link(last, begin)
            first = first + begin if nullable else first
            last = last + end if empty else end
            nullable = nullable and empty
        return first, last, nullable

    def _link(self, ends: list[int], begins: list[int]) -> None:
        for p in ends:
            self.follow[p] += [q for q in begins if q not in self.follow[p]]

    def settle(self, states: list[int]) -> Slot:
        """Sets the states of this element and those below."""
        self.states = states
        for s in self.slots:
            if s is not None:
                s.settle([step(states[r], s.label, r, s.starts[r]) for r in range(WHOLE + 1)])
        return self

    def below(self) -> Iterator[Slot]:
        yield self
        for s in self.slots:
            if s is not None:
                yield from s.below()

    def accepts(self, group: Group) -> bool:
        """Whether an element's whole stream is in this element's language."""
        found = self.fits.get(group)
        if found is None:
            if len(self.fits) > 1000:
                self.fits.clear()
            found = self.fits[group] = self._match(group.kids) is not None
        return found

    def deal(self, kids: tuple[Group, ...]) -> tuple[Slot | None, ...]:
        """The slot of each child; children outside the wrapper's language are dealt by their labels."""
        found = self.dealt.get(kids)
        if found is None:
            if len(self.dealt) > 1000:
                self.dealt.clear()
            places = self._match(kids)
            if places is None:
                places = [self.labels.index(x.label) if x.label in self.labels else -1 for x in kids]
            found = self.dealt[kids] = tuple(self.slots[p] if p >= 0 else None for p in places)
        return found

    def _match(self, kids: tuple[Group, ...]) -> list[int] | None:
        steps: list[dict[int, int]] = []
        for k, kid in enumerate(kids):
            reached: dict[int, int] = {}
            for before, after in ((p, self.follow[p]) for p in steps[-1]) if k else ((-1, self.first),):
                for q in after:
                    if q not in reached and self.labels[q] == kid.label and ((own := self.slots[q]) is None or own.accepts(kid)):
                        reached[q] = before
            if not reached:
                return None
            steps.append(reached)
        if not steps:
            return [] if self.nullable else None
        at = next((p for p in sorted(steps[-1]) if p in self.last), None)
        if at is None:
            return None
        out = []
        for reached in reversed(steps):
            out.append(at)
            at = reached[at]
        return out[::-1]


@lru_cache(256)
def compiled(wrapper: str) -> Slot:
    return Slot(read_wrapper(wrapper), [0]).settle([OUT] * (WHOLE + 1))


def accepts(wrapper: str, page: Page) -> bool:
    """Whether the page's whole stream is in the wrapper's language."""
    return compiled(wrapper).accepts(page.streams()[0])


def matched(page: Page, wrapper: Slot) -> list[Slot | None]:
    """The wrapper's slot of each element; None for elements that aren't levels of it."""
    slots: list[Slot | None] = [None] * len(page.labels)
    slots[0], streams = wrapper, page.streams()
    for e, own in enumerate(slots):
        if own is not None and page.kids[e]:
            for k, s in zip(page.kids[e], own.deal(streams[e].kids)):
                if k >= 0:
                    slots[k] = s
    return slots


def page_states(page: Page, slots: list[Slot | None], rank: int) -> list[int]:
    states = [OUT] * len(page.labels)
    for e in range(1, len(states)):
        own = slots[e]
        states[e] = own.states[rank] if own is not None else step(states[page.parents[e]], page.labels[e], rank)
    return states


def _kept(state: int, rank: int) -> bool:
    return state == IN or rank == WHOLE and state == OUT


def content_rank(wrapper: Slot) -> int:
    """The first rule that names a content element with text slots outside chrome."""
    every = list(wrapper.below())
    return next((r for r in range(WHOLE) if any(s.states[r] == IN and "#text" in s.labels for s in every)), WHOLE)


def may_be_constant(slot: Slot, rank: int) -> bool:
    """Whether the slot's text may be a constant of the template: not the article's own text elements."""
    return "#text" in slot.labels and _kept(slot.states[rank], rank) and not (slot.states[rank] == IN and _split(slot.label)[0] in TEXTUAL)


def _blocks(page: Page, slots: list[Slot | None], rank: int, constants: frozenset[int]) -> str:
    states = page_states(page, slots, rank)
    if constants:
        dropped = [(s := slots[page.level[e]]) is not None and s.number in constants for e in range(len(states))]
    out: list[list[str]] = []
    last = None
    for owner, block, text in page.texts:
        if _kept(states[owner], rank) and not (constants and dropped[owner]):
            if block != last:
                out.append([])
                last = block
            out[-1].append(text)
    blocks = (" ".join("".join(parts).split()) for parts in out)
    return "\n".join(b for b in blocks if b)


def page_text(page: Page, slots: list[Slot | None], rank: int, constants: frozenset[int] = frozenset()) -> str:
    """The text in the content slots of the host's rank; a page that has none there is read by the other rules."""
    for r in dict.fromkeys([rank, *range(WHOLE + 1)]):
        text = _blocks(page, slots, r, constants) or (_blocks(page, slots, r, frozenset()) if constants else "")
        if text:
            return text
    return ""


def main_text(source: str | None, wrapper: str | None = None, constants: frozenset[int] = frozenset()) -> str:
    """The main text of a page under a wrapper (without one, under its own) and its constant slots."""
    if not source:
        return ""
    page = parse(source)
    top = compiled(wrapper or str(folded(page)))
    return page_text(page, matched(page, top), content_rank(top), constants)


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url):
    """The lower-case host of a URL column; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): one row per host, from all its pages."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams: dict[tuple[str, str], int] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = str(folded(parse(source or "")))
                streams[host, own] = streams.get((host, own), 0) + 1
            if streams:
                hosts, own = zip(*streams)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(own, pa.string()), pa.array(streams.values(), pa.int64())], names=["host", "stream", "n"])

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, wrapper, done = None, None, []
        for batch in batches:
            for own, stream in zip(zip(*(c.to_pylist() for c in batch.columns[:-1])), batch.columns[-1].to_pylist()):
                if own != key and wrapper is not None:
                    done.append((*key, str(wrapper)))
                    wrapper = None
                key, group = own, read_wrapper(stream)
                wrapper = group if wrapper is None else merge(wrapper, group)
        if wrapper is not None:
            done.append((*key, str(wrapper)))
        if done:
            names = ["host", "part", "wrapper"] if len(done[0]) == 3 else ["host", "wrapper"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "part" else pa.string()) for c, n in zip(zip(*done), names)], names=names)

    streams = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string")).mapInArrow(read, "host string, stream string, n long")
    streams = streams.groupBy("host", "stream").agg(F.sum("n").alias("n")).withColumn("part", F.pmod(F.xxhash64("stream"), F.lit(PARTS)).cast("int"))
    streams = streams.repartition("host", "part").sortWithinPartitions("host", "part", F.desc("n"), "stream").select("host", "part", "stream")
    parts = streams.mapInArrow(infer, "host string, part int, wrapper string").repartition("host").sortWithinPartitions("host", "part")
    return parts.select("host", "wrapper").mapInArrow(infer, "host string, wrapper string")


def hash_text(text: str) -> int | None:
    """A 63-bit hash; None for an empty text."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1 if text else None


def constant_slots(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, constants): the numbers of the constant slots, of hosts that have any. ``pages`` has host and html."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots_seen: dict[tuple[str, int], list[int]] = {}
            articles: set[tuple[str, int, int]] = set()
            for host, source, wrapper in zip(*(c.to_pylist() for c in batch.columns)):
                page, top = parse(source or ""), compiled(wrapper)
                slots, rank = matched(page, top), content_rank(top)
                if (article := hash_text(page_text(page, slots, rank))) is None:
                    continue
                articles.add((host, -1, article))
                texts: dict[int, list[str]] = {}
                for owner, _, text in page.texts:
                    s = slots[page.level[owner]]
                    if s is not None and may_be_constant(s, rank):
                        texts.setdefault(s.number, []).append(" ".join(text.split()))
                for number, found in texts.items():
                    if (h := hash_text("\n".join(t for t in found if t))) is not None:
                        lo, hi = slots_seen.get((host, number), (h, h))
                        slots_seen[host, number] = (min(lo, h), max(hi, h))
                        articles.add((host, number, article))
            rows = [(h, s, None, *v) for (h, s), v in slots_seen.items()]
            rows += [(*x, None, None) for x in articles if x[1] < 0 or slots_seen[x[:2]][0] == slots_seen[x[:2]][1]]  # a slot whose text differs is no constant
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.string(), *[pa.int64()] * 4])], names=["host", "slot", "article", "lo", "hi"])

    @F.udf("boolean")
    def variable(wrapper):  # a row for each host
        top = compiled(wrapper)
        return any(may_be_constant(s, content_rank(top)) for s in top.below())

    asked = checkpointed(wrappers.filter(variable("wrapper")))
    seen = _with_wrappers(pages, asked, "inner").select("host", "html", "wrapper").mapInArrow(read, "host string, slot long, article long, lo long, hi long")
    seen = checkpointed(seen.groupBy("host", "slot", "article").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    held = seen.filter("article IS NOT NULL").groupBy("host", "slot").agg(F.count("*").alias("articles"))
    every = held.filter("slot < 0").select("host", F.col("articles").alias("every"))
    equal = seen.filter("article IS NULL AND lo = hi").select("host", "slot")
    constant = held.filter(f"articles >= {LEAST}").join(equal, ["host", "slot"]).join(every, "host").filter(f"articles >= {SHARE} * every")
    return constant.groupBy("host").agg(F.sort_array(F.collect_set("slot")).alias("constants"))


def _with_wrappers(pages: DataFrame, wrappers: DataFrame, how: str) -> DataFrame:
    """Pages with their hosts' rows, which are broadcast if they are small; else joined by host, where
    a hot host's pages can be split, as it has one row."""
    size = wrappers.agg(F.sum(F.octet_length("host") + F.octet_length("wrapper") + 64)).first()[0] or 0
    return pages.join(F.broadcast(wrappers) if size <= MAX_BROADCAST else wrappers, "host", how)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page, from the content slots of its host's wrapper.

    Null or empty html gives an empty text; pages without a host share one wrapper. Broken markup
    is read as far as it goes, however long or deep. Null ids are carried, repeated rows stay rows,
    extra columns are not read, and an empty table gives none.
    """
    wrappers = checkpointed(infer_wrappers(pages))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    wrappers = checkpointed(wrappers.join(constant_slots(rows.select("host", "html"), wrappers), "host", "left"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, w, frozenset(c or ())) for h, w, c in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = _with_wrappers(rows, wrappers, "left").select("page_id", "url", "html", "wrapper", "constants")
    return rows.mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
