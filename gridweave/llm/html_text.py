"""Main text of web pages: flat text blocks, the words and link density of each and of its neighbours, and a decision
tree trained on a small labelled table.

The table is made from the pages of ``html_pages``. Beside words and links the tree sees the kind of tag, whether a block
lies in an article, and how often the class and id names around it stand around text in the table. Names of an element
that holds the article itself count for nothing.

Scale: one pass, no shuffle; the tree is a few dozen numbers.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridweave.llm.html_pages import labelled_pages

# Elements whose content is no text, elements that part blocks, and those of these that can hold others.
DROPPED = "script style noscript template svg math head title iframe object canvas audio video select option button textarea datalist".split()
INLINE = "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split()
HOLDERS = "article main div section nav aside header footer form ul ol dl table tbody thead tr td th figure fieldset details dialog menu body blockquote".split()
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of HTML that end an svg or math around them.
_BREAKS = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 hr li listing menu ol p pre table ul".split())
# Of the dropped elements those whose content has no tags: they end at their end tag or with the page. What head can hold.
RAW = "script style title iframe textarea".split()
IN_HEAD = "base basefont bgsound link meta noframes noscript script style template title".split()

_TAG = re.compile(r"<(?:(?P<comment>!--)|(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)|[!?/])")
_STOP = re.compile("[>\"']")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"([^\s\"'/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: A name that begins with one of these tells what its element has, not what it is.
_HAVING = frozenset("has with without no not is js".split())
_INLINE, _HOLDERS, _DROPPED, _IN_HEAD = frozenset(INLINE), frozenset(HOLDERS), frozenset(DROPPED), frozenset(IN_HEAD)
#: Elements for other things than text, headings, and parts of tables with what they end and where that stops.
_OTHER, _HEADINGS = frozenset("nav aside footer form menu dialog".split()), frozenset("h1 h2 h3 h4 h5 h6".split())
_ENDS = {name: (frozenset(over.split()), frozenset(to.split())) for name, over, to in (("td", "td th", "table tr"), ("th", "td th", "table tr"), ("tr", "td th tr", "table"), ("tbody", "td th tr tbody thead", "table"), ("thead", "td th tr tbody thead", "table"))}
#: Words of a block from which on it is a paragraph; pages that are classified together.
_LONG, _TOGETHER = 15, 256


class Element:
    """An element of a page: its name, its class, id and role names in parts, the element that it is in, and what follows
    from all around it: whether it is for other things than text, whether it is in a list item, in the article, holds the
    article, and the least odds of the names around. ``plain`` counts words outside links in it."""

    __slots__ = ("name", "names", "parent", "marked", "item", "plain", "text", "parts", "outside", "framed", "article", "core", "low")

    def __init__(self, name: str, parent: Element | None = None, names: tuple[tuple[str, ...], ...] = (), marked: bool = False):
        self.name, self.names, self.parent, self.marked = name, names, parent, marked
        self.item = name in ("li", "dt", "dd") or (parent is not None and parent.item and parent.name != "")
        self.plain, self.text, self.parts, self.outside, self.framed, self.article, self.core, self.low = 0, 0, 0, False, False, False, False, 0.0


@dataclass
class Block:
    """A run of text between block tags, in the innermost element around it."""

    text: str
    words: int
    linked: int
    inner: Element

    @property
    def heading(self) -> bool:
        return self.inner.name in _HEADINGS

    @property
    def item(self) -> bool:
        return self.inner.item

    @property
    def marked(self) -> bool:
        return self.inner.marked

    @property
    def outside(self) -> bool:
        return self.inner.outside

    @property
    def article(self) -> bool:
        return self.inner.article

    @property
    def around(self) -> list[Element]:
        """The elements around it, the outermost first."""
        out, e = [], self.inner
        while e is not None:
            out.append(e)
            e = e.parent
        return out[::-1]


@lru_cache(1 << 14)
def _names(attrs: str) -> tuple[tuple[str, ...], ...]:
    """The parts of each class, id and role name among an element's attributes."""
    out = []
    for m in _ATTRIBUTE.finditer(attrs):
        if m[1].lower() in ("class", "id", "role"):
            for name in (m[2] or m[3] or m[4] or "").split():
                parts = tuple(p.lower() for p in _PARTS.findall(name))
                if parts and parts[0] not in _HAVING:
                    out.append(parts)
    return tuple(out)


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Begin, end, name, whether it is an end tag and attributes of each tag; comments and the like have no name. A tag
    ends at the first ``>`` outside quotes, or where a quote is not closed at the first one of all. Quotes from which no
    end was found are not tried again, so that a page of broken tags takes time in proportion."""
    at, last, failed = 0, page.rfind(">"), set()
    while tag := _TAG.search(page, at):
        begin, at = tag.span()
        if tag["comment"]:
            stop = page.find("-->", at)
            at = len(page) if stop < 0 else stop + 3
            yield begin, at, "", False, ""
            continue
        if at > last:
            continue
        name = (tag["name"] or "").lower()
        stop = page.find(">", at)
        if name:
            tried, here = [], at
            while (mark := _STOP.search(page, here)) and mark[0] != ">":
                here = mark.start()
                close = -1 if here in failed else page.find(mark[0], here + 1)
                tried.append(here)
                if close < 0:
                    mark = None
                    break
                here = close + 1
            if mark:
                stop = mark.start()
            else:
                failed.update(tried)
        attrs, at = page[at:stop], stop + 1
        yield begin, at, name, bool(tag["end"]), attrs


class _Dropped:
    """A dropped element that is open, and the elements open in it."""

    def __init__(self, name: str, block: str, held: Counter):
        self.name, self.block, self.held, self.inner = name, block, held, Counter()

    def ended(self, name: str, end: bool, attrs: str) -> str:
        """After one of its tags: "" if it goes on, "with" if it ends with the tag, "before" if the tag comes after it."""
        if end:
            if self.inner[name]:
                self.inner[name] -= 1
                return ""
            return "with" if name == self.name else "before" if self.held[name] or name in (self.block, "body", "html") else ""
        if name == "body" or (self.name == "head" and name not in _IN_HEAD and not self.inner.total()):
            return "before"
        if name == self.name and name in ("option", "button"):
            return "before"
        if self.name in ("svg", "math") and name in _BREAKS and not any(self.inner[n] for n in ("foreignobject", "desc", "annotation-xml", "mi", "mo", "mn", "ms", "mtext")):
            return "before"
        if name not in _VOID and not attrs.endswith("/"):
            self.inner[name] += 1
        return ""


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a whole page, in order."""
    page = page or ""
    out: list[Block] = []
    # All elements with a block of their own or around one, those around others first.
    elements: list[Element] = []
    stack: list[Element] = []
    held: Counter[str] = Counter()
    pieces: list[tuple[str, bool]] = []
    state = Element("")
    elements.append(state)
    # An open link: how deep the page was where it began, and whether it goes around blocks.
    link, depth, wraps = False, 0, False

    def closed() -> None:
        if not pieces:
            return
        text = "".join([p for p, _ in pieces])
        parts = (html.unescape(text) if "&" in text else text).split()
        if parts:
            linked = 0
            for p, inside in pieces:
                if inside:
                    linked += len((html.unescape(p) if "&" in p else p).split())
            out.append(Block(" ".join(parts), len(parts), min(len(parts), linked), state))
        pieces.clear()

    def ended(k: int) -> None:
        """Closes the elements from place ``k`` of the stack on."""
        held.subtract([e.name for e in stack[k:]])
        del stack[k:]

    at, dropped = 0, None
    for begin, stop, name, end, attrs in _tags(page):
        if begin < at:
            continue
        if dropped is None and begin > at:
            pieces.append((page[at:begin], link))
        at = stop
        if not name:
            continue
        foreign = dropped is not None and dropped.name in ("svg", "math")
        if name in _RAW_END and not end and not (foreign and attrs.endswith("/")):
            close = _RAW_END[name].search(page, at)
            over = page.find(">", close.end()) if close else -1
            at = over + 1 if over >= 0 else len(page)
            if dropped is None:
                pieces.append((" ", False))
            continue
        if dropped is not None:
            how = dropped.ended(name, end, attrs)
            if how:
                dropped = None
            if how != "before":
                continue
        if name in _DROPPED and not end:
            pieces.append((" ", False))
            if not (name in ("svg", "math") and attrs.endswith("/")):
                dropped = _Dropped(name, state.name, held)
            continue
        if name in _INLINE:
            if name == "a":
                link, depth, wraps = not end, len(stack), False
            elif name == "br":
                pieces.append((" ", False))
            continue
        # A link with no text before a block begins goes around it; others end with their block.
        if link and not end and not wraps:
            wraps = not any(inside and p.strip() for p, inside in pieces)
        closed()
        if end:
            if name in _HOLDERS and held[name]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].name == name:
                        ended(k)
                        break
            state = Element("", stack[-1] if stack else None)
        else:
            if name in _ENDS:
                # The parts of a table end those before them, whatever is open in these.
                over, to = _ENDS[name]
                if any(held[n] for n in over):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k].name in to:
                            break
                        if stack[k].name in over:
                            ended(k)
            own = () if name in ("body", "html", "article", "main") or not attrs else _names(attrs)
            state = Element(name, stack[-1] if stack else None, own, "data-main" in attrs)
            if name in _HOLDERS:
                stack.append(state)
                held[name] += 1
        elements.append(state)
        link = link and wraps and len(stack) >= depth
    if dropped is None:
        pieces.append((page[at:], link))
    closed()
    _find_core(out, elements)
    return out


def _summed(elements: list[Element], slot: str) -> None:
    """Adds each element's count to that of the element around it."""
    for e in reversed(elements):
        if e.parent is not None:
            setattr(e.parent, slot, getattr(e.parent, slot) + getattr(e, slot))


def _find_core(found: list[Block], elements: list[Element]) -> None:
    """Finds what is for other things, the article, and the elements that hold it. All is counted once for each element.

    A form or header around the page is not for other things: one that holds an article or main element with text, nine
    tenths of the words outside links, or half of them with a heading and three blocks. The article is the first group of article
    elements (or main ones) beside each other that is the only one with words outside links or has a third of the page's; of
    several those with a paragraph and a fifth of the words of the largest. What holds it, or holds the first paragraph and
    most of those words, is of the article whatever it is called."""
    plain = [b for b in found if 3 * b.linked < b.words]
    for b in plain:
        b.inner.text += b.words
        b.inner.parts += 1
        b.inner.framed = b.inner.framed or b.heading
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.text += e.text
            e.parent.parts += e.parts
            e.parent.framed = e.parent.framed or e.framed
    total = sum(b.words for b in plain)
    # Headers within an article are of it. ``low`` serves as a mark here: in an article or main element.
    holds = {id(e.parent) for e in elements if e.name in ("article", "main") and e.text and e.parent is not None}
    for e in reversed(elements):
        if id(e) in holds and e.parent is not None:
            holds.add(id(e.parent))
    inside: set[int] = set()
    for e in elements:
        up = e.parent
        if up is not None and (id(up) in inside or up.name in ("article", "main")):
            inside.add(id(e))
        own = e.name in _OTHER or (e.name == "header" and id(e) not in inside)
        if own and e.name in ("form", "header") and e.text:
            own = not (id(e) in holds or 10 * e.text >= 9 * total or (2 * e.text > total and e.framed and e.parts >= 3))
        e.outside = own or (up is not None and up.outside)

    plain = [b for b in plain if not b.outside]
    for b in plain:
        b.inner.plain += b.words
    _summed(elements, "plain")
    total = sum(b.words for b in plain)
    core: list[Element] = []
    for kind in ("article", "main"):
        groups: dict[int, list[Element]] = {}
        for e in elements:
            if e.name == kind and e.plain:
                groups.setdefault(id(e.parent), []).append(e)
        for group in groups.values():
            if not core and (len(groups) == 1 or 3 * sum(e.plain for e in group) >= total):
                most = max(e.plain for e in group)
                core = [e for e in group if len(group) == 1 or (e.plain >= _LONG and 5 * e.plain >= most)] or group
    for e in core:
        e.article = True
        while e is not None and not e.core:
            e.core = True
            e = e.parent
    for e in elements:
        e.article = e.article or (e.parent is not None and e.parent.article)
    first = next((b.inner for b in plain if b.words >= _LONG), None)
    while first is not None:
        first.core = first.core or 2 * first.plain > total
        first = first.parent


FEATURES = "words link_density words_before link_density_before words_after link_density_after place names heading item near_text".split()
#: Places: in an element that is for other things, beside the article, on a page that marks none, in the article.
PLACES = (-2.0, -1.0, 0.0, 1.0)
#: More words than these tell nothing more.
_MANY = 40.0


def _least_odds(inner: Element, odds: dict[str, float], known: dict[int, float]) -> float:
    """The least of the odds of the names around a block, 0 at most; parts of one name add up. Kept for each element."""
    chain, e = [], inner
    while e is not None and id(e) not in known:
        chain.append(e)
        e = e.parent
    least = known[id(e)] if e is not None else 0.0
    for e in reversed(chain):
        if e.names and not e.core:
            least = min(least, min(sum([odds.get(p, 0.0) for p in name]) for name in e.names))
        known[id(e)] = least
    return least


def pages_features(pages: list[list[Block]], odds: dict[str, float]) -> np.ndarray:
    """A row for each block of several pages; where a neighbour is missing it has no words and no links."""
    rows = []
    for number, found in enumerate(pages):
        elsewhere = PLACES[1 if any(b.inner.article and not b.inner.outside for b in found) else 2]
        known: dict[int, float] = {}
        for b in found:
            e = b.inner
            rows.append((number, b.words, b.linked, PLACES[0] if e.outside else PLACES[3] if e.article else elsewhere, _least_odds(e, odds, known), e.name in _HEADINGS, e.item))
    table = np.array(rows, float).reshape(-1, 7)
    page, words = table[:, 0], np.minimum(table[:, 1], _MANY)
    density = table[:, 2] / table[:, 1] if len(table) else table[:, 2]
    wide = lambda v: np.concatenate([np.zeros(3), v, np.zeros(3)])
    pages_wide, n = np.concatenate([[-1.0] * 3, page, [-1.0] * 3]), len(page)
    beside = lambda v, k: np.where(pages_wide[3 + k : 3 + k + n] == page, wide(v)[3 + k : 3 + k + n], 0.0)
    plain = np.where(density < 0.34, words, 0.0)
    near = np.max([beside(plain, k) for k in (-3, -2, -1, 1, 2, 3)], axis=0)
    return np.column_stack([words, density, beside(words, -1), beside(density, -1), beside(words, 1), beside(density, 1), table[:, 3:], near])


def block_features(found: list[Block], odds: dict[str, float]) -> np.ndarray:
    """The same for one page."""
    return pages_features([found], odds)


def name_odds(pages: list[list[Block]]) -> dict[str, float]:
    """For each part of a name around blocks of the table: the logarithm of text blocks to others, less that of all."""
    seen: dict[bool, Counter[str]] = {True: Counter(), False: Counter()}
    for b in (b for found in pages for b in found):
        seen[b.marked].update({p for e in b.around if not e.core for name in e.names for p in name})
    text, other = (sum(b.marked == kind for found in pages for b in found) for kind in (True, False))
    return {p: float(np.log((seen[True][p] + 0.5) / (seen[False][p] + 0.5) * other / text)) for p in sorted(seen[True] | seen[False])}


@cache
def labelled_table() -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """Features and labels of all blocks of the labelled pages, and the odds of names."""
    pages = [blocks(page) for page in labelled_pages()]
    odds = name_odds(pages)
    return np.vstack([block_features(found, odds) for found in pages]), np.array([b.marked for found in pages for b in found]), odds


@dataclass(frozen=True)
class Node:
    """A test of one feature (at most ``limit``: ``low``), or a leaf where ``low`` is None."""

    share: float
    feature: int = 0
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def shares(self, x: np.ndarray) -> np.ndarray:
        """The leaves' shares for the rows; branches that no row takes are not walked."""
        if self.low is None:
            return np.full(len(x), self.share)
        under = x[:, self.feature] <= self.limit
        if under.all():
            return self.low.shares(x)
        if not under.any():
            return self.high.shares(x)
        out = np.empty(len(x))
        out[under], out[~under] = self.low.shares(x[under]), self.high.shares(x[~under])
        return out


def grown(x: np.ndarray, y: np.ndarray, depth: int = 12, leaf: int = 12) -> Node:
    """A tree by Gini impurity; of equal splits the first feature and the lowest limit."""
    share = float(y.mean())
    best = (1e-9, 0, 0.0)
    if depth and 0 < share < 1:
        for k in range(x.shape[1]):
            order = np.argsort(x[:, k], kind="stable")
            v, ones = x[order, k], np.cumsum(y[order])
            n = np.arange(1, len(y))
            left, right = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
            gain = share * (1 - share) - (n * left * (1 - left) + (len(y) - n) * right * (1 - right)) / len(y)
            gain[(v[1:] == v[:-1]) | (n < leaf) | (len(y) - n < leaf)] = -1
            if len(gain) and gain.max() > best[0] + 1e-12:
                i = int(gain.argmax())
                best = (float(gain[i]), k, float((v[i] + v[i + 1]) / 2))
    if best[0] <= 1e-9:
        return Node(share)
    under = x[:, best[1]] <= best[2]
    return Node(share, best[1], best[2], grown(x[under], y[under], depth - 1, leaf), grown(x[~under], y[~under], depth - 1, leaf))


@dataclass(frozen=True)
class TextModel:
    """The tree and the odds of names."""

    tree: Node
    odds: dict[str, float]

    def main_texts(self, pages: list[str | None]) -> list[str]:
        """The kept blocks of each page, two newlines between them."""
        found = [blocks(page) for page in pages]
        keep = iter((self.tree.shares(pages_features(found, self.odds)) >= 0.5).tolist())
        return ["\n\n".join([b.text for b in own if next(keep)]) for own in found]

    def main_text(self, page: str | None) -> str:
        return self.main_texts([page])[0]


@cache
def text_model() -> TextModel:
    """The first tests are of the place, as pages that mark their article follow other rules than those that don't."""
    x, y, odds = labelled_table()
    k = FEATURES.index("place")
    grow = lambda place: grown(x[x[:, k] == place], y[x[:, k] == place])
    tree = grow(PLACES[0])
    for below, place in zip(PLACES[:-1], PLACES[1:], strict=True):
        tree = Node(float(y[x[:, k] <= place].mean()), k, (below + place) / 2, tree, grow(place))
    return TextModel(tree, odds)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of ``pages`` (page_id, url, html; other columns are
    ignored). Null or empty html and pages without text: "". A row for each row; nothing is cut."""
    model = text_model()

    def work(batches):
        for batch in batches:
            pages = batch["html"].to_pylist()
            texts = [t for k in range(0, len(pages), _TOGETHER) for t in model.main_texts(pages[k : k + _TOGETHER])]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")
