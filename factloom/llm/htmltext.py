"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one block element each. A line weighs the length of its text less twice that of
its links; lines of page furniture weigh less than nothing. Weights are summed over sliding windows of WINDOW
lines, ahead of a line and behind it. Text surges where the sums rise above zero and dives where they return to
it; what lies between is kept, whole: a lone link among paragraphs stays with them, a heading over a list of
links goes with the list, and a last paragraph after such a list stays.

Tags and class names are weights and borders of windows. A window does not reach into or out of marked
furniture, nor over the border of an <article> or <main>. Furniture (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments) that an element or a class name states outright weighs minus its length;
where a name only contains such a word (`related-work`), links count more and the sums decide. The text of an <article> counts ARTICLE times and that of <main> MAIN times when
the page's text is chosen among these and the rest. Nothing that surges is dropped for being short.
"""

from __future__ import annotations

import functools
import html as html_lib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

WINDOW = 3
#: What a text counts when it is stated to be the article, or the main part, against text outside.
ARTICLE, MAIN = 50, 25
#: What a character of a link costs, in and out of weakly marked elements.
WEAK_LINK, LINK = 4, 2

#: Comments, declarations, elements whose content is no markup, and tags.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|title|noscript|iframe|textarea|xmp|noframes)\b[^>]*>.*?(?:</\1\b[^>]*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""",
    re.S | re.I,
)
_FURNITURE = frozenset("nav footer aside form button select menu dialog".split())
_SKIPPED = frozenset("head svg math object canvas audio video template map".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_IN_HEAD = frozenset("base link meta title style script noscript template".split())
#: Start tags that end an open paragraph.
_END_P = _BLOCKS - frozenset("br option tbody td tfoot th thead tr caption body html legend summary".split())
#: element -> (open elements that its start tag ends, elements beyond which none is ended)
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "thead": (("tbody", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tr", "td", "th", "caption"), ("table",)),
    "option": (("option",), ("select",)),
    "a": (("a",), ("td", "th", "table")),
    "p": (("p",), ("button", "td", "th")),
}
#: What lies in a row or in a part of a table.
_CELLS = frozenset("tr td th caption".split())
#: Elements out of which a stray end tag does not reach.
_BARRIERS = frozenset("td th table caption button object template".split())
_TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
#: Elements that a class, id, role or label can mark.
_MARKED = frozenset("div section ul ol dl dd dt li p span table tr td article header figure h2 h3 h4 h5 h6 a details".split())
_NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden\b(?!\s*=\s*["']?until)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)
#: Words that name furniture.
_WORDS = re.compile(
    r"(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banners?|nav\w*|menus?|side-?bars?|footers?|masthead|topbar|bread-?crumbs?|cookies?|consent|gdpr|notices?|alerts?|pop-?ups?|modal|"
    r"newsletters?|subscribe|subscription|shar(?:e|ing)|social|related|recommend\w*|comments?|commentlist|respond|disqus|widgets?|login|signup|search|pagination|pager|contentinfo|complementary|tags|copyright|skip)",
    re.I,
)
#: Words that say nothing beside one that names furniture.
_NEUTRAL = re.compile(r"(?:\d+|main|site|page|global|top|bottom|left|right|primary|secondary|box|bar|block|list|item|items|link|links|container|wrapper|wrap|area|section|inner|outer|unit|slot|header|buttons?|form|panel|icons?|msg|message|policy|text|content|body|title|heading|label|overlay|group|row|col|posts?|entry|entries|articles?|blogs?|readers?|users?|story|stories|js|the|my)", re.I)


@functools.lru_cache(maxsize=4096)
def mark_of(names: str) -> int:
    """2 if a class name, id or role states furniture, 1 if one contains a word that names it, else 0."""
    mark = 0
    for name in names.split():
        if _WORDS.fullmatch(name):
            return 2
        parts = [p for p in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if p]
        named = [p for p in parts if _WORDS.fullmatch(p)]
        if named:
            if all(_WORDS.fullmatch(p) or _NEUTRAL.fullmatch(p) for p in parts):
                return 2
            mark = 1
    return mark


def _mark(name: str, attributes: str, in_article: bool) -> int:
    if name in _FURNITURE or (name == "header" and not in_article):
        return 2
    if not attributes or name not in _MARKED:
        return 0
    if _HIDDEN.search(attributes):
        return 2
    return max((mark_of(m.strip("\"'")) for m in _NAMES.findall(attributes)), default=0)


class _Open:
    """An open element: its mark, and whether it is skipped, a link, an article or a main part."""

    __slots__ = ("mark", "name", "stated")

    def __init__(self, name: str, mark: int, stated: bool):
        self.name, self.mark, self.stated = name, mark, stated


class Lines:
    """Lines of a page in order: texts, lengths, characters of links, marks, levels and borders.

    A level is 2 in an article, 1 in a main part and 0 elsewhere; lines of one border belong together.
    End tags may be missing wherever the start of another element or the end of the parent implies them.
    """

    def __init__(self, page: str):
        self.texts: list[str] = []
        self.links: list[int] = []
        self.marks: list[int] = []
        self.levels: list[int] = []
        self.borders: list[int] = []
        self._buffer: list[str] = []
        self._link = 0
        self._stack: list[_Open] = []
        self._n: Counter[str] = Counter()  # open elements by name
        self._strong = self._weak = self._skipped = self._border = 0
        at = 0
        for m in _TOKEN.finditer(page):
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            name = m[3]
            if name is None:
                continue
            name = name.lower()
            if m[2]:
                self._end(name)
            else:
                self._start(name, m[4])
        self._text(page[at:])
        self._line()

    def _text(self, raw: str) -> None:
        if self._n["head"] and not raw.isspace():  # text is not of the head: its end tag was left out
            self._pop_to("head")
        if self._skipped:
            return
        self._buffer.append(raw)
        if self._n["a"]:
            self._link += len(" ".join(html_lib.unescape(raw).split()))

    def _line(self) -> None:
        if self._buffer:
            text = " ".join(html_lib.unescape("".join(self._buffer)).split())
            self._buffer.clear()
            if text:
                self.texts.append(text)
                self.links.append(min(self._link, len(text)))
                self.marks.append(2 if self._strong else 1 if self._weak else 0)
                self.levels.append(2 if self._n["article"] else 1 if self._n["main"] else 0)
                self.borders.append(self._border)
            self._link = 0

    def _push(self, name: str, mark: int, stated: bool) -> None:
        self._stack.append(_Open(name, mark, stated))
        self._n[name] += 1
        self._count(mark, 1)
        if name in _SKIPPED:
            self._skipped += 1
        if mark or name in ("article", "main"):
            self._border += 1

    def _count(self, mark: int, by: int) -> None:
        self._strong += by * (mark == 2)
        self._weak += by * (mark == 1)

    def _pop_to(self, name: str) -> None:
        """Close elements up to the last open one of this name."""
        while self._stack:
            if self._stack[-1].name in _BLOCKS or self._stack[-1].mark:
                self._line()
            x = self._stack.pop()
            self._n[x.name] -= 1
            self._count(x.mark, -1)
            if x.name in _SKIPPED:
                self._skipped -= 1
            if x.mark or x.name in ("article", "main"):
                self._border += 1
            if x.name == name:
                return

    def _end(self, name: str) -> None:
        if name in _BLOCKS:
            self._line()
        if not self._n[name] or name in ("body", "html"):
            return
        for x in reversed(self._stack):
            if x.name == name:
                self._pop_to(name)
                return
            if x.name in _BARRIERS and not (name in _TABLE and x.name in _TABLE and x.name != "table"):
                return

    def _implied(self, ended: tuple[str, ...], beyond: tuple[str, ...]) -> None:
        """Close the outermost open element of `ended` that is not beyond one of `beyond`."""
        if not any(self._n[n] for n in ended):
            return
        many = 0
        for n, x in enumerate(reversed(self._stack), 1):
            if x.name in beyond:
                break
            if x.name in ended:
                many = n
                if x.name not in _CELLS or x.name == ended[0]:
                    break  # the others are inside it
        for _ in range(many):
            self._pop_to(self._stack[-1].name)

    def _start(self, name: str, attributes: str) -> None:
        if self._n["head"] and name not in _IN_HEAD and name != "head":
            self._pop_to("head")
        if name in _BLOCKS:
            self._line()
            if name in _END_P and self._n["p"]:
                self._implied(*_IMPLIED["p"])
        if name in _IMPLIED and name != "p":
            self._implied(*_IMPLIED[name])
        if name in _VOID or attributes.endswith("/"):
            return
        in_article = self._n["article"] + self._n["main"] > 0
        mark = _mark(name, attributes, in_article)
        if mark and name not in _BLOCKS:
            self._line()
        if name in ("article", "main") and not mark:
            # a named container of the article is no furniture
            for x in self._stack:
                if x.mark and not x.stated:
                    self._count(x.mark, -1)
                    x.mark = 0
        self._push(name, mark, name in _FURNITURE or name == "header")


def line_weights(lines: Lines) -> list[int]:
    """What each line adds to a window's sum."""
    out = []
    for text, link, mark in zip(lines.texts, lines.links, lines.marks, strict=True):
        n = len(text)
        out.append(-n if mark == 2 else n - WEAK_LINK * link if mark == 1 else n - LINK * link)
    return out


def window_sums(weights: list[int], borders: list[tuple], window: int = WINDOW) -> list[int]:
    """What the windows about each line sum up to; a window ends at a border.

    A line with weight takes the sum of the window that begins with it, or of the one that ends with it if
    that begins with text, too. A line without weight takes the lesser of both.
    """
    n = len(weights)
    run = list(itertools.accumulate(weights, initial=0))
    first, last = list(range(n)), list(range(n))  # of the lines with the same border
    for i in range(1, n):
        if borders[i] == borders[i - 1]:
            first[i] = first[i - 1]
    for i in range(n - 2, -1, -1):
        if borders[i] == borders[i + 1]:
            last[i] = last[i + 1]
    out = []
    for i, w in enumerate(weights):
        ahead = run[min(i + window, last[i] + 1)] - run[i]
        behind = run[i + 1] - run[max(i + 1 - window, first[i])]
        if w <= 0:
            out.append(min(ahead, behind))
        else:
            out.append(max(ahead, behind) if i > first[i] and weights[i - 1] > 0 else ahead)
    return out


def text_blocks(sums: list[int], borders: list[tuple]) -> list[tuple[int, int]]:
    """(surge, dive) places: runs of lines of one border whose sums are above zero."""
    out: list[tuple[int, int]] = []
    surge = None
    for i, s in enumerate(sums):
        if surge is not None and (s <= 0 or borders[i] != borders[surge]):
            out.append((surge, i))
            surge = None
        if surge is None and s > 0:
            surge = i
    if surge is not None:
        out.append((surge, len(sums)))
    return out


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The main text, its blocks joined by \\n; empty without text.

    White space (also no-break spaces) inside a block becomes one space. A page whose furniture is all its
    text has no main text.
    """
    if not page:
        return ""
    lines = Lines(page)
    borders = list(zip(lines.borders, lines.levels, lines.marks, strict=True))
    sums = window_sums(line_weights(lines), borders, window)
    blocks = text_blocks(sums, borders)
    mass = [0, 0, 0]
    for s, e in blocks:
        mass[lines.levels[s]] += sum(len(t) for t in lines.texts[s:e])
    worth = (mass[0], mass[1] * MAIN, mass[2] * ARTICLE)
    level = max(range(3), key=lambda k: (worth[k], k))
    return "\n".join(t for s, e in blocks if lines.levels[s] >= level for t in lines.texts[s:e])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of `pages` (page_id, url, html); other columns are ignored.

    Null and empty html give an empty text. Repeated rows are extracted alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
