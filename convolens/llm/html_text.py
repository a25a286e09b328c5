"""Main text of web pages: parser events, text-to-tag ratio per line, smoothing, and regions above the threshold.

The parser's events become lines, one per block of text, each with the number of tags in it and the element it
lies in. A line's ratio is its letters per tag. Ratios are smoothed by a Gaussian over neighbouring lines; those
above the page's standard deviation cluster as content. Their letters choose the region: the page's article elements
together, or its main, if they hold nearly all of them, else the smallest element that holds every content line, the
headings before them and the paragraphs beside them; headings before an article are taken too. All of its lines are the text, short ones too, but for parts that the markup itself names as
something else: menus, headers, footers, sidebars, notices, adverts, forms, comments.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from convolens.llm import common as C

#: Elements that never hold article text.
APART = frozenset(
    "nav header footer aside form script style noscript template svg button select option textarea iframe object "
    "canvas dialog head title menu math audio video map datalist label fieldset input".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of a class or id that name such a part.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice "
    "notices notification alert gdpr sidebar aside comment comments commentlist disqus replies respond nav navbar navigation "
    "menu menubar breadcrumb breadcrumbs pagination pager footer header masthead topbar toolbar share sharing social related "
    "recommended recommendations newsletter subscribe subscription signup login popup modal overlay widget skip hidden".split()
)
_IN_ARTICLES = frozenset("ad advert advertisement comment comments promo related sponsored".split())
#: no-sidebar, with-footer and the like name what holds the article.
_NEGATED = frozenset("no without with has".split())
#: Elements that end a line.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
#: Elements that a paragraph within them does not end with.
_P_SCOPE = tuple("table caption td th button object template noscript svg math select audio video canvas".split())
_CELLS, _ROWS, _GROUPS = ("td", "th", "caption", "colgroup"), ("tr",), ("tbody", "thead", "tfoot")
#: Elements that end when the next of their kind starts: what ends, one after another, within the table around it.
_ENDS_IN_TABLE = dict.fromkeys(("td", "th"), (_CELLS,)) | {"tr": (_CELLS, _ROWS)} | dict.fromkeys((*_GROUPS, "caption", "colgroup"), (_CELLS, _ROWS, _GROUPS))
#: The same where nothing but inline markup, div, p and address lies between.
_ENDS_NEXT = {"li": (("li",),), "dd": (("dd", "dt"),), "dt": (("dd", "dt"),), "option": (("option",),), "optgroup": (("option",), ("optgroup",))}
_WALLS = (BLOCKS | APART) - {"address", "div", "p"}
#: An end tag of these says nothing of elements outside the table or list around it.
_LISTS = ("ul", "ol", "menu", "dir")
_WITHIN = {"p": _P_SCOPE, "li": _LISTS, "dd": ("dl",), "dt": ("dl",), "option": ("select", "datalist"), "optgroup": ("select",)} | dict.fromkeys((*_CELLS, *_ROWS, *_GROUPS), ("table",))
#: Elements that can be a region.
HOLDERS = frozenset("article main div section td body center blockquote".split())

_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPHS = frozenset("p pre".split())
#: What may stand between a heading and its text.
_RUNNING = _HEADINGS | _PARAGRAPHS | frozenset("address blockquote center div figcaption hgroup section".split())

_WORDS = regex.compile(r"[a-z]+").findall
_CAMEL = regex.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements named article or main with this share of the content letters are the region.
NEARLY_ALL = 0.85
_WEIGHTS = [math.exp(-d * d / 2) for d in range(3)]


def _apart(tag: str, attrs: list) -> bool:
    if tag in APART:
        return True
    if tag in ("main", "body", "html"):
        return False
    named = _IN_ARTICLES if tag == "article" else NAMED
    for name, value in attrs:
        if name in ("class", "id") and value:
            for one in value.split():
                words = _WORDS(_CAMEL.sub(" ", one).lower())
                if not named.isdisjoint(words) and _NEGATED.isdisjoint(words):
                    return True
        elif name == "role" and value:
            if value.lower() in ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
    return False


class Lines(HTMLParser):
    """Collects a page's lines: text, tags, the holder they lie in, and the block. Holder 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.kinds: list[str] = []
        self.parents = [0]
        self.names = ["page"]
        self._open: list[tuple[str, int, bool]] = []
        #: Where in _open each tag stands, where blocks do, and where those do that implied ends do not reach over.
        self._at: defaultdict[str, list[int]] = defaultdict(list)
        self._blocks: list[int] = []
        self._walls: list[int] = []
        self._holder = 0
        self._apart = 0
        self._text: list[str] = []
        self._tags = 0

    def _end_line(self) -> None:
        if self._text:
            words = "".join(self._text).split()
            if words:
                self.lines.append((" ".join(words), self._tags, self._holder))
                self.kinds.append(self._open[self._blocks[-1]][0] if self._blocks else "page")
            self._text.clear()
            self._tags = 0

    def _last(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost open element of these, or -1."""
        return max((self._at[tag][-1] for tag in tags if self._at[tag]), default=-1)

    def _close(self, k: int) -> None:
        """End the open element at place k, and all within it."""
        for place in range(len(self._open) - 1, k - 1, -1):
            tag, holder, apart = self._open.pop()
            self._at[tag].pop()
            for places in (self._blocks, self._walls):
                if places and places[-1] == place:
                    places.pop()
            if apart:
                self._end_line()
                self._apart -= 1
            self._holder = holder

    def _imply_ends(self, tag: str) -> None:
        """End the elements that end without an end tag where this one starts."""
        if tag in _ENDS_P and self._at["p"]:
            k = self._at["p"][-1]
            if k > self._last(_P_SCOPE):
                self._close(k)
        for kinds in _ENDS_NEXT.get(tag, ()):
            if self._walls and self._open[self._walls[-1]][0] in kinds:
                self._close(self._walls[-1])
        for kinds in _ENDS_IN_TABLE.get(tag, ()):
            k = self._last(kinds)
            if k > self._last(("table", "template")):
                self._close(k)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._end_line()
            self._imply_ends(tag)
        self._tags += 1
        if tag in VOID:
            return
        apart = _apart(tag, attrs)
        if apart and not self._apart:
            self._end_line()
        k = len(self._open)
        self._open.append((tag, self._holder, apart))
        self._at[tag].append(k)
        if tag in BLOCKS:
            self._blocks.append(k)
        if tag in _WALLS:
            self._walls.append(k)
        self._apart += apart
        if tag in HOLDERS:
            self.parents.append(self._holder)
            self.names.append(tag)
            self._holder = len(self.parents) - 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._end_line()
            self._imply_ends(tag)
        self._tags += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self._tags += 1
        k = self._last((tag,))
        if k < 0 or tag in _WITHIN and k < self._last(_WITHIN[tag]):
            return
        # The end of inline markup does not end the blocks around it.
        if tag not in BLOCKS and tag not in APART and self._blocks and self._blocks[-1] > k:
            return
        self._close(k)

    def handle_data(self, data: str) -> None:
        if not self._apart:
            self._text.append(data)

    def finish(self) -> None:
        self.close()
        self._end_line()


def smoothed(ratios: list[float]) -> list[float]:
    """Gaussian means over two lines to either side; at the ends over those that there are."""
    out = []
    n = len(ratios)
    for i in range(n):
        total = weight = 0.0
        for j in range(max(0, i - 2), min(n, i + 3)):
            w = _WEIGHTS[abs(i - j)]
            total += w * ratios[j]
            weight += w
        out.append(total / weight)
    return out


def content_lines(lines: list[tuple[str, int, int]]) -> list[bool]:
    """Lines whose smoothed ratio is not below the standard deviation of all; where none is, all."""
    ratios = smoothed([len(text) / max(1, tags) for text, tags, _ in lines])
    mean = math.fsum(ratios) / len(ratios)
    threshold = math.sqrt(math.fsum((r - mean) ** 2 for r in ratios) / len(ratios))
    flags = [r >= threshold for r in ratios]
    return flags if any(flags) else [True] * len(lines)


def _named(page: Lines, total: list[int]) -> list[int]:
    """The outermost article or main elements, if those of one name hold all content letters, else nearly all."""
    found = []
    for name in ("article", "main"):
        within = [False] * len(total)
        for h in range(1, len(total)):
            within[h] = within[page.parents[h]] or page.names[page.parents[h]] == name
        outer = [h for h in range(1, len(total)) if page.names[h] == name and not within[h]]
        # Parts of one article stand side by side; a short one goes with the others.
        beside = {page.parents[h] for h in outer if total[h]}
        found.append(([h for h in outer if page.parents[h] in beside], sum(total[h] for h in outer)))
    for share in (1, NEARLY_ALL):
        for holders, letters in found:
            if letters >= share * total[0]:
                return holders
    return []


def _with_headings(page: Lines, kept: list[bool]) -> list[bool]:
    """Also the headings before kept lines, with the running text between."""
    out = list(kept)
    for i in range(1, len(kept)):
        if kept[i] and not kept[i - 1]:
            first = i
            for j in range(i - 1, -1, -1):
                if kept[j] or page.kinds[j] not in _RUNNING:
                    break
                if page.kinds[j] in _HEADINGS:
                    first = j
            out[first:i] = [True] * (i - first)
    return out


def text_lines(page: Lines) -> list[bool]:
    """The lines of the page's text: those of its article or main elements, else of the smallest holder of the content."""
    content = content_lines(page.lines)
    at = [holder for _, _, holder in page.lines]
    total, end = [0] * len(page.parents), list(range(1, len(page.parents) + 1))
    for (text, _, holder), flag in zip(page.lines, content):
        total[holder] += len(text) * flag
    for h in range(len(total) - 1, 0, -1):
        total[page.parents[h]] += total[h]
        end[page.parents[h]] = max(end[page.parents[h]], end[h])
    inside = [False] * len(total)
    named = _named(page, total)
    for h in named:
        inside[h : end[h]] = [True] * (end[h] - h)
    if named:
        return _with_headings(page, [inside[h] for h in at])
    held = _with_headings(page, content)
    # Paragraphs beside held lines, in an element that holds both.
    for order, step in ((range(1, len(at)), -1), (range(len(at) - 2, -1, -1), 1)):
        for i in order:
            if held[i + step] and page.kinds[i] in _PARAGRAPHS and at[i] <= at[i + step] < end[at[i]]:
                held[i] = True
    first = min(h for h, flag in zip(at, held) if flag)
    last = max(h for h, flag in zip(at, held) if flag)
    while end[first] <= last:
        first = page.parents[first]
    return [first <= h < end[first] for h in at]


def extract(html: str | None) -> str:
    """The main text of one page."""
    page = Lines()
    page.feed(html or "")
    page.finish()
    if not page.lines:
        return ""
    return " ".join(text for (text, _, _), kept in zip(page.lines, text_lines(page)) if kept)


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id_col, the columns of `keep`, text: each page's main text, its blocks joined by one space.

    A null or empty page, and one without text outside the excluded parts, has an empty text. Rows are taken one
    by one. Unclosed and stray tags are taken as they come; a page without any markup is one line of text.
    """
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = C.text_bytes(batch.column(len(names)))[1]
            for a, b in C.pieces(sizes, 8 * C.PIECE):
                texts = [extract(h) for h in batch.column(len(names)).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(a, b - a) for k in range(len(names))], pa.array(texts, pa.string())], names=[*names, "text"])

    C.small_batches(pages)
    chosen = pages.select(*names, html_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{schema}, text string")
