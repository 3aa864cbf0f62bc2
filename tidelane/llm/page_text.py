"""Operator 12: the main text of web pages by text-to-tag ratios.

A page goes through the standard library's parser once, event by event. Block elements cut it into
lines; each line has its text, the number of its tags, and how much of it is link text. Its ratio is
the text outside links over the tags (at least one). Ratios are smoothed along the page by a
Gaussian, and the lines whose smoothed ratio reaches the standard deviation over the page are its core.

Core lines choose the regions. Where the page has article or main elements, these are the outermost
ones of them with a core line (all with text, if none has one). Elsewhere it is the innermost element
that holds nine tenths of the core's text; there, lines that are links only go unless they are core.
All lines of a region are kept, however short, but for those in parts that are never main text, core or not:

- elements: head, nav, menu, footer, aside, form and its controls, dialog, script, style, template, noscript, embedded media,
  header outside an article or main, and anything with the attribute hidden;
- roles such as navigation, banner, contentinfo, complementary, search, dialog or alert;
- class names and ids with a word for menus, sidebars, footers, headers, notices, adverts, forms, sharing or reader
  comments (HINTS, HINT_STARTS). They don't count on html, body and main; on a page without article and main that
  would be left without text they don't count at all.

A page that ends early keeps what it has. End tags close what they name and all within; a new paragraph closes the
open one, a list item, cell or row the one before it, and the first element that no head holds ends the head; main, and
article within an open nav, header or form, don't count as parts of those. Character references are decoded,
white space (as str.split() has it) within a line and line breaks become one space, lines are trimmed, empty ones dropped,
and joined by one line feed.

Nulls: a null page is empty and has an empty text. Repeated rows are repeated in the result; an empty
table gives an empty result; other columns are kept, but those named like a result column are replaced.
Pages of any length are parsed whole. Ties: of elements that hold as much of the core the innermost is taken.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelane.llm._shared import ship, slices, table

#: Width of the smoothing, in lines.
SIGMA = 1.0
#: Share of the core's text that a region holds on pages without article and main.
SHARE = 0.9

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr br img input".split()
)
NEVER = frozenset(
    "head nav menu footer aside form button select textarea datalist fieldset dialog script style template noscript iframe "
    "object canvas svg math video audio map title".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
HINTS = frozenset(
    "ad ads adsense adslot adbox adunit dfp promo promoted promotion outbrain taboola "
    "nav navbar navigation menu menus pagination pager toolbar skip "
    "aside rail widget widgets "
    "colophon copyright "
    "header masthead topbar "
    "notice notices alert consent gdpr banner popup modal overlay paywall toast "
    "search login signin signup subscribe "
    "disqus respond replies "
    "share sharing social related recommended".split()
)
HINT_STARTS = ("advert", "sponsor", "adsby", "breadcrumb", "sidebar", "footer", "cookie", "newsletter", "comment")
#: A header that belongs to the text it heads.
OWN_HEADER = frozenset("article entry post story content title".split())
#: All that a head holds; anything else ends it.
HEAD = frozenset("head title base link meta script style noscript template".split())
#: Elements whose end may be left out: what they end when they begin, unless that is outside of the given ones.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
_BEGUN = re.compile("<[A-Za-z/!?]")
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+|[0-9]+")


def hinted(value: str, inside: bool) -> bool:
    """Whether a class or id names a part that isn't main text; inside: within an article or main."""
    words = [w.lower() for w in _PARTS.findall(value)]
    for w in words:
        if w == "header":
            if not inside and not OWN_HEADER.intersection(words):
                return True
        elif w in HINTS or w.startswith(HINT_STARTS):
            return True
    return False


class Lines(HTMLParser):
    """Lines of a page, by parser events.

    Of each line: text, tags, linked (characters of link text), node (number of the innermost block
    element around it) and dropped (within a part that is never main text). Of each node: parent, and
    the last node within it; articles are the nodes of article and main elements in no other such.
    """

    def __init__(self, hints: bool):
        super().__init__(convert_charrefs=True)
        self.hints = hints
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.parent, self.last, self.articles = [-1], [0], []
        # (tag, node or -1 for inline, dropped, article, link) of the open elements.
        self.open: list[tuple[str, int, bool, bool, bool]] = [("", 0, False, False, False)]
        self.names: Counter[str] = Counter()
        self.text: list[str] = []
        self.tags = self.linked = 0

    def _end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                _, node, dropped, _, _ = self._block()
                self.lines.append((text, self.tags, self.linked, node, dropped or self.open[-1][2]))
                self.tags = 0
            self.text = []
        self.linked = 0

    def _block(self) -> tuple[str, int, bool, bool, bool]:
        return next(e for e in reversed(self.open) if e[1] >= 0)

    def _pop(self) -> None:
        tag, node, _, _, _ = self.open.pop()
        self.names[tag] -= 1
        if node > 0:
            self.last[node] = len(self.parent) - 1

    def _close(self, at: int) -> None:
        """Close the open elements from number at on."""
        if any(e[1] >= 0 for e in self.open[at:]):
            self._end_line()
        while len(self.open) > at:
            self._pop()

    def _imply(self, tag: str) -> None:
        """Close what the start of a block element ends without a tag of its own."""
        if self.names["head"] and tag not in HEAD:
            self._close(next(k for k, e in enumerate(self.open) if e[0] == "head"))
        if self.names["p"]:
            # The open paragraph, unless that is outside of the innermost block.
            k = next(k for k in range(len(self.open) - 1, -1, -1) if self.open[k][1] >= 0)
            if self.open[k][0] == "p":
                self._close(k)
        if tag in IMPLIED:
            ended, stop = IMPLIED[tag]
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] in ended:
                    self._close(k)
                    if tag != "tr":
                        break
                elif self.open[k][0] in stop:
                    break
        elif tag in ("main", "article"):
            least = next((k for k, e in enumerate(self.open) if e[0] in ("nav", "header") or (tag == "main" and e[0] in NEVER)), 0)
            if least:
                self._close(least)

    def _in_form_alone(self) -> bool:
        """Whether what drops the innermost element is a form around it."""
        first = next(k for k, e in enumerate(self.open) if e[2])
        return self.open[first][0] == "form" and all(e[0] not in NEVER for e in self.open[first + 1 :])

    def _never(self, tag: str, attrs: list[tuple[str, str | None]], article: bool) -> bool:
        """Whether an element that isn't within such a part begins one that is never main text."""
        if tag in ("html", "body", "main"):
            return False
        if tag in NEVER or (tag == "header" and not article):
            return True
        return any(
            name == "hidden" or (name == "role" and value in ROLES) or (name in ("class", "id") and self.hints and hinted(value or "", article))
            for name, value in attrs
        )

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        inline = tag in INLINE
        if not inline:
            self._end_line()
            if tag not in VOID:
                self._imply(tag)
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append("\n")
            return
        _, above, dropped, article, link = self.open[-1]
        main = tag in ("main", "article")
        if dropped and main and (tag == "main" or self._in_form_alone()):
            dropped = False
        dropped = dropped or self._never(tag, attrs, article)
        if main and not dropped:
            if not article:
                self.articles.append(len(self.parent))
            article = True
        node = -1
        if not inline:
            node = len(self.parent)
            self.parent.append(above if above >= 0 else self._block()[1])
            self.last.append(node)
        self.open.append((tag, node, dropped, article, link or tag == "a"))
        self.names[tag] += 1

    def parse_html_declaration(self, i: int) -> int:
        """Past a comment or declaration at i; one without an end takes the rest of the page."""
        comment = self.rawdata.startswith("<!--", i)
        end = self.rawdata.find("-->" if comment else ">", i + 2)
        return len(self.rawdata) if end < 0 else end + (3 if comment else 1)

    parse_comment = parse_html_declaration

    def parse_pi(self, i: int) -> int:
        return self.parse_html_declaration(i)

    def updatepos(self, i: int, j: int) -> int:
        return j  # no line numbers are needed

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # The slash means nothing but on elements that are void anyway.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append("\n")
        if not self.names[tag]:
            if tag not in INLINE:
                self._end_line()
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self._close(k)
                return
            if tag in INLINE and self.open[k][1] >= 0:
                return

    def handle_data(self, data: str) -> None:
        _, _, dropped, _, link = self.open[-1]
        if dropped and self.open[-1][1] < 0 and not self._block()[2]:
            return  # an inline part that isn't main text, within a line that is
        self.text.append(data)
        if link:
            self.linked += len(data)

    def close(self) -> None:
        super().close()
        self._close(1)
        self._end_line()
        self.last[0] = len(self.parent) - 1


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """ratio under a Gaussian; at the ends its weights within the page count as all."""
    reach = max(1, math.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratio, weights)[reach : reach + len(ratio)]
    return full / np.convolve(np.ones(len(ratio)), weights)[reach : reach + len(ratio)]


def core_lines(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Which lines reach the threshold, the standard deviation of the smoothed ratios."""
    if not len(ratio):
        return np.zeros(0, bool)
    level = smoothed(ratio, sigma)
    return (level >= level.std()) & (level > 0)


def _kept(page: Lines, sigma: float) -> list[str]:
    lines = page.lines
    ratio = np.array([0.0 if dropped else max(len(t) - linked, 0) / max(tags, 1) for t, tags, linked, _, dropped in lines])
    core = core_lines(ratio, sigma)
    node = np.array([n for _, _, _, n, _ in lines], np.int64)
    alive = np.array([not dropped for *_, dropped in lines], bool)
    core &= alive
    if page.articles:
        spans = [(a, page.last[a]) for a in page.articles]
        inside = [alive & (node >= a) & (node <= b) for a, b in spans]
        chosen = [m for m in inside if (m & core).any()] or inside
        kept = np.any(chosen, axis=0) if len(lines) else alive
    else:
        # The text of core lines in each element; elements come before those within them.
        mass = np.zeros(len(page.parent))
        np.add.at(mass, node[core], [len(lines[i][0]) for i in np.flatnonzero(core)])
        for k in range(len(mass) - 1, 0, -1):
            mass[page.parent[k]] += mass[k]
        top = max(np.flatnonzero(mass >= SHARE * mass[0]).tolist(), default=0) if mass[0] else 0
        links = np.array([linked >= len(t) for t, _, linked, _, _ in lines], bool)
        kept = alive & (node >= top) & (node <= page.last[top]) & (core | ~links)
    return [lines[i][0] for i in np.flatnonzero(kept)]


def main_text(html: str, sigma: float = SIGMA) -> str:
    """The main text of one page."""
    # A tag that the page's end cuts off is no text, nor is what follows its beginning.
    if cut := _BEGUN.search(html, html.rfind(">") + 1):
        html = html[: cut.start()]
    found: list[str] = []
    for hints in (True, False):
        page = Lines(hints)
        page.feed(html)
        page.close()
        found = _kept(page, sigma)
        if found or page.articles:
            break
    return "\n".join(found)


_NEW = ("text", "n_chars")


def extracted(pages: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """pages (html, other columns) with text and n_chars, without html."""
    ship(pages.sparkSession)
    own = [c for c in pages.columns if c not in (*_NEW, "html")]
    # Names of our own, as mapInArrow takes none with dots.
    rest = [f"own {i}" for i in range(len(own))]
    pages = pages.select(*[F.col(f"`{c}`").alias(r) for c, r in zip(own, rest)], "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("html")):
                part = batch.slice(a, b - a)
                texts = [main_text(h.as_py() or "", sigma) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in rest], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    names=[*rest, *_NEW],
                )

    kind = StructType([f for f in pages.schema if f.name != "html"])
    out = pages.mapInArrow(run, kind.add("text", "string").add("n_chars", "long"))
    return out.select(*[F.col(r).alias(c) for c, r in zip(own, rest)], *_NEW)


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
