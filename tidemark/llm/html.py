"""Main text of web pages: parser events, text-to-tag ratio of lines, Gaussian smoothing, threshold clustering.

The standard library's parser streams events; block elements end lines. A line has its text, the characters of it that
lie outside links, the number of tags met in it, and the element it lies in. Only elements that never hold text of a
page (scripts, styles, form controls and the like) are left out; menus, headers, footers, notices, adverts and comments
of readers are lines like all others.

1. The ratio of a line is its characters outside links over its tags. Ratios are smoothed over neighbouring lines by a
   Gaussian; lines that reach half the mean form the clusters.
2. The content region is the element that the clusters point to: the ``article`` or ``main`` that holds at least half
   of the clustered text, else the innermost container that holds half of the clusters, by the mean of its shares of
   their characters and of their lines. A ``section`` beside others that hold clusters stands for all of them: then the
   region is what they lie in. If that is the whole body, the region is the run of lines from the first cluster to the
   last one.
3. All lines of the region are content, so a short paragraph between long ones is kept, but for those in an element
   inside the region that is named as boilerplate (``nav``, ``footer``, a class ``comments``, ...). Headings of the
   first two ranks right before the region belong to it.

Names weigh, they do not decide: a line in an element named as boilerplate counts a sixteenth in ratios and masses, one
in ``article`` or ``main`` sixteen times. So a page whose every element is named oddly still has its text, and short
articles win over long footers.

Defined results: null or empty html, and pages without text, give the empty text. If no text lies outside links, links
count as text. Unclosed and stray tags are tolerated in time linear in the page. White space (Unicode) inside a line
becomes one space. Repeated rows get equal results; nothing is capped; an empty table gives an empty one. Columns other
than ``page_id``, ``url`` and ``html`` take no part, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.runtime import sliced

#: Elements of the HTML standard by what they do to lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold text of a page.
NEVER = frozenset("head script style noscript template svg math iframe object button select textarea audio video canvas title".split())
#: Hints at boilerplate: elements, values of ``role``, words of ``class`` and ``id``.
DOUBTFUL = frozenset("nav footer aside form dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal "
    "nav navbar navigation newsletter notice notices notification overlay pagination popup promo promoted promotion related respond share sharing sidebar "
    "signup social sponsor sponsored subscribe toolbar widget".split()
)
REGIONS = frozenset({"article", "main"})
CONTAINERS = frozenset("article body center details div fieldset form html main section td".split())
TITLES = frozenset({"h1", "h2"})
#: A start tag of the first ends an open one of the others, and a paragraph in it.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_PARTS = re.compile(r"[^a-z0-9]+")
_UNFINISHED = re.compile(r"<[A-Za-z/!?]")
SIGMA = 1.5
KERNEL = np.exp(-0.5 * (np.arange(-4, 5) / SIGMA) ** 2)
#: Weight of a line in ``article`` or ``main``; that of a doubtful one is the inverse.
WEIGHT = 16.0
#: Shares of the clusters that an article, or another container, must hold to be the region.
ARTICLE_SHARE, CONTAINER_SHARE = 0.5, 0.5


@dataclass(frozen=True)
class Line:
    text: str
    plain: int  #: characters outside links
    tags: int
    element: int  #: the innermost open element


class Lines(HTMLParser):
    """The lines of a page and the tree of its elements, by number in document order: 0 is the page, ``parent`` is
    smaller than the element, and the elements inside one follow it without a gap."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kind, self.parent, self.doubtful = ["html"], [0], [False]
        self.stack: list[tuple[int, str, bool]] = [(0, "", False)]  # element, tag, never text
        self.depths: dict[str, list[int]] = {}  # of the open elements, by tag
        self.blocks: list[int] = [0]
        self.regions: list[int] = []
        self.muted = 0
        self.text: list[str] = []
        self.plain = self.tags = 0

    def _break(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append(Line(text, min(self.plain, len(text)), self.tags, self.stack[-1][0]))
        self.text, self.plain, self.tags = [], 0, 0

    def _close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            _, tag, never = self.stack.pop()
            self.depths[tag].pop()
            self.muted -= never
            if tag in BLOCKS:
                self.blocks.pop()
            if tag in REGIONS:
                self.regions.pop()

    def _names(self, tag: str, attrs: list) -> tuple[bool, bool]:
        """(never text, doubtful) of a start tag."""
        if tag in NEVER:
            return True, False
        doubtful = tag in DOUBTFUL or tag == "header" and not self.regions
        named = not (tag in REGIONS and not self.regions or tag in ("html", "body"))
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True, False
            if named and value and name == "role":
                doubtful |= value.lower() in ROLES
            if named and value and name in ("class", "id"):
                words = _PARTS.split(value.lower())
                doubtful |= not WORDS.isdisjoint(words) or "header" in words and not self.regions
        return False, doubtful

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._break()
            if tag != "head" and self.depths.get("head"):
                self._close_to(self.depths["head"][-1])
            closes = CLOSES.get(tag, frozenset())
            if self.stack[self.blocks[-1]][1] == "p":
                self._close_to(self.blocks[-1])
            while self.stack[self.blocks[-1]][1] in closes:
                self._close_to(self.blocks[-1])
        elif tag == "br" and not self.muted:
            self.text.append(" ")
        never, doubtful = self._names(tag, attrs)
        self.tags += not (self.muted or never)
        if tag in VOID:
            return
        self.kind.append(tag)
        self.parent.append(self.stack[-1][0])
        self.doubtful.append(doubtful)
        self.depths.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        if tag in REGIONS:
            self.regions.append(len(self.stack))
        self.stack.append((len(self.kind) - 1, tag, never))
        self.muted += never

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += not self.muted
        if tag in BLOCKS:
            self._break()
        open_ones = self.depths.get(tag)
        if not open_ones or self.regions and open_ones[-1] < self.regions[-1] and tag not in ("body", "html"):
            return  # a stray end tag does not close the region around it
        if open_ones[-1] < self.blocks[-1]:
            self._break()
        self._close_to(open_ones[-1])

    def handle_data(self, data: str) -> None:
        if not self.muted:  # scripts and the like leave the line around them as it is
            self.text.append(data)
            if not self.depths.get("a"):
                self.plain += len(data.strip())

    def finish(self, html: str) -> "Lines":
        """Read a whole page. What the parser leaves at the end is plain text, or a tag or comment that the page does
        not finish: that is no text, and searching it for further tags would take quadratic time."""
        self.feed(html)
        rest, self.rawdata = self.rawdata, ""
        if rest and self.cdata_elem is None and not _UNFINISHED.match(rest):
            self.handle_data(unescape(rest))
        self._break()
        return self


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """Means over the neighbours, weighted by a Gaussian and by what of it lies inside the page."""
    reach = len(KERNEL) // 2
    pad = lambda x: np.convolve(np.pad(x, reach), KERNEL, "valid")
    return pad(ratio) / pad(np.ones(len(ratio)))


def clusters(sizes: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which lines have a smoothed text-to-tag ratio of at least half the mean."""
    smooth = smoothed(sizes / np.maximum(1, tags))
    return (smooth >= smooth.mean() / 2) & (sizes > 0)


def content(page: Lines, cluster=clusters) -> list[str]:
    """Texts of the lines in the content region."""
    lines, kind, parent = page.lines, page.kind, page.parent
    if not lines:
        return []
    inside, doubt = [False] * len(kind), list(page.doubtful)
    for e in range(1, len(kind)):
        inside[e] = inside[parent[e]] or kind[e] in REGIONS
        doubt[e] = doubt[e] or doubt[parent[e]]
    weight = np.array([(WEIGHT if inside[x.element] else 1.0) * (1 / WEIGHT if doubt[x.element] else 1.0) for x in lines])
    sizes = np.array([x.plain for x in lines], float)
    if not sizes.any():
        sizes = np.array([len(x.text) for x in lines], float)
    sizes *= weight
    chosen = cluster(sizes, np.array([x.tags for x in lines]))
    mass, many = [0.0] * len(kind), [0] * len(kind)
    for line, size, hit in zip(lines, np.where(chosen, sizes, 0.0).tolist(), chosen.tolist()):
        mass[line.element] += size
        many[line.element] += hit
    for e in range(len(kind) - 1, 0, -1):
        mass[parent[e]] += mass[e]
        many[parent[e]] += many[e]
    articles = [e for e, m in enumerate(mass) if kind[e] in REGIONS and m >= ARTICLE_SHARE * mass[0]]
    if articles:
        region = max(articles, key=lambda e: (kind[e] == "article", mass[e], e))
    else:
        region = max(e for e, m in enumerate(mass) if kind[e] in CONTAINERS and (m / mass[0] + many[e] / many[0]) / 2 >= CONTAINER_SHARE)
        beside = {parent[e] for e, n in enumerate(many) if n and e != region and kind[e] == "section" and not doubt[e]}
        while kind[region] == "section" and parent[region] in beside:
            region = parent[region]
    within, pruned = [False] * len(kind), [False] * len(kind)
    within[region] = True
    for e in range(region + 1, len(kind)):
        within[e] = within[parent[e]]
        pruned[e] = within[e] and (pruned[parent[e]] or page.doubtful[e])
    mine = [i for i, x in enumerate(lines) if within[x.element]]
    if kind[region] in ("html", "body"):
        edge = np.flatnonzero(chosen)
        mine = [i for i in mine if edge[0] <= i <= edge[-1]]
    first = mine[0]
    while first and kind[lines[first - 1].element] in TITLES and not doubt[lines[first - 1].element] and not inside[lines[first - 1].element]:
        first -= 1
    return [lines[i].text for i in [*range(first, mine[0]), *mine] if not pruned[lines[i].element]]


def main_text(html: str | None) -> str:
    """The main text of one page, blocks joined by line feeds."""
    return "\n".join(content(Lines().finish(html))) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page. Narrow: no shuffle."""

    def run(batches):
        for batch in sliced(batches, "html"):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
