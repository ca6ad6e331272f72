"""Main text of HTML pages: text-to-tag ratios of lines, smoothed and clustered.

Events of the standard library's streaming parser make lines: a line ends where a
block element begins or ends. A line's ratio is its text length per tag. Ratios are
smoothed by a Gaussian along the page; lines above the threshold are content. The
regions whose text is content for the most part are taken whole, so that short
paragraphs between long ones stay. A region is an element, widened to the article or
main around it if the page marks one; an article mark decides nothing else but ties.

Tags, roles and whole class names that speak for menus, forms, adverts and the like
drop an element's text, unless it holds the page's article or most of its text.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxlens.llm.tables import map_rows

SIGMA = 1.5
MOST, MOST_BESIDE_ARTICLE, STORY = 0.5, 0.8, 400
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span "
    "strike strong sub sup time tt u var wbr ruby rb rt rp img".split()
)
UNREAD = set(
    "head script style noscript template select textarea option input iframe object svg math canvas "
    "audio video".split()
)
SKIPPED = set("nav header footer aside form button label fieldset dialog menu".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup sidebar "
    "widget widgets related recommended nav navbar navigation menu breadcrumb breadcrumbs header "
    "masthead footer comment comments discussion disqus replies respond share sharing social "
    "login pagination pager toolbar".split()
)
COMPOUNDS = set(
    "site-header site-footer page-footer site-nav main-nav nav-links share-buttons share-links social-links "
    "related-posts related-articles related-links comment-list comments-area comment-form ad-slot "
    "ad-container ad-wrapper cookie-bar".split()
)
LISTS = set("ul ol dl table thead tbody tfoot tr td th".split())
CLOSES_P = set(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav "
    "ol p pre section table ul".split()
)
CLOSES_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
               "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LETTERS = re.compile(r"[^a-z]+")
_IN_HEAD = UNREAD | {"title", "meta", "link", "base"}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _is_name(token: str) -> bool:
    """Whether a whole class or id names boilerplate: `cookie-notice` does, `has-sidebar` does not."""
    parts = set(_LETTERS.split(token)) - {""}
    return token in COMPOUNDS or (bool(parts) and parts <= NAMES)


def _unread(tag: str, attrs: dict[str, str | None]) -> bool:
    """Whether a browser shows no text of an element, or shows it as a control."""
    if tag in UNREAD:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return (
        "hidden" in attrs
        or attrs.get("aria-hidden") == "true"
        or bool(_HIDDEN.search(attrs.get("style") or ""))
    )


def _doubtful(tag: str, attrs: dict[str, str | None]) -> bool:
    """Whether the tag, role or names of an element speak for boilerplate."""
    if tag in SKIPPED or (attrs.get("role") or "").lower() in ROLES:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return any(map(_is_name, f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()))


class Lines(HTMLParser):
    """Lines of a page as [pieces, tags, element, mark]; a piece is (text, doubtful element, in a link).

    Elements are numbered as they open. `marks` gives the next outer and the outermost
    mark of each article mark and the doubtful element around it, `doubted` the next
    outer doubtful element of each.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int, int, bool]] = []  # tag, unread, element, mark, doubtful, link
        self.places: dict[str, list[int]] = {}  # of the open elements of each tag
        self.blocks: list[int] = []  # places of the open elements that are not inline
        self.lists: dict[int, int] = {}  # the element around each outermost list or table
        self.unclosed: int | None = None  # where the first comment without an end begins
        self.lines: list[list] = [[[], 0, 0, 0]]
        self.elements = 0
        self.marks: dict[int, tuple[int, int, int]] = {}
        self.doubted: dict[int, int] = {}

    def _state(self) -> tuple[bool, int, int, int, bool]:
        return self.open[-1][1:] if self.open else (False, 0, 0, 0, False)

    def _break(self) -> None:
        _, element, mark, *_ = self._state()
        if self.lines[-1][0]:
            self.lines.append([[], 0, element, mark])
        else:
            self.lines[-1][2:] = [element, mark]

    def _pop(self, at: int) -> None:
        for tag, *_ in self.open[at:]:
            self.places[tag].pop()
        del self.open[at:]
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.open and self.open[-1][0] == "head" and tag not in _IN_HEAD:
            self._pop(len(self.open) - 1)
        closes = CLOSES_SELF.get(tag) or ({"p"} if tag in CLOSES_P else set())
        if self.blocks and self.open[self.blocks[-1]][0] in closes:
            self._pop(self.blocks[-1])
        unread, element, mark, doubtful, link = self._state()
        self.lines[-1][1] += 1
        if tag not in VOID:
            named = dict(attrs)
            self.elements += 1
            if tag not in INLINE and tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li"):
                if tag not in LISTS:
                    element = self.elements
                elif element not in self.lists:
                    self.lists[self.elements] = element
                    element = self.elements
            if _doubtful(tag, named):
                self.doubted[self.elements] = doubtful
                doubtful = self.elements
            if tag in ("article", "main") or (named.get("role") or "").lower() in ("main", "article"):
                top = self.marks[mark][1] if mark else self.elements
                self.marks[self.elements] = (mark, top, doubtful)
                mark = self.elements
            unread = unread or _unread(tag, named)
            self.places.setdefault(tag, []).append(len(self.open))
            if tag not in INLINE:
                self.blocks.append(len(self.open))
            self.open.append((tag, unread, element, mark, doubtful, link or tag == "a"))
        if tag not in INLINE:
            self._break()

    def linked(self) -> Counter:
        """Characters of links on the lines of each region."""
        out: Counter = Counter()
        for pieces, _, element, mark in self.lines:
            out[mark or element] += sum(len(text.strip()) for text, _, link in pieces if link)
        return out

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1][1] += 1
        if self.places.get(tag):
            self._pop(self.places[tag][-1])
        if tag not in INLINE:
            self._break()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """`<![` of any kind is a comment up to the next `>`, as the HTML standard has it."""
        return self.parse_bogus_comment(i, report)

    def goahead(self, end: bool) -> None:
        self.unclosed = None
        super().goahead(end)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """Looks for the end of a comment once: behind one without an end there is none."""
        if self.unclosed is not None and i >= self.unclosed:
            return -1
        end = super().parse_comment(i, report)
        if end < 0:
            self.unclosed = i
        return end

    def read(self, page: str) -> None:
        """The whole page. What follows the last `>` holds no whole tag and is text."""
        last = page.rfind(">") + 1
        self.feed(page[:last])
        self.close()
        if last < len(page):
            self.handle_data(unescape(page[last:]))

    def handle_data(self, data: str) -> None:
        unread, element, mark, doubtful, link = self._state()
        if not unread:
            if not self.lines[-1][0]:
                self.lines[-1][2:] = [element, mark]
            self.lines[-1][0].append((data, doubtful, link))


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing along the lines; the page is continued by its end lines."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), "valid")


def _wrappers(page: Lines) -> set[int]:
    """Doubtful elements that hold the page's article marks or most of its text, links aside.

    Marks are weighed by their text outside doubtful elements within them. Against a
    marked article elsewhere on the page, most is more than MOST_BESIDE_ARTICLE and
    more than STORY characters.
    """
    inside = dict.fromkeys(page.doubted, 0)
    held = dict.fromkeys(page.doubted, 0)
    total = marked = 0
    for pieces, _, _, mark in page.lines:
        _, top, _ = page.marks.get(mark, (0, 0, 0))
        opened_in = page.marks[top][2] if top else 0
        for text, doubtful, link in pieces:
            size = 0 if link else len(text.strip())
            total += size
            if doubtful:
                inside[doubtful] += size
            if top and doubtful == opened_in:
                marked += size
                if doubtful:
                    held[doubtful] += size
    for d in sorted(page.doubted, reverse=True):
        if outer := page.doubted[d]:
            inside[outer] += inside[d]
            held[outer] += held[d]
    return {
        d
        for d in page.doubted
        if 2 * held[d] > marked
        or inside[d] > (max(total * MOST_BESIDE_ARTICLE, STORY) if held[d] < marked else total * MOST)
    }


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The article's blocks, white space inside a block as one space, joined by one space."""
    page = Lines()
    page.read(html or "")
    read = _wrappers(page) | {0}
    lines = [
        (" ".join("".join(text for text, doubtful, _ in pieces if doubtful in read).split()), tags, mark or element)
        for pieces, tags, element, mark in page.lines
    ]
    lines = [x for x in lines if x[0]]
    if not lines:
        return ""
    ratios = np.array([len(text) / max(1, tags) for text, tags, _ in lines], float)
    smooth = smoothed(ratios, sigma)
    content = smooth >= min(smooth.std(), smooth.max())
    inside = {m: [0, 0] for m in page.marks}
    for (text, _, region), good in zip(lines, content, strict=True):
        held = inside.setdefault(region, [0, 0])
        held[0] += len(text)
        held[1] += len(text) * bool(good)
    for m in sorted(page.marks, reverse=True):  # a mark is judged with the marks within it
        if outer := page.marks[m][0]:
            inside[outer][0] += inside[m][0]
            inside[outer][1] += inside[m][1]
    places: dict[int, list[int]] = {}
    for i, (_, _, region) in enumerate(lines):
        places.setdefault(region, [i, i])[1] = i
    # The region with the most content is taken anyway, of equal ones an article's.
    best = max({r for _, _, r in lines}, key=lambda r: (inside[r][1], r in page.marks, -r))
    taken = {r for r in places if r == best or 2 * inside[r][1] >= inside[r][0]}
    # A list or table belongs to the story around it if that goes on behind it and it is no list of links.
    linked = page.linked()
    for r in places.keys() & page.lists.keys() - taken:
        around = page.lists[r]
        if around in taken and places[around][0] < places[r][0] and places[r][1] < places[around][1]:
            if 2 * linked[r] < inside[r][0]:
                taken.add(r)
    return " ".join(text for text, _, r in lines if r in taken)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null or empty page has the empty text. Very long pages are read as a stream of
    events. Repeated rows give repeated rows.
    """

    def run(batch):
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts,
                "n_chars": [len(t) for t in texts]}

    return map_rows(
        pages.select(F.col("page_id").cast("long"), "url", "html"), run,
        "page_id long, url string, text string, n_chars long",
    )
