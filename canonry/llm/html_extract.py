"""Main text of raw HTML pages.

The standard library's streaming parser reports tags and text; a "line" is the text of one
block, with the number of tags met in it. Each line gets its text-to-tag ratio, the ratios are
smoothed with a Gaussian kernel along the page, and a threshold of one standard deviation
clusters the lines into content and the rest. The clustered lines select the page's content
region: the smallest element that holds most of their text, widened to the article (or main
element) around it; without one, the smallest that holds all of their text and the h1. Every line of that region is returned, short ones as well, but for lines
inside menus, headers, footers, side bars, notices, adverts, forms, comments, scripts and
styles, which are known by element name, ARIA role or class and id values. A value is judged whole: ``advert``, or
a compound whose every part says so or names a page part (``ad-slot``, ``site-footer``); ``side-effects`` says nothing. A form, or
an element known by class or id alone, stays where no article is outside such elements and it holds the clustered text.
Text of inline elements goes where they are hidden or marked as advert.

Edge cases: a null or empty page, or one without text, gives an empty string. Broken markup
(unclosed elements, a page cut short) is read as far as it goes. A page is one row's work,
linear in its length; nothing is shuffled. Repeated rows each give a row; other columns of the
input are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
#: The region holds at least this share of the clustered text.
SHARE = 0.8

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img".split())
#: Elements whose text is never part of the article.
_DROP = frozenset(
    "head nav footer aside form script style noscript template iframe object svg math canvas dialog menu "
    "button select textarea datalist audio video title header".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of class and id values that mark what is not the article.
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side "
    "nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr "
    "notice popup modal overlay newsletter subscribe subscription signup login share sharing social related "
    "recommended comment comments commentlist respond disqus replies reply widget skip pagination pager "
    "disclaimer alert tags".split())
#: Words that name a part of a page and say nothing of what it is; in a compound they leave the judgement to the others.
_PARTS = frozenset(
    "area article articles bar block blog body bottom box btn button buttons card cards col column container content count "
    "desktop entry fixed floating form global google group header heading icon icons image inline inner item items label left "
    "link links list main menu mobile module native news page pane panel post posts rail reader right row section site slot "
    "sticky stories story strip text title top unit user wrap wrapper zone".split())
_ADVERT = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_MAIN_WORDS = frozenset(("article", "main", "post", "entry"))
_SIDEBAR = frozenset(("sidebar",))


def _marks(value: str, words: frozenset[str]) -> bool:
    """Does a class or id value hold a name made of ``words`` and parts of a page alone?"""
    for name in value.lower().split():
        parts = [p for p in _SPLIT.split(name) if p and not p[0].isdigit()]
        if any(p in words for p in parts) and all(p in words or p in _PARTS for p in parts):
            return True
    return False


def _hidden(key: str, value: str | None) -> bool:
    return key == "hidden" or key == "style" and bool(value) and "display:none" in value.replace(" ", "").lower()


class _Lines(HTMLParser):
    """Lines of a page: text, tags met, and the open elements around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []      # element, its number, dropped
        self.doubtful: list[bool] = [False]                # of each element number: dropped unless it holds the article
        self.parent: list[int] = [-1]                      # of each element number; 0 is the page
        self.name: list[str] = ["page"]
        self.lines: list[tuple[str, int, int, int]] = []   # text, tags, element number, heading (h1 2, h2 1)
        self._text: list[str] = []
        self._tags = 0
        self._heading = 0
        self._open: dict[str, int] = {}                    # open elements by name
        self._mute: tuple[str, int, int] | None = None     # inline element left out, its depth in itself, stack size

    def _inside(self, name: str) -> bool:
        return self._open.get(name, 0) > 0

    def _pop(self, size: int) -> None:
        """Closes the innermost open elements down to ``size``, and what is left out inside them."""
        while len(self.stack) > size:
            self._open[self.stack.pop()[0]] -= 1
        if self._mute and self._mute[2] > size:
            self._mute = None

    def _inline(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        """Opens an inline element: its text goes if it is hidden or an advert."""
        if self._mute:
            name, depth, size = self._mute
            self._mute = (name, depth + (tag == name), size)
        elif any(_hidden(k, v) or k in ("class", "id") and v and _marks(v, _ADVERT) for k, v in attrs):
            self._mute = (tag, 1, len(self.stack))

    def _dropped(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if self.stack and self.stack[-1][2]:
            return True
        if tag in _DROP and tag != "form" and not (tag == "header" and self._inside("article")):
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        for key, value in attrs:
            if _hidden(key, value):
                return True
            if key == "role" and value and value.lower() in _ROLES - {"form"}:
                return True
        return False

    @staticmethod
    def _doubtful(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        """Marked as no part of the article by what a container of the article may carry as well."""
        if tag == "form":
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        for key, value in attrs:
            if key == "role" and value and value.lower() == "form":
                return True
            if key in ("class", "id") and value and (
                    _marks(value, _WORDS) and not _MAIN_WORDS & set(value.lower().split()) or _marks(value, _SIDEBAR)):
                return True
        return False

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text and not (self.stack and self.stack[-1][2]):
            element = self.stack[-1][1] if self.stack else 0
            self.lines.append((text, self._tags, element, self._heading))
        self._text, self._tags, self._heading = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self._text.append(" ")
        elif tag in _INLINE:
            self._tags += 1
            if tag not in _VOID:
                self._inline(tag, attrs)
        elif tag in _VOID:
            self._flush()
        else:
            self._flush()
            if tag == "p" or tag == "li" or tag in ("td", "th", "tr", "dt", "dd", "option"):
                # End tags that may be left out: an open one of the same kind ends here.
                if self.stack and self.stack[-1][0] == tag:
                    self._pop(len(self.stack) - 1)
            number = len(self.parent)
            self.parent.append(self.stack[-1][1] if self.stack else 0)
            self.name.append(tag)
            dropped = self._dropped(tag, attrs)
            self.stack.append((tag, number, dropped))
            self._open[tag] = self._open.get(tag, 0) + 1
            self.doubtful.append(not dropped and self._doubtful(tag, attrs))
            self._tags += 1
            self._heading = (tag in ("h1", "h2")) + (tag == "h1")

    def handle_startendtag(self, tag, attrs):
        if tag in _VOID:
            self.handle_starttag(tag, attrs)
        elif tag in _INLINE:
            self._tags += 1
        else:
            self._flush()

    def handle_endtag(self, tag):
        if tag in _INLINE:
            self._tags += 1
            if self._mute and self._mute[0] == tag:
                name, depth, size = self._mute
                self._mute = (name, depth - 1, size) if depth > 1 else None
            return
        if tag in _VOID:
            return
        self._flush()
        # A stray </p> closes nothing, nor does the end of an element that is not open.
        if not self._inside(tag) or tag == "p" and self.stack[-1][0] != "p":
            return
        at = len(self.stack) - 1
        while self.stack[at][0] != tag:
            at -= 1
        self._pop(at)

    def handle_data(self, data):
        if not self._mute:
            self._text.append(data)

    def close(self):
        super().close()
        self._flush()


def content_lines(lengths: np.ndarray, tags: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """True for lines whose smoothed text-to-tag ratio reaches one standard deviation of all."""
    ratio = lengths / np.maximum(tags, 1)
    reach = max(1, int(round(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    smooth = np.convolve(np.pad(ratio, reach, mode="edge"), kernel, mode="valid")
    return smooth >= min(smooth.std(), smooth.max())


def _gone(page: _Lines, sigma: float, share: float) -> list[bool]:
    """Of each element: inside a doubtful one that does not hold the article."""
    def spread(doubtful: list[bool]) -> list[bool]:
        gone = [False] * len(page.parent)
        for i in range(1, len(gone)):
            gone[i] = doubtful[i] or gone[page.parent[i]]
        return gone

    gone = spread(page.doubtful)
    mains = [i for i, name in enumerate(page.name) if name in ("article", "main")]
    if not any(page.doubtful) or not page.lines or any(not gone[i] for i in mains):
        return gone
    lengths = np.array([len(x[0]) for x in page.lines], dtype=float)
    held = [0.0] * len(page.parent)
    for (_, _, element, _), length, good in zip(page.lines, lengths, content_lines(
            lengths, np.array([x[1] for x in page.lines]), sigma)):
        held[element] += length * good
    holds = [False] * len(page.parent)
    for i in mains:
        holds[i] = True
    for i in range(len(held) - 1, 0, -1):
        held[page.parent[i]] += held[i]
        holds[page.parent[i]] |= holds[i]
    return spread([doubt and held[i] < (0.5 if holds[i] else share) * held[0] for i, doubt in enumerate(page.doubtful)])


def main_text(html: str | None, sigma: float = SIGMA, share: float = SHARE) -> str:
    """The article's blocks in page order, joined by one space."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.close()
    gone = _gone(page, sigma, share)
    lines = [x for x in page.lines if not gone[x[2]]]
    if not lines:
        return ""
    lengths = np.array([len(x[0]) for x in lines], dtype=float)
    chosen = content_lines(lengths, np.array([x[1] for x in lines]), sigma)
    held = [0.0] * len(page.parent)
    headed = [0] * len(page.parent)
    for (_, _, element, heading), length, good in zip(lines, lengths, chosen):
        held[element] += length * good
        headed[element] = max(headed[element], heading)
    for i in range(len(held) - 1, 0, -1):
        held[page.parent[i]] += held[i]
        headed[page.parent[i]] = max(headed[page.parent[i]], headed[i])
    need = share * held[0]
    region = max((i for i in range(len(held)) if held[i] >= need), key=lambda i: (i > 0, i))
    # Elements are numbered in page order, so the last one that holds enough is the smallest.
    around, at = region, region
    while at > 0:
        if page.name[at] in ("article", "main"):
            around = at
            if page.name[at] == "article":
                break
        at = page.parent[at]
    if around == region and page.name[region] not in ("article", "main"):
        # No article element: all clustered lines, and the h1 (the first heading where there is none).
        at = max((i for i in range(len(held)) if held[i] >= held[0] * (1 - 1e-9)), key=lambda i: (i > 0, i))
        while at > 0 and headed[at] < (headed[0] or 1) and page.name[at] not in ("body", "html"):
            at = page.parent[at]
        around = at
    inside = [False] * len(page.parent)
    for i in range(len(page.parent)):
        inside[i] = i == around or page.parent[i] >= 0 and inside[page.parent[i]]
    return " ".join(text for text, _, element, _ in lines if inside[element])


def extract(pages: DataFrame, sigma: float = SIGMA, share: float = SHARE, id_col: str = "page_id",
            url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page, from its whole HTML."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(html.as_py(), sigma, share) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             names=["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id long, url string, text string")
