"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser is fed the page in chunks; its events are folded at once into
lines (one per block element) with their text and tag counts and the container they lie in.  The
logarithm of each line's ratio of text to tags is smoothed with a Gaussian over its neighbours, and
two-means sets the border between content and the rest.  The region is the innermost container
that holds all content lines (descent ends at an element marked as the article).  Inside it a
second clustering trims what is neither content nor between two lines of content.

Structure corrects the ratios within bounds: lines in elements that are never article text
(menus, headers, footers, asides, forms, notices, adverts, comments) have no say and no place.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
#: Lines on each side that the Gaussian reaches, and its deviation in lines.
REACH, SIGMA = 2, 1.0
#: By how much ratios inside the region count more than the page's rest in the second clustering.
INSIDE = 32.0
#: Characters a tag below which a line neither begins nor ends the article, whatever its neighbours.
LEAST = 1.0
#: Share of the content's text that a container must hold for the region to lie within it.
SHARE = 0.9

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title select option textarea button datalist".split())
_ASIDE = frozenset("nav footer aside form dialog menu".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CONTAINERS = frozenset("article blockquote div main section table td th".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of class and id names that mark what is not the article.
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login comment comments disqus reply replies respond share sharing social related recommended widget toolbar pagination pager copyright skip".split()
)
_NEW_P = _BLOCK - {"body", "html", "article", "main"}
#: Elements that no class word rules out: themes put such words on the page as a whole.
_FRAME = frozenset("html body article main".split())


class _Lines(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []  # tag, kind: 0 plain, 1 not article, 2 article, 3 silent, 4 within a silent one
        self.depth = [0, 0, 0, 0, 0]
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, bool, int]] = []  # text, tags, not article, container
        self.parents, self.marks = [-1], [False]  # of containers; the first is the page
        self.open = [0]

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text.clear()
        if text:  # tags of a line without text count for the next one
            self.lines.append((text, self.tags, self.depth[1] > 0, self.open[-1]))
            self.tags = 0

    def _pop(self) -> None:
        tag, kind = self.stack.pop()
        if tag in _BLOCK:
            self._flush()
        if tag in _CONTAINERS and kind != 4:
            self.open.pop()
        self.depth[kind] -= 1

    def _close(self, tags: frozenset[str] | set[str], until: frozenset[str]) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                while len(self.stack) > i:
                    self._pop()
                return
            if self.stack[i][0] in until:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID:
            self.tags += 1
            if tag in ("br", "hr", "wbr", "img") and not self.depth[3]:
                self.text.append("" if tag == "wbr" else " ")
            return
        if self.depth[3] and tag not in ("body",):
            self.stack.append((tag, 4))
            self.depth[4] += 1
            return
        if tag == "body":
            self._close({"head"}, frozenset())
        if tag in _NEW_P or tag in ("article", "main"):
            self._close({"p"}, frozenset({"article", "main", "body", "td", "th", "div", "section", "li", "blockquote", "button"}))
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}
            self._close(same, frozenset({"ul", "ol", "dl", "table", "menu", "tbody", "thead", "tfoot"} | ({"tr"} if "td" in same else set())))
        if tag in _BLOCK:
            self._flush()
        kind = 3 if tag in _SILENT else 1 if tag in _ASIDE or self._marked(tag, attrs) else 0
        if tag == "header" and not self.depth[2]:
            kind = 1
        if not kind and (tag in ("article", "main") or ("role", "main") in attrs or ("itemprop", "articleBody") in attrs):
            kind = 2
        self.stack.append((tag, kind))
        self.depth[kind] += 1
        self.tags += 1
        if tag in _CONTAINERS:
            self.parents.append(self.open[-1])
            self.marks.append(kind == 2)
            self.open.append(len(self.parents) - 1)

    @staticmethod
    def _marked(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
            if not value:
                continue
            if name in ("class", "id") and tag not in _FRAME and any(w in _WORDS for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower())):
                return True
            if name == "role" and value.lower() in _ROLES:
                return True
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        return False

    def handle_endtag(self, tag: str) -> None:
        if tag in _VOID:
            return
        if any(t == tag for t, _ in self.stack):
            self._close({tag}, frozenset())
            self.tags += not self.depth[3]

    def handle_data(self, data: str) -> None:
        if not self.depth[3]:
            self.text.append(data)

    def finish(self) -> list[tuple[str, int, bool, int]]:
        self.close()
        while self.stack:
            self._pop()
        self._flush()
        return self.lines

    def region(self, weight: np.ndarray) -> int:
        """The innermost container that holds :data:`SHARE` of the lines' weights, none of which lies around it."""
        n = len(self.parents)
        held = np.zeros(n)
        np.add.at(held, [x[3] for x in self.lines], weight)
        own = held > 0
        for c in range(n - 1, 0, -1):  # a container comes after its parent
            held[self.parents[c]] += held[c]
        best = [-1] * n
        for c in range(1, n):
            p = self.parents[c]
            if best[p] < 0 or held[c] > held[best[p]]:
                best[p] = c
        at = 0
        while not self.marks[at] and not own[at] and best[at] >= 0 and held[best[at]] >= max(SHARE * held[at], 1e-9):
            at = best[at]
        return at

    def inside(self, region: int) -> np.ndarray:
        within = np.zeros(len(self.parents), bool)
        within[region] = True
        for c in range(region + 1, len(within)):
            within[c] = within[self.parents[c]]
        return within[[x[3] for x in self.lines]]


def _threshold(x: np.ndarray) -> float:
    """The border of two-means on the values."""
    low, high = float(x.min()), float(x.max())
    for _ in range(32):
        border = (low + high) / 2
        under, over = x[x <= border], x[x > border]
        if not len(over) or not len(under):
            break
        new = float(under.mean()), float(over.mean())
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def smoothed(ratio: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The Gaussian mean of each line of ``part`` over its neighbours there; 0 elsewhere."""
    weights = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2) if SIGMA else (np.arange(-REACH, REACH + 1) == 0).astype(float)
    over = lambda x: np.convolve(np.pad(x, REACH), weights, "valid")
    out = np.zeros(len(ratio))
    out[part] = over(ratio * part)[part] / over(part.astype(float))[part]
    return out


def main_text(html: str) -> str:
    """The blocks of the article, white space within them folded, joined by blank lines."""
    parser = _Lines()
    for at in range(0, len(html), CHUNK):
        parser.feed(html[at : at + CHUNK])
    lines = parser.finish()
    if not lines:
        return ""
    live = np.array([not x[2] for x in lines])
    if not live.any():
        return ""
    size = np.array([len(x[0]) for x in lines], float)
    ratio = np.log1p(size / np.maximum(1, [x[1] for x in lines]))
    # a line of tags alone joins the clusters, so that a page of text alone isn't parted
    border = lambda x: _threshold(np.append(x[live], 0.0))
    smooth = smoothed(ratio, live)
    where = parser.region(np.where(live & (smooth >= border(smooth)), size, 0.0))
    region = parser.inside(where) & live
    smooth = smoothed(ratio, region) + smoothed(ratio, live & ~region)  # neighbours of another part say nothing of a line
    if where:
        smooth[region] += np.log(INSIDE)
    kept = np.flatnonzero(region & (smooth >= border(smooth)) & (ratio >= np.log1p(LEAST)))
    if len(kept):  # lines between two kept ones belong to them
        region[: kept[0]] = region[kept[-1] + 1 :] = False
    return "\n\n".join(lines[i][0] for i in np.flatnonzero(region))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (page_id, url, text, n_chars) per row of ``pages``.

    Null or empty html, and a page without an article, give an empty text; repeated rows stay
    repeated; an empty table gives none; other columns are ignored.  Map-only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
