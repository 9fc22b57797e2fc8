"""Main text of web pages from parser events and text-to-tag ratios.

1.  The standard library's parser streams a page's events into lines, one for each block,
    each with its text, its text outside links, its tags and its place in the tree.
2.  The logarithm of a line's ratio of text outside links to tags, smoothed by a Gaussian
    along the page, tells content from clutter: two clusters, parted by the threshold that
    lies midway between their means. Lines marked by their element or by the words of a
    class, id or role as menu, advert, comment and the like have no ratio.
3.  The region is the innermost container that holds `SHARE` of the text of content lines;
    text in `article` or `main` counts double, and such an element around the container is
    the region as a whole. In it, a part (child) without any content line is left out, as
    are lines that are mostly links; lines that stand in the region itself stay, short or
    long, as does a heading just before it. Within `article` or `main` all unmarked lines stay.

A word like "sidebar" marks nothing after "no", "has" or "with", or where `article` or
`main` lies inside, as that is a layout's wrapper. Comments stay marked whatever they hold.

A null or empty html, or one without content, gives an empty text. Several articles are all
kept; of containers alike, the first. Pages are read whole; repeated rows are read each;
extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import rows_of, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLUTTER_TAGS = frozenset("head script style noscript template nav header footer aside form button select textarea iframe object svg canvas dialog menu".split())
CLUTTER_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner sidebar menu nav navigation navbar breadcrumb breadcrumbs header masthead "
    "footer comment comments disqus cookie cookies consent gdpr notice notices popup modal overlay share sharing social related recommended "
    "newsletter subscribe signup login search pagination widget toolbar complementary contentinfo search".split()
)
COMMENT_WORDS = frozenset("comment comments disqus".split())
#: A word after one of these says that the page has, or lacks, the thing.
ABOUT = frozenset("no not non has have with without hide hidden show toggle".split())
#: Elements whose end tag may be left out, and what an opening tag ends.
LOOSE = frozenset("p li dt dd option tr td th thead tbody tfoot".split())
_cells, _rows = frozenset(("td", "th")), frozenset(("tr", "td", "th"))
_parts = _rows | {"thead", "tbody", "tfoot"}
ENDS = {"li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "option": frozenset(("option",)), "td": _cells, "th": _cells, "tr": _rows, "thead": _parts, "tbody": _parts, "tfoot": _parts}
LISTS = frozenset("ul ol dl table select menu".split())
ROOTS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3"))
SIGMA, SHARE, LINKS = 1.5, 0.7, 0.5
WORDS = re.compile("[A-Za-z]+")
CAPITAL = re.compile("([a-z])([A-Z])")


def marks(value: str) -> frozenset[str]:
    """The clutter words of a class, id or role."""
    found = []
    for name in CAPITAL.sub(r"\1 \2", value).split():
        before = ""
        for w in map(str.lower, WORDS.findall(name)):
            if w in CLUTTER_WORDS and before not in ABOUT:
                found.append(w)
            before = w
    return frozenset(found)


def clutter(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """Whether an element is clutter: "" not, "soft" by its words, "hard" by its tag, or as comments or hidden."""
    if tag in CLUTTER_TAGS:
        return "hard"
    soft = ""
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "hard"
        if value and name in ("class", "id", "role") and tag not in ("html", "body"):
            found = marks(value)
            if found & COMMENT_WORDS:
                return "hard"
            if found:
                soft = "soft"
    return soft


class Line(NamedTuple):
    """A block's text, its characters outside links, its tags, the element it stands in, and the soft marks around it."""

    text: str
    plain: int
    tags: int
    node: int
    soft: tuple[int, ...]


class Lines(HTMLParser):
    """Collects the lines that no hard mark covers, and the tree of block elements (`up`, `tag`; node 0 is the page)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.up, self.tag, self.holds_root = [0], [""], [False]
        self.open: list[tuple[str, bool, tuple[int, ...], int]] = []  # tag, hard mark so far, soft marks so far, node
        self.text: list[str] = []
        self.plain = self.tags = self.links = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, _, soft, node = self.open[-1] if self.open else ("", False, (), 0)
            self.lines.append(Line(text, self.plain, self.tags, node, soft))
        self.text, self.plain, self.tags = [], 0, 0

    def end_implied(self, tag: str) -> None:
        """Close what a block's opening tag ends without an end tag."""
        while self.open and self.open[-1][0] in INLINE:
            self.open.pop()
        if self.open and self.open[-1][0] == "p":
            self.open.pop()
        if tag in ENDS:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] in LISTS:
                    break
                if self.open[i][0] in ENDS[tag] and (i == 0 or self.open[i - 1][0] not in ENDS[tag]):
                    del self.open[i:]
                    break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            if tag == "hr":
                self.end_line()
            return
        kind = clutter(tag, attrs)
        if tag not in INLINE:
            self.end_line()
            self.end_implied(tag)
        elif not kind:
            self.links += tag == "a"
            return
        _, hard, soft, up = self.open[-1] if self.open else ("", False, (), 0)
        node = up
        if tag not in INLINE or kind:
            node = len(self.up)
            self.up.append(up)
            self.tag.append(tag)
            self.holds_root.append(False)
        if tag in ROOTS and not hard and not kind:
            at = node
            while at and not self.holds_root[at]:
                self.holds_root[at] = True
                at = self.up[at]
        self.open.append((tag, hard or kind == "hard", (*soft, node) if kind == "soft" else soft, node))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a" and self.links:
            self.links -= 1
        if tag not in INLINE:
            self.end_line()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
            if self.open[i][0] not in INLINE and self.open[i][0] not in LOOSE and (tag in INLINE or tag in LOOSE):
                break

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.text.append(data)
            self.plain += 0 if self.links else len(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma)
    bell = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), bell / bell.sum(), mode="valid")


def upper_cluster(x: np.ndarray) -> np.ndarray:
    """Which values lie above the threshold that is midway between the means on its two sides; all if they are alike."""
    t = x.mean()
    while (x > t).any() and (x <= t).any():
        new = (x[x > t].mean() + x[x <= t].mean()) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    return x >= t


def region(lines: list[Line], up: list[int], tag: list[str], content: np.ndarray) -> list[bool]:
    """Which lines belong to the region of the content lines."""
    paths = []  # of each line: its element and those around it, the page last
    for line in lines:
        path = [line.node]
        while path[-1]:
            path.append(up[path[-1]])
        paths.append(path)
    weight, several, has_content = [0.0] * len(up), [0] * len(up), [False] * len(up)
    for line, path, c in zip(lines, paths, content.tolist(), strict=True):
        w = len(line.text) * (2 if any(tag[n] in ROOTS for n in path) else 1) if c else 0
        for n in path:
            weight[n] += w
            several[n] += 1
            has_content[n] |= c
    root = 0
    inside = sorted({n for path in paths for n in path if several[n] > 1})  # elements open before those in them
    for n in inside:
        if up[n] == root and n and weight[n] >= SHARE * weight[0]:
            root = n
    around = [root]
    while around[-1]:
        around.append(up[around[-1]])
    whole = [n for n in around if tag[n] in ROOTS]
    root = whole[-1] if whole else root
    kept = []
    held = [i for i, path in enumerate(paths) if content[i] and root in path]
    for i, (line, path) in enumerate(zip(lines, paths, strict=True)):
        if root not in path:
            kept.append(False)
        elif any(tag[n] in ROOTS for n in path):
            kept.append(True)
        else:
            part = path[path.index(root) - 1] if path[0] != root else root
            own = part == root or several[part] == 1 or (held and held[0] < i < held[-1])
            kept.append(bool(own or has_content[part]) and line.plain >= LINKS * len(line.text))
    first = kept.index(True) if True in kept else 0
    if first and not whole and tag[lines[first - 1].node] in HEADINGS:
        kept[first - 1] = True
    return kept


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = [x for x in parser.lines if all(parser.holds_root[n] for n in x.soft)]
    if not lines:
        return ""
    ratio = np.log1p([x.plain / (x.tags + 1) for x in lines])
    content = upper_cluster(smoothed(ratio)) & (ratio > 0)
    if not content.any():
        return ""
    kept = region(lines, parser.up, parser.tag, content)
    return "\n".join(x.text for x, k in zip(lines, kept, strict=True) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    base = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    id_type = base.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for (h,) in rows_of(batch, ["html"])]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return base.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
