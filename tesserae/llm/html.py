"""Main text of web pages: parser events, text-to-tag ratio, Gaussian smoothing, threshold clustering.

The standard library's parser streams events. What stands between two block-level tags is a line (lines
of the file mean nothing: many pages have one); its ratio is its characters over the tags since the
line before. Lines inside elements that are never article text (menus, forms, scripts, adverts,
comments, ...) have ratio 0. The ratios are smoothed with a Gaussian, and the threshold, their
standard deviation, divides the lines into content and the rest. Content lines are the mass of the
containers around them (text that has no paragraph of its own counts half): from the page inwards,
the container that holds most of its parent's mass is entered as long as there is one, and the region
so found grows again over headings and further content around it, up to an article or main element
where there is one. The text is every line of the region, short ones included, in page order.

A null or empty page has an empty text. Pages of any length are parsed whole, in linear time. On a page
of which no line reaches the threshold, all lines outside of excluded elements count as content.
Repeated rows give equal rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tesserae.llm.common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture video audio map object br".split())
#: Elements whose content is never article text.
NEVER = frozenset("head title script style noscript template svg math iframe object canvas nav aside footer form button select option textarea dialog menu audio video".split())
#: Words of class or id that mark such content (fixed values).
MARKS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc comment comments disqus respond replies footer share sharing social related recommended widget skip".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
REGION = frozenset(["article", "main"])
CONTAINER = frozenset("body html section div td article main center fieldset".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open p.
ENDS_P = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol dl table section article aside header footer nav form pre blockquote hr main figure address".split())


def marked(attrs: list) -> bool:
    for name, value in attrs:
        if name == "hidden":
            return True
        if not value:
            continue
        if name in ("class", "id") and not MARKS.isdisjoint(value.lower().replace("-", " ").replace("_", " ").split()):
            return True
        if name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
    return False


class Blocks(HTMLParser):
    """Collects (text, tags before it, container, excluded, kind) for each line; kind: bare, heading or text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int | None]] = []  # tag, excluded, the container that was current outside
        self.count: dict[str, int] = {}
        self.shut = 0
        self.regions = 0
        self.container, self.parents, self.tag_of = 0, [-1], [""]
        self.around: list[str] = []  # open block-level elements
        self.text: list[str] = []
        self.tags = 0
        self.blocks: list[tuple[str, int, int, bool, str]] = []

    def end_block(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text = []
            if text:
                tag = self.around[-1] if self.around else ""
                kind = "heading" if tag in HEADING else "bare" if not tag or tag in CONTAINER else "text"
                self.blocks.append((text, self.tags, self.container, self.shut > 0, kind))
                self.tags = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in INLINE:
            if tag == "br":
                self.text.append(" ")
            if tag in VOID or not (marked(attrs) if attrs else False) and tag not in NEVER:
                if tag not in VOID:
                    self.push(tag, False, None)
                return
        self.end_block()
        if tag in ENDS_P and self.count.get("p"):
            self.close_tag("p", frozenset(["article", "section", "div", "td", "body", "li", "blockquote"]))
        if tag in ("li", "td", "tr", "option", "dt", "dd"):
            self.close_tag(tag, frozenset(["ul", "ol", "table", "dl", "select"]))
        if tag in VOID:
            return
        excluded = tag in NEVER or tag == "header" and not self.regions or marked(attrs)
        if tag in ("body", "html", "article", "main"):
            excluded = False
        outside = None
        if tag in CONTAINER:
            outside = self.container
            self.parents.append(self.container)
            self.tag_of.append(tag)
            self.container = len(self.parents) - 1
        self.push(tag, excluded, outside)

    handle_startendtag = handle_starttag

    def push(self, tag, excluded, outside):
        self.open.append((tag, excluded, outside))
        if tag not in INLINE:
            self.around.append(tag)
        self.count[tag] = self.count.get(tag, 0) + 1
        self.shut += excluded
        self.regions += tag in REGION

    def pop(self):
        tag, excluded, outside = self.open.pop()
        if tag not in INLINE:
            self.around.pop()
        self.count[tag] -= 1
        self.shut -= excluded
        self.regions -= tag in REGION
        if outside is not None:
            self.container = outside
        return tag

    def close_tag(self, tag, up_to):
        """Close an open `tag` that no element of up_to stands inside."""
        if not self.count.get(tag):
            return
        for name, _, _ in reversed(self.open):
            if name == tag:
                while self.pop() != tag:
                    pass
                return
            if name in up_to:
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self.end_block()
        if tag == "p" or not self.count.get(tag):
            if tag == "p":
                self.close_tag("p", frozenset(["article", "section", "div", "td", "body"]))
            return
        if tag in INLINE:
            # misnested inline tags do not close blocks
            for name, excluded, _ in reversed(self.open):
                if name == tag:
                    if excluded:
                        self.end_block()
                    while self.pop() != tag:
                        pass
                    return
                if name not in INLINE:
                    return
            return
        while self.pop() != tag:
            pass

    def handle_data(self, data):
        self.text.append(data)

    def done(self) -> list[tuple[str, int, int, bool, str]]:
        self.close()
        self.end_block()
        return self.blocks


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    r = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    padded = np.pad(ratios, r, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


@dataclass(frozen=True)
class Settings:
    sigma: float = 1.0
    most: float = 0.6  # share of a container's mass that makes one inside it the region
    bare: float = 0.5  # what text without a paragraph of its own counts


def sums(values: list, parents: list) -> list:
    """Of each container, with all that it holds; a container's number is above its parent's."""
    out = list(values)
    for c in range(len(out) - 1, 0, -1):
        out[parents[c]] += out[c]
    return out


def region(lines: list, content: np.ndarray, parents: list, tag_of: list, s: Settings) -> list[bool]:
    """For each container: whether its own lines belong to the main text."""
    n = len(parents)
    mass, odd, paragraphs = [0.0] * n, [0] * n, [0] * n
    for (text, _, c, shut, kind), yes in zip(lines, content, strict=True):
        if shut:
            continue
        if yes:
            mass[c] += len(text) * (s.bare if kind == "bare" else 1.0)
        odd[c] += kind != "heading" and not (yes and kind == "text")
        paragraphs[c] += kind != "bare"
    total, odd, paragraphs = sums(mass, parents), sums(odd, parents), sums(paragraphs, parents)
    heaviest = [-1] * n
    for c in range(1, n):
        p = parents[c]
        if heaviest[p] < 0 or total[c] > total[heaviest[p]]:
            heaviest[p] = c
    at = 0
    while heaviest[at] >= 0 and total[at] > 0 and total[heaviest[at]] >= s.most * total[at]:
        at = heaviest[at]
    outermost, c = -1, at
    while c >= 0:
        outermost = c if tag_of[c] in REGION else outermost
        c = parents[c]
    page = ("", "html", "body")
    if outermost >= 0:
        at = outermost
    else:
        while tag_of[at] not in page and tag_of[parents[at]] not in page and odd[parents[at]] == odd[at]:
            at = parents[at]
    inside = [False] * n
    whole = tag_of[at] not in page
    # where no container holds most of the page: its articles, or else its own lines and what holds several lines of content
    articles = not whole and any(tag_of[c] in REGION and total[c] > 0 for c in range(n))
    for c in range(at, n):
        p = parents[c]
        if c == at:
            inside[c] = not articles
        elif p >= 0 and inside[p] and (whole or p != at):
            inside[c] = True
        elif articles:
            inside[c] = tag_of[c] in REGION and total[c] > 0
        elif p == at:
            inside[c] = total[c] > 0 and (paragraphs[c] > 1 or tag_of[c] in page)
    return inside


def main_blocks(html: str | None, settings: Settings | None = None) -> list[str]:
    s = settings or Settings()
    if not html:
        return []
    parser = Blocks()
    parser.feed(html)
    lines = parser.done()
    if not lines:
        return []
    ratios = np.array([0.0 if shut else len(text) / max(1, tags) for text, tags, _, shut, _ in lines])
    level = smooth(ratios, s.sigma)
    content = (level >= level.std()) & (ratios > 0)
    if not content.any():
        content = ratios > 0
    inside = region(lines, content, parser.parents, parser.tag_of, s)
    return [text for text, _, c, shut, _ in lines if not shut and inside[c]]


def extract(pages: DataFrame, settings: Settings | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html)."""
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in small_batches(batches, "html"):
            texts = ["\n\n".join(main_blocks(h, settings)) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
