"""Main text of web pages by text-to-tag ratios.

A streaming parser (``html.parser``) turns a page into lines: runs of text between
block-level tags.  A line's ratio is characters of text for each tag before or in
it; link text counts as none, and what stands in a menu, header, footer, sidebar,
notice, advert, form or comment counts a small share (``MARKED``).  The square roots
are smoothed by a Gaussian over neighbouring lines, less so across the border of two
regions (elements such as ``div`` that hold lines), and a threshold between two
clusters splits them.  A region is content if its characters' mean ratio reaches
the threshold; all lines of a content region are text, short ones too.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names of HTML's elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style noscript template head title iframe object svg canvas select textarea button audio video math map datalist".split())
MENUS = frozenset("nav footer aside form dialog menu".split())
SECTIONS = frozenset("article main section".split())
REGIONS = SECTIONS | MENUS | frozenset("html body div header td details fieldset".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HIDDEN_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class or id that mark what is not the article.
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|aside|footer|header|masthead|cookie|cookies|consent|notice|gdpr|newsletter|subscribe|signup|social|share|sharing|comment|comments|disqus|replies|respond|related|recommended|popup|modal|widget|pagination|pager|skip|toolbar|legal|copyright)(?:$|[\s_-])",
    re.IGNORECASE,
)
_SPACE = re.compile(r"\s+")
#: What a marked character counts, what a neighbour across a region's border counts, and the least ratio of any content.
MARKED, BORDER, LEAST = 0.03, 0.1, 1.2


class Lines(HTMLParser):
    """Collects lines as ``[text, tags, link characters, marked, region]`` from parser events; ``regions`` holds each region's parent and mark."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.regions: list[tuple[int, bool]] = [(-1, False)]
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.open: list[tuple[str, bool, bool, int]] = []  # tag, silences, marks, region outside
        self.silent = self.marked = self.links = self.sections = self.region = 0

    def _end_line(self):
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.lines.append([text, self.tags, self.linked, self.marked > 0, self.region])
            self.tags = self.linked = 0
        self.parts = []

    @staticmethod
    def _hidden(attrs) -> bool:
        return any(name == "hidden" or name == "aria-hidden" and (value or "").lower() == "true" or name == "style" and "display:none" in (value or "").replace(" ", "").lower() for name, value in attrs)

    def _marks(self, tag, attrs) -> bool:
        if tag in MENUS or tag == "header" and not self.sections:
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        return any(name in ("class", "id") and BOILERPLATE.search(value or "") or name == "role" and (value or "").lower() in HIDDEN_ROLES for name, value in attrs)

    def _pop(self):
        tag, silences, marks, region = self.open.pop()
        self.silent -= silences
        self.marked -= marks
        self.links -= tag == "a"
        self.sections -= tag in SECTIONS
        self.region = region
        return tag

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in INLINE:
            self._end_line()
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self._close_implied({"p"}, CLOSES_P - {"p"})
        if tag in CLOSED_BY_OWN:
            self._close_implied(CLOSED_BY_OWN[tag], {"ul", "ol", "dl", "table", "select"})
        silences, marks = tag in SILENT or self._hidden(attrs), self._marks(tag, attrs)
        self.open.append((tag, silences, marks, self.region))
        self.silent += silences
        self.marked += marks
        self.links += tag == "a"
        self.sections += tag in SECTIONS
        if marks or tag in REGIONS:
            self.regions.append((self.region, self.marked > 0))
            self.region = len(self.regions) - 1

    def _close_implied(self, names, stop):
        """Close the innermost element of ``names``, with inline elements in it, unless ``stop`` stands between."""
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in names:
                while len(self.open) > k:
                    self._pop()
                return
            if self.open[k][0] in stop or self.open[k][1]:
                return

    def handle_startendtag(self, tag, attrs):
        self.tags += 1
        if tag not in INLINE:
            self._end_line()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self._end_line()
        if any(t[0] == tag for t in self.open):
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())

    def finish(self):
        self.close()
        self._end_line()
        return self.lines


def ratios(lines: list[list]) -> list[float]:
    """Square roots of characters outside links for each tag, so that no long line outweighs all others; those of marked lines count a small share."""
    return [math.sqrt((len(text) - linked) / max(1, tags) * (MARKED if marked else 1.0)) for text, tags, linked, marked, _ in lines]


def smoothed(values: list[float], regions: list[int], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing; a neighbour in another region counts ``BORDER`` of its weight, and none stand beyond the ends."""
    reach = max(1, math.ceil(2 * sigma))
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i, own in enumerate(regions):
        near = [(values[j], weights[j - i + reach] * (1.0 if regions[j] == own else BORDER)) for j in range(max(0, i - reach), min(len(values), i + reach + 1))]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def threshold(values: list[float]) -> float:
    """Between two clusters: the mean of their means, from least and greatest on until it stays."""
    cut = (min(values) + max(values)) / 2
    for _ in range(50):
        low, high = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not low or not high:
            return min(values)
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if new == cut:
            break
        cut = new
    return cut


def content_regions(lines: list[list], regions: list[tuple[int, bool]], sigma: float = 1.0) -> set[int]:
    """Regions whose characters' mean ratio, smoothed, reaches the threshold; inside these also unmarked ones whose own mean is no less than the least."""
    raw, least = ratios(lines), math.sqrt(LEAST)
    ratio = smoothed(raw, [line[4] for line in lines], sigma)
    cut = max(threshold(ratio), least)
    total: dict[int, list[float]] = {}
    for line, own, r in zip(lines, raw, ratio):
        weight = len(line[0]) - line[2] + 1
        sums = total.setdefault(line[4], [0.0, 0.0, 0.0])
        for k, x in enumerate((weight * r, weight * own, weight)):
            sums[k] += x
    found = set()
    for i, (parent, marked) in enumerate(regions):  # parents come first
        if i in total:
            mean, own = total[i][0] / total[i][2], total[i][1] / total[i][2]
            if mean >= cut or not marked and parent in found and own >= least:
                found.add(i)
    return found


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The lines of the page's content regions in page order; empty if there are none."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    lines = parser.finish()
    if not lines:
        return ""
    content = content_regions(lines, parser.regions, sigma)
    return "\n".join(line[0] for line in lines if line[4] in content)


@F.arrow_udf(T.StringType())
def _main_text(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extract(pages: DataFrame, html_col: str = "html", to: str = "text") -> DataFrame:
    """``pages`` with the main text of each in column ``to`` (replaced if there).

    Null and empty pages have an empty text; broken markup is read as far as it
    goes; repeated rows come back each; an empty table gives none.  Pages of any
    length and depth are read whole, one at a time; of lines as good as each other all
    are content.  Other columns, whatever their names, stay as they are.
    """
    return pages.withColumn(to, _main_text.asNondeterministic()(F.col(html_col)))


def op9_html(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
