"""Main text of web pages by smoothed text-to-tag ratios.

The standard parser reports the events of a page one by one.  Text between block
boundaries (tags of block elements and line breaks) is a line; a line has its
letters, its tags, and the element that holds it.  Text inside parts that are never
content (scripts, styles, menus, headers and footers of the page, sidebars, forms)
gives no line at all, and neither does an element whose class, id or role names an
advert, a notice or reader comments, unless it turns out to wrap the content: where
it holds an article that outweighs the cores outside such elements, or where these
have no core, it counts as a division like others (``opened``).

Each other line has a text-to-tag ratio; the ratios, with a Gaussian over the
neighbouring lines, are clustered by a threshold (a share of their standard
deviation).  Lines that reach it are the cores of regions.  A region is the element
that holds them (an article or main element, or else the nearest division): it is
content, headings and short lines too, when its cores hold at least half of its
letters, or when it is a marked article; where an article has a core, elements
outside all articles are no regions.  A division without a core belongs to its
neighbours: it is content between two content divisions of the same parent, or as a
heading before one.

White space inside a line becomes one space, lines are trimmed and joined by one
line feed.  Null and empty pages give an empty text.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from valsieve.llm.common import pieces, ship

#: Reach of the Gaussian in lines, and the share of the standard deviation that is the threshold.
SIGMA, SHARE = 1.0, 0.5
#: Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead "
    "title tr ul".split())
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no content of the page.
OUTSIDE = frozenset(
    "head script style template noscript nav aside footer form button select option textarea input iframe object embed svg math canvas "
    "audio video dialog menu".split())
#: Words in class, id or role that mark what is not content.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice\w*|gdpr|popup|modal|overlay|newsletter|"
    r"subscri\w*|signup|sidebar\w*|side-bar|menu\w*|nav|navbar|navigation|breadcrumb\w*|footer|masthead|comment\w*|disqus\w*|respond|replies|"
    r"reader-comments|related|recommend\w*|share|sharing|social\w*|widget\w*|toolbar|pagination|pager|skip-link|complementary|contentinfo|"
    r"search|login|alert\w*)(?:$|[\s_-])", re.IGNORECASE)
#: Beginnings of class names that tell how a page is laid out, not what an element is.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|no|not|with|without|layout)[_-]\S*", re.IGNORECASE)
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that can hold a region.
HOLDERS = frozenset("body center details div fieldset section td th".split())
SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Turns the events of one page into lines: text, number of tags, number of the holding element, in an article, in a heading."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool, bool]] = []  # name, outside, content, named as no content
        self.outside = self.content = self.holders = self.named = self.headings = 0
        self.holding: list[int] = [0]
        #: Holding element around each.
        self.parents: list[int] = [-1]
        #: Named elements around the present place, and those around the present article (None: it is named itself).
        self.marks: tuple[int, ...] = ()
        self.article: tuple[int, ...] | None = None
        self.parts: list[tuple[str, tuple[int, ...]]] = []
        self.tags = 1
        self.raw: list[tuple[list, int, int, bool, bool, tuple[int, ...] | None]] = []

    def end_line(self) -> None:
        if any(not data.isspace() for data, _ in self.parts):
            self.raw.append((self.parts, self.tags, self.holding[-1], self.content > 0, self.headings > 0, self.article))
            self.tags = 1
        self.parts = []

    def holds(self, name: str, content: bool) -> bool:
        """Inside an article the whole article is the holding element."""
        return (content and self.content == 0) or (name in HOLDERS and self.content == 0)

    def pop(self) -> None:
        name, outside, content, named = self.open.pop()
        self.outside -= outside
        self.content -= content
        self.headings -= name in HEADINGS
        if named:
            self.marks = self.marks[:-1]
        if not self.content:
            self.article = None
        if self.holds(name, content):
            self.holding.pop()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag in OUTSIDE or tag in CONTENT:
            self.end_line()
            if self.open and self.open[-1][0] == "p" and tag in BLOCKS and tag != "br":
                self.pop()
        self.tags += 1
        if tag in VOID:
            return
        marks = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        inside_content = tag in CONTENT
        outside = tag in OUTSIDE or (tag == "header" and not self.content)
        says = bool(marks and not outside and tag not in ("body", "html") and MARKED.search(LAYOUT.sub("", marks)))
        named = says and not inside_content
        if self.holds(tag, inside_content):
            self.holders += 1
            self.parents.append(self.holding[-1])
            self.holding.append(self.holders)
        self.open.append((tag, outside, inside_content, named))
        if named:
            self.named += 1
            self.marks = (*self.marks, self.named)
        if inside_content and not self.content:
            self.article = None if says else self.marks
        self.outside += outside
        self.content += inside_content
        self.headings += tag in HEADINGS

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS or tag in OUTSIDE or tag in CONTENT:
            self.end_line()
        self.tags += 1
        # An end without a start is ignored; it doesn't reach out of a block it doesn't belong to.
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self.pop()
                break
            if self.open[k][0] in BLOCKS and tag not in BLOCKS and tag not in OUTSIDE:
                break

    def handle_data(self, data):
        if not self.outside:
            self.parts.append((data, self.marks))

    def finish(self) -> list[tuple[str, int, int, bool, bool]]:
        self.close()
        self.end_line()
        wraps, lines, extra = opened(self.raw) if self.named else set(), [], 0
        for parts, tags, holder, content, heading, _ in self.raw:
            text = SPACE.sub(" ", "".join(data for data, marks in parts if wraps.issuperset(marks))).strip()
            if text:
                lines.append((text, tags + extra, holder, content, heading))
                extra = 0
            else:  # the tags of what is left out count for the next line
                extra += tags - 1
        return lines


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over neighbouring lines; at the edges over those that exist."""
    reach = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratios, kernel, mode="full")[reach:reach + len(ratios)]
    weight = np.convolve(np.ones(len(ratios)), kernel, mode="full")[reach:reach + len(ratios)]
    return total / weight


def cores(letters: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which lines reach the threshold."""
    smooth = smoothed(letters / tags)
    return smooth >= min(SHARE * smooth.std(), smooth.max())


def opened(raw: list) -> set[int]:
    """Elements named as no content that wrap the content of the page."""
    out: set[int] = set()
    if not raw:
        return out
    letters = np.array([sum(len(data.strip()) for data, _ in parts) for parts, *_ in raw], dtype=np.float64)
    # A line counts for the place of its longest part.
    place = [max(parts, key=lambda part: len(part[0].strip()))[1] for parts, *_ in raw]
    # Lines of one place are told from their own ratios: without the Gaussian, so that neighbours lend them nothing.
    ratios = letters / np.array([tags for _, tags, *_ in raw])
    core = ratios >= min(ratios.mean(), ratios.max())
    article = [marks is not None and marks == at for (*_, marks), at in zip(raw, place, strict=True)]
    while True:
        free = [out.issuperset(at) for at in place]
        if any(f and a for f, a in zip(free, article, strict=True)):
            return out
        held = sum(n for n, c, f in zip(letters, core, free, strict=True) if c and f)
        whole: dict[int, float] = {}
        inside: dict[int, float] = {}
        for n, at, a, f in zip(letters, place, article, free, strict=True):
            if not f:
                outermost = next(m for m in at if m not in out)
                whole[outermost] = whole.get(outermost, 0.0) + n
                inside[outermost] = inside.get(outermost, 0.0) + n * a
        best = max(inside, key=lambda m: inside[m], default=None)
        if best is None:
            return out
        if inside[best] <= held or not inside[best]:
            if held:
                return out
            best = max(whole, key=lambda m: whole[m])
            # A lone line is an advert or notice and no wrapper.
            if sum(best in at for at in place) < 2 or not any(c and best in at for c, at in zip(core, place, strict=True)):
                return out
        out.add(best)


def regions(lines: list[tuple[str, int, int, bool, bool]], parents: list[int]) -> list[bool]:
    """Which lines are content."""
    if not lines:
        return []
    letters = np.array([len(text) for text, *_ in lines], dtype=np.float64)
    core = cores(letters, np.array([tags for _, tags, *_ in lines]))
    holder = np.array([h for _, _, h, *_ in lines])
    marked = np.array([m for *_, m, _ in lines])
    if (core & marked).any():
        return np.isin(holder, holder[core & marked]).tolist()
    held = np.bincount(holder, weights=letters * core) * 2 >= np.bincount(holder, weights=letters)
    kept = (held[holder] & np.isin(holder, holder[core])).tolist()
    return neighbours(kept, holder.tolist(), [h for *_, h in lines], parents)


def neighbours(kept: list[bool], holder: list[int], heading: list[bool], parents: list[int]) -> list[bool]:
    """``kept`` with the runs of lines between kept lines of sibling elements, and with headings before one."""
    def family(i: int) -> tuple[int, int]:
        return holder[i], parents[holder[i]]

    out, i = list(kept), 0
    while i < len(out):
        if kept[i]:
            i += 1
            continue
        stop = i
        while stop < len(out) and not kept[stop]:
            stop += 1
        around = {parents[holder[k]] for k in range(i, stop)}
        if stop < len(out) and len(around) == 1:
            parent = next(iter(around))
            if i and parent in family(i - 1) and parent in family(stop):
                out[i:stop] = [True] * (stop - i)
        k = stop - 1
        while stop < len(out) and k >= i and heading[k] and parents[holder[k]] in family(stop):
            out[k] = True
            k -= 1
        i = stop
    return out


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    lines = parser.finish()
    return "\n".join(text for (text, *_), kept in zip(lines, regions(lines, parser.parents), strict=True) if kept)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points)."""
    ship(pages.sparkSession)

    def task(batches):
        for batch in pieces(batches, "html", 2 << 20):
            texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint"
    return pages.select("page_id", "url", "html").mapInArrow(task, schema)
