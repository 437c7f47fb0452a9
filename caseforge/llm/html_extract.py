"""Main text of web pages.

The standard library's parser streams a page as events. A block element starts a line; each
line has its text, its number of tags (without those of excluded elements) and the containers it stands in. Lines in elements that
never hold the article (menus, forms, scripts ... by tag, adverts, notices, comments ... by
class, id or role) are out; names that articles use, too ("side-effects", "related-work"), put a
block out only if it is mostly links or none of it is content. Within article and main that goes for each name that says more
than what is out ("comments-on-the-act", "notice-period"), only for its links: one made of such words alone ("comments", "ad-slot") is out there. On the others the text-to-tag ratio is smoothed by a Gaussian and
split in two clusters; containers are scored by the upper cluster's text in their whole subtree.
The content region is what main holds, else what the outermost articles hold (if that is a
quarter of the page's score or more), else the smallest block that holds nearly all of it; each line of its
subtree stays, short ones, lists, quotes, code, tables and sections too. Pages are independent
rows; nothing is shuffled.

Cases. A null or empty page, or one without text outside the excluded elements, gives an empty
text. Rows that repeat an id are rows of their own. Unclosed elements end with their container; one that is out and
never closed ends where main or an article begins in it. Work is linear in the page, however deep its elements are.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their role in a page.
OUT_TAGS = frozenset("head nav header footer aside form script style noscript template iframe svg canvas button select textarea dialog menu object".split())
BLOCK_TAGS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REGION_TAGS = ("article", "main")
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|alert|comments?|reply|replies|disqus|sidebar|menu|nav\w*|masthead|footer|"
    r"breadcrumbs?|sharing|social|newsletter|subscribe|signup|login|popup|modal|overlay|pagination|pager|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
#: Names that articles use in their own blocks, too. Such a block is out if half of its text is links or none of it is content.
DOUBTFUL_NAMES = re.compile(r"(?:^|[\s_-])(?:side|header|share|related|recommend\w*|toolbar|widget|skip|search|form)(?:$|[\s_-])", re.I)
#: Words that say nothing of what a block holds, beside a name that is out.
PLAIN_NAMES = frozenset("area block body box column container content group holder inner item items left list outer panel right row section slot top bottom unit widget wrap wrapper".split())
#: Share of the score that the outermost main or articles need to be the region; share that a block needs to stand for its parent.
REGION_SHARE, NEARLY = 0.25, 0.95
#: Share of links in the text that a block with a doubtful name is out with.
LINKED = 0.5
SMOOTH = np.exp(-0.5 * np.arange(-2, 3) ** 2)
SMOOTH /= SMOOTH.sum()


class _Lines(HTMLParser):
    """One pass over a page. ``broken`` are the out elements, by their number among all elements, that end where main or an article begins in them."""

    def __init__(self, broken: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        #: Open elements: tag, 1 if it is out, number of the container, of the element. How many of each tag are open, how many headings, and articles or mains.
        self.open: list[tuple[str, int, int, int]] = []
        self.of_tag: Counter[str] = Counter()
        self.out = self.headings = self.in_region = self.elements = 0
        #: How many regions had begun when each open out element did; those that were never closed and in which one began; places of the open broken ones.
        self.outs: list[int] = []
        self.begun, self.unclosed = 0, set()
        self.broken, self.broken_at = broken, []
        #: Of each container the one around it; those of main, and of article or main, that aren't out.
        self.around: list[int] = [0]
        self.mains: set[int] = set()
        self.regions: set[int] = set()
        #: Containers with a doubtful name; those within a region that have more to their name than what is out.
        self.doubtful: set[int] = set()
        self.more: set[int] = set()
        #: Text, tags, container, whether it is a heading; and of each line the characters in links.
        self.lines: list[tuple[str, int, int, bool]] = []
        self.linked: list[int] = []
        self.text: list[str] = []
        self.links = self.in_link = 0
        self.tags = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            container = self.open[-1][2] if self.open else 0
            self.lines.append((text, self.tags, container, self.headings > 0))
            self.linked.append(self.links)
            self.tags = 0
        self.text, self.links = [], 0

    def _pop(self, closed: bool = False) -> None:
        tag, out, _, number = self.open.pop()
        self.out -= out
        self.in_link -= tag == "a"
        self.of_tag[tag] -= 1
        self.headings -= tag in HEADINGS
        self.in_region -= tag in REGION_TAGS
        if out and self.outs.pop() < self.begun and not closed:
            self.unclosed.add(number)
        if number in self.broken:
            self.broken_at.pop()

    def handle_starttag(self, tag, attrs):
        if tag in VOID_TAGS:
            self.text.append(" ")
            self.tags += not self.out
            return
        block = tag in BLOCK_TAGS
        if block:
            self._end_line()
            if tag == "body":
                while self.open and self.open[-1][0] == "head":
                    self._pop()
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == "p" or self.open[i][0] in BLOCK_TAGS), -1)
            if at >= 0 and self.open[at][0] == "p":
                while len(self.open) > at:
                    self._pop()
        if tag in REGION_TAGS:
            while self.broken_at:
                self._pop()
            self.begun += 1
        named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "aria-label"))
        by_name = bool(named and tag not in ("html", "body", *REGION_TAGS) and OUT_NAMES.search(named))
        more = by_name and self.in_region > 0 and not _only_out(named)
        out = int(tag in OUT_TAGS or by_name and not more)
        container = self.open[-1][2] if self.open else 0
        doubtful = block and (more or tag not in ("html", "body", *REGION_TAGS) and bool(named and DOUBTFUL_NAMES.search(named)))
        if doubtful or block and tag != "p" and not re.fullmatch(r"h\d|li|t[drh]|d[dt]", tag):
            self.around.append(container)
            container = len(self.around) - 1
            if doubtful:
                (self.more if more else self.doubtful).add(container)
        self.elements += 1
        if self.elements in self.broken:
            self.broken_at.append(len(self.open))
        self.open.append((tag, out, container, self.elements))
        self.of_tag[tag] += 1
        self.headings += tag in HEADINGS
        self.in_region += tag in REGION_TAGS
        if out:
            self.outs.append(self.begun)
        self.out += out
        self.in_link += tag == "a"
        if tag in REGION_TAGS and not self.out:
            self.regions.add(container)
            if tag == "main":
                self.mains.add(container)
        self.tags += not self.out

    def handle_endtag(self, tag):
        block = tag in BLOCK_TAGS
        if block:
            self._end_line()
        self.tags += not self.out
        for i in range(len(self.open) - 1, -1, -1) if self.of_tag[tag] else ():
            if self.open[i][0] == tag:
                while len(self.open) > i + 1:
                    self._pop()
                self._pop(closed=True)
                break
            if not block and self.open[i][0] in BLOCK_TAGS:
                break

    def handle_data(self, data):
        if not self.out:
            self.text.append(data)
            if self.in_link:
                self.links += len(data.strip())

    def close(self):
        super().close()
        self._end_line()
        while self.open:
            self._pop()


def _only_out(named: str) -> bool:
    """Whether names hold nothing but words that are out, and plain ones."""
    return all(w.isdigit() or w.lower() in PLAIN_NAMES or OUT_NAMES.fullmatch(w) for w in re.split(r"[\s_-]+", named.strip()) if w)


def _read(html: str, broken: frozenset[int] = frozenset()) -> _Lines:
    page = _Lines(broken)
    page.feed(html)
    page.close()
    return page


def smoothed_ratio(lines: list[tuple[str, int, int, bool]]) -> np.ndarray:
    ratio = np.log1p(np.array([len(text) / max(1, tags) for text, tags, _, _ in lines]))
    return np.convolve(np.pad(ratio, 2, mode="edge"), SMOOTH, "valid")


def upper_cluster(x: np.ndarray) -> np.ndarray:
    """The members of the upper of two clusters; all, if there aren't two."""
    low, high = x.min(), x.max()
    if high - low < 0.5:
        return np.ones(len(x), bool)
    for _ in range(20):
        upper = x >= (low + high) / 2
        if (low, high) == (centres := (x[~upper].mean(), x[upper].mean())):
            break
        low, high = centres
    return upper


def main_text(html: str | None) -> str:
    page = _read(html or "")
    if page.unclosed:
        page = _read(html or "", frozenset(page.unclosed))
    lines = page.lines
    if not lines:
        return ""
    content = upper_cluster(smoothed_ratio(lines))
    own, below = [0] * len(page.around), [0] * len(page.around)
    #: Containers whose own lines hold a heading or upper-cluster text.
    leads, upper = set(), 0
    for (text, _, container, heading), c in zip(lines, content):
        own[container] += len(text) * bool(c)
        upper += len(text) * bool(c)
        if heading or c:
            leads.add(container)
    for k in range(len(own) - 1, -1, -1):
        below[k] += own[k]
        if k:
            below[page.around[k]] += below[k]
    #: Outermost region of each container; containers are numbered after the ones around them.
    outermost = [0] * len(own)
    for k in range(1, len(own)):
        outermost[k] = outermost[page.around[k]] or (k if k in page.regions else 0)
    tops = {k for k in page.regions if outermost[k] == k and below[k]}
    tops = {outermost[k] for k in page.mains if below[k]} or tops
    if not tops or sum(below[k] for k in tops) < REGION_SHARE * upper:
        tops = {_smallest(page.around, below, leads)}
    inside = [k in tops for k in range(len(own))]
    refused = _refused(page, below)
    for k in range(1, len(own)):
        inside[k] = (inside[k] or inside[page.around[k]]) and k not in refused
    return "\n\n".join(text for text, _, container, _ in lines if inside[container])


def _refused(page: _Lines, below: list[int]) -> set[int]:
    """The containers with a doubtful name that are mostly links or without upper-cluster text; those within a region that are mostly links."""
    if not page.doubtful and not page.more:
        return set()
    text, links = [0] * len(below), [0] * len(below)
    for (line, _, container, _), linked in zip(page.lines, page.linked):
        text[container] += len(line)
        links[container] += linked
    for k in range(len(below) - 1, 0, -1):
        text[page.around[k]] += text[k]
        links[page.around[k]] += links[k]
    return {k for k in page.doubtful if not below[k] or links[k] >= LINKED * text[k]} | {k for k in page.more if links[k] >= LINKED * max(1, text[k])}


def _smallest(around: list[int], below: list[int], leads: set[int]) -> int:
    """The smallest container that holds nearly all of the score and has no heading or upper-cluster line beside its parts."""
    inner: dict[int, list[int]] = {}
    for k in range(1, len(around)):
        inner.setdefault(around[k], []).append(k)
    at = 0
    while at not in leads and at in inner:
        best = max(inner[at], key=lambda k: below[k])
        if below[best] < NEARLY * below[0]:
            break
        at = best
    return at


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: its id, url, main text and the text's code points."""
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))

    def extract(batches):
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = f"page_id {p.schema['page_id'].dataType.simpleString()}, url {p.schema['url'].dataType.simpleString()}, text string, n_chars long"
    return p.mapInArrow(extract, schema)
