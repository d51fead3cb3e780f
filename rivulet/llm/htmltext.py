"""Main text of web pages by composite text density (Sun, Song, Liao: DOM based content extraction via text density, 2011).

A page becomes a tree of elements, with the end tags that HTML lets authors leave out. For each element C characters and
T tags, LC characters and LT tags of links give its density, C / T times the logarithm of (C / LC) (T / LT) to a base that
grows with the share of links in the element and in the page; bases are kept above 1. Elements that only mark words
(b, em, span) count as no tags. An element's density sum is that of its children, its own text being one child.

The element of maximum sum is where the content is. The least density on its path up to the body is the threshold: every
element from the body down that reaches it contributes the element of maximum sum in its subtree. If that lies in an
article element, the content is the whole article instead. Of the content all blocks are kept, in page order.

Before densities are taken, what is no content by its element (nav, aside, form, script, ...), its role, its class or
id (words such as sidebar, cookie, comment) or because it is hidden goes with all below it. Wrappers are not mistaken for
what they wrap: a class or a form removes no element that holds an article or the main element; in a page without these,
none that holds more of the page's text than there is outside of such elements, but for comments. A header inside an article stays if it holds a heading.

Character references are decoded after the markup is cut, white space (as Unicode has it, no-break spaces too) becomes one
space inside a block, and blocks are joined by line feeds; br and inline elements end no block. Null and empty pages and
pages without text give the empty text. Text without any element is one block. Repeated rows stay; an empty table gives
none. Other columns are ignored. A page is handled whole, in time that grows with its length, in one task.
"""

from __future__ import annotations

import html as references
import math
import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import pieces, table

SCHEMA = "page_id long, url string, text string, n_chars long"

# Fixed values of HTML: elements without content, with raw text, inline, and what a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
    search section select summary table tbody td tfoot th thead tr ul""".split()
)
IN_HEAD = frozenset("head meta link title style script base noscript template".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
SCOPES = frozenset("table td th caption html body".split())
IN_TABLE = frozenset("tbody td tfoot th thead tr caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# Elements, roles and words of a class or an id that mark what is not the article.
DROPPED = frozenset(
    """head script style noscript template nav aside footer form button select textarea input iframe object embed svg
    canvas audio video map menu dialog datalist search noembed noframes xmp""".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
COMMENTS = frozenset("comment comments commentlist commentform disqus replies respond".split())
MARKS = COMMENTS | frozenset(
    """ad ads adsense advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner
    cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar
    sidebars nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination header masthead footer copyright
    share sharing social related recommended recommendations toolbar login search widget widgets skip""".split()
)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)([^<>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'<>=`]++)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", name, attributes) and ("end", name, "") in order; comments and the like are left out."""
    at, n = 0, len(page)
    while at < n:
        low = page.find("<", at)
        if low < 0:
            break
        if low > at:
            yield "text", page[at:low], ""
        if m := _TAG.match(page, low) or _LOOSE.match(page, low):
            name, at = m[2].lower(), m.end()
            yield ("end" if m[1] else "start"), name, m[3]
            if name in RAW and not m[1]:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                at = close.start() if close else n
        elif page.startswith("<!--", low):
            end = page.find("-->", low + 2)  # "<!-->" is a whole comment
            at = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), low) or (page.startswith("</", low) and not page[low + 2 : low + 3].isalpha()):
            end = page.find(">", low)
            at = n if end < 0 else end + 1
        else:
            yield "text", "<", ""
            at = low + 1
    if at < n:
        yield "text", page[at:], ""


def attributes(text: str) -> dict[str, str]:
    """Lower-case names with their first values."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), references.unescape(m[2] or m[3] or m[4] or ""))
    return out


class Page:
    """Elements in the order of their start tags; the parent of each comes before it. Texts belong to elements and blocks."""

    def __init__(self, page: str):
        self.names, self.parents, self.given = ["#page"], [-1], [""]
        self.texts: list[tuple[int, int, str]] = []  # element, block, text
        self.block = 0
        self._open = [0]
        self._at: dict[str, list[int]] = defaultdict(list, {"#block": [0]})  # places in _open by name, and of all blocks
        for kind, value, given in tokens(page):
            if kind == "text":
                if "&" in value:
                    value = references.unescape(value)
                if value:
                    self.texts.append((self._open[-1], self.block, value))
            elif kind == "start":
                self._start(value, given)
            else:
                self._end(value)
        self.sizes = [len(" ".join(x.split())) for _, _, x in self.texts]

    def _pop(self, to: int) -> None:
        """Close the open elements from this place of the stack on."""
        for i in self._open[to:]:
            name = self.names[i]
            self._at[name].pop()
            if name in BLOCKS:
                self._at["#block"].pop()
        del self._open[to:]

    def _last(self, names: Iterable[str]) -> int:
        return max((self._at[x][-1] for x in names if self._at[x]), default=0)

    def _close(self, names: Iterable[str], stops: Iterable[str]) -> None:
        """Close up to the outermost open element of these names that is inside of all stops."""
        stop = self._last(stops)
        inside = [own[bisect(own, stop)] for x in names if (own := self._at[x]) and own[-1] > stop]
        if inside:
            self._pop(min(inside))

    def _start(self, name: str, given: str) -> None:
        at = self._at
        if at["head"] and name not in IN_HEAD:
            self._pop(at["head"][0])
        if name in BLOCKS:
            self.block += 1
            if at["p"] and at["p"][-1] == at["#block"][-1]:
                self._pop(at["p"][-1])
            if name in HEADINGS and self.names[self._open[at["#block"][-1]]] in HEADINGS:
                self._pop(at["#block"][-1])
            if name in ENDS:
                self._close(*ENDS[name])
        elif name == "a" and at["a"] and at["a"][-1] > at["#block"][-1]:
            self._pop(at["a"][-1])
        elif name == "br":
            self.texts.append((self._open[-1], self.block, " "))
        if name in ("html", "body") and at[name]:
            return
        self.names.append(name)
        self.parents.append(self._open[-1])
        self.given.append(given)
        if name not in VOID:
            at[name].append(len(self._open))
            if name in BLOCKS:
                at["#block"].append(len(self._open))
            self._open.append(len(self.names) - 1)

    def _end(self, name: str) -> None:
        own = self._at[name]
        if name not in BLOCKS:
            if own and own[-1] > self._at["#block"][-1]:
                self._pop(own[-1])
            return
        self.block += 1
        stops = ("table",) if name in IN_TABLE else () if name == "table" else SCOPES
        if own and name not in ("html", "body") and own[-1] >= self._last(stops):
            self._pop(own[-1])

    def below(self, values: list[int]) -> list[int]:
        """Sums over each element and all below it."""
        out = list(values)
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] += out[i]
        return out

    def spread(self, marked: list[bool]) -> list[bool]:
        """Marked, or below what is."""
        out = list(marked)
        for i in range(1, len(out)):
            out[i] = out[i] or out[self.parents[i]]
        return out


def _marked(name: str, given: dict[str, str]) -> tuple[bool, bool]:
    """Whether an element is no content by its class, id, role or hiding, and whether it holds comments."""
    if name in ("html", "body", "main", "#page"):
        return False, False
    words = {w.lower() for w in _WORDS.findall(given.get("class", "") + " " + given.get("id", ""))}
    hidden = "hidden" in given or bool(_HIDING.search(given.get("style", "")))
    return hidden or given.get("role", "").lower() in ROLES or bool(words & MARKS), bool(words & COMMENTS)


def _gone(page: Page) -> list[bool]:
    """What is no content, with all below it."""
    names, n = page.names, len(page.names)
    by_name = [x in DROPPED and x != "form" for x in names]
    inside = page.spread([x in ("article", "main") for x in names])
    heads = page.below([x in HEADINGS for x in names])
    marks = [(False, False)] * n
    for i in range(n):
        given = page.given[i]
        if names[i] == "header":
            by_name[i] = not (inside[i] and heads[i])
        elif given:
            marks[i] = _marked(names[i], attributes(given))
        if names[i] == "form":
            marks[i] = (True, marks[i][1])
    if not any(m for m, _ in marks):
        return page.spread(by_name)
    wrapped = page.below([x == "main" or x == "article" and not marks[i][0] for i, x in enumerate(names)])
    drop = [False] * n
    for i, (mark, _) in enumerate(marks):
        header = inside[i] and heads[i] and "header" in page.given[i].lower()
        drop[i] = mark and not header and not wrapped[i] - (names[i] == "article" and not mark)
    if not wrapped[0]:
        for i in _wrappers(page, page.spread(by_name), drop, [c for _, c in marks]):
            drop[i] = False
    return page.spread([x or y for x, y in zip(by_name, drop, strict=True)])


def _wrappers(page: Page, gone: list[bool], marked: list[bool], comments: list[bool]) -> Iterator[int]:
    """Marked elements that hold the page's text: the largest, as long as it has more than what no marked element holds."""
    n = len(marked)
    nearest, chars, own = [-1] * n, [0] * n, [0] * (n + 1)  # own[-1]: outside of all marked elements
    inner: dict[int, list[int]] = defaultdict(list)
    for i in range(n):
        above = nearest[page.parents[i]] if i else -1
        nearest[i] = i if marked[i] else above
        if marked[i]:
            inner[above].append(i)
    for (i, _, _), size in zip(page.texts, page.sizes, strict=True):
        if not gone[i]:
            chars[i] += size
            own[nearest[i]] += size
    chars = page.below(chars)
    heap, free = [], own[-1]
    found = -1
    while True:
        for i in inner[found]:
            if not comments[i]:
                heappush(heap, (-chars[i], i))
        if not heap or -heap[0][0] <= free:
            return
        _, found = heappop(heap)
        free += own[found]
        yield found


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density; share is that of link characters in the page."""
    if not chars:
        return 0.0
    c, t, lc, lt = chars, max(1, tags), max(1, link_chars), max(1, link_tags)
    base = 1 + math.log(c / max(1, c - link_chars) * link_chars + share * c + math.e)
    return c / t * max(0.0, math.log(c / lc * t / lt)) / math.log(base)


def chosen(page: Page, gone: list[bool]) -> list[bool]:
    """The elements of the content."""
    names, parents, n = page.names, page.parents, len(page.names)
    linked = page.spread([x == "a" for x in names])
    chars, links = [0] * n, [0] * n
    for (i, _, _), size in zip(page.texts, page.sizes, strict=True):
        if not gone[i]:
            chars[i] += size
            links[i] += size * linked[i]
    tag = [int(not gone[i] and (x in BLOCKS or x in ("a", "img"))) for i, x in enumerate(names)]
    all_chars, all_links = page.below(chars), page.below(links)
    tags, link_tags = page.below(tag), page.below([t * linked[i] for i, t in enumerate(tag)])
    if not all_chars[0]:
        return [False] * n
    share = all_links[0] / all_chars[0]
    dense = [density(all_chars[i], tags[i] - tag[i], all_links[i], link_tags[i] - tag[i] * linked[i], share) for i in range(n)]
    total = [density(chars[i], 1, links[i], 1, share) / max(1, tags[i] - tag[i]) for i in range(n)]
    for i in range(1, n):
        total[parents[i]] += dense[i]
    best = list(range(n))  # element of maximum sum in each subtree, the outer of equals
    for i in range(n - 1, 0, -1):
        p = parents[i]
        if total[best[i]] > total[best[p]] or total[best[i]] == total[best[p]] and best[p] != p and best[i] < best[p]:
            best[p] = best[i]
    top, article = best[0], None
    threshold, i = dense[top], top
    while i >= 0:
        if dense[i] > 0:
            threshold = min(threshold, dense[i])
        if names[i] == "article":
            article = i
        if names[i] == "body":
            break
        i = parents[i]
    if article is not None:
        return page.spread([i == article for i in range(n)])
    reached, mark = [False] * n, [False] * n
    reached[0] = True
    for i in range(n):
        reached[i] = not i or (reached[parents[i]] and not gone[i])
        if reached[i] and dense[i] >= threshold:
            mark[best[i]] = True
    return page.spread(mark)


def main_text(html: str | None) -> str:
    """The blocks of the content, a line each."""
    page = Page(html or "")
    gone = _gone(page)
    content = chosen(page, gone)
    blocks: dict[int, list[str]] = {}
    for i, block, text in page.texts:
        if content[i] and not gone[i]:
            blocks.setdefault(block, []).append(text)
    return "\n".join(x for x in (" ".join("".join(b).split()) for b in blocks.values()) if x)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, SCHEMA)


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
