"""Main text of web pages by composite text density.

A page becomes a tree. For every node C and T count the characters and tags below it, LC and LT those of links. Its composite density is

    C / T * log(C T / (LC LT)) / log(ln(C LC / (C - LC) + LCb C / Cb + e)),

b standing for the body (Sun, Song, Liao: "DOM based content extraction via text density", 2011); zero counts of links are one. The
block with the largest sum of its children's densities is the core of the text; the text that stands in it between its inner blocks,
inline elements included, is a child of its share of the density. The least density on the path from the core to the body is the threshold: as
long as a sibling of the chosen subtree reaches it, the parent is chosen. Before that go elements that are no text of the article by
name, role or class: menus, headers (but not an article's), footers, sidebars, notices, adverts, forms, scripts, styles and comments.
Classes and ids are taken name by name; one that tells of a state or layout (has-sidebar, no-menu, search-results) marks nothing, and a
mark that containers of articles bear as well (sidebar, widget, promo and such) doesn't remove what holds most of the page's text.

The text is taken block by block: character references decoded, white space as one blank, blocks and line breaks joined by a line
end. Pages are taken one by one, without a shuffle, in time linear in their length.

Edge cases: null and empty pages and pages without a body of text give the empty text; unclosed and stray tags are closed and
skipped as browsers do; drawings and formulas that are closed in themselves or never end only themselves; repeated rows give equal texts; pages of any length are read whole; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_batches, table

#: A comment, a declaration, or a tag with its name and attributes; possessive, so that nothing is tried twice.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
GONE = frozenset("head nav footer aside form button select option input fieldset dialog menu object embed applet canvas audio video map".split())
WHOLE = frozenset(["article", "main"])
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id that mark what is no text of the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar comment comments disqus reply replies respond "
    "related recommended share sharing social newsletter subscribe subscription signup popup popups modal overlay widget widgets toolbar copyright "
    "pagination pager skip login search".split()
)
#: Marks that containers of articles bear as well.
WEAK = frozenset("sidebar sidebars widget widgets search related recommended share sharing social promo promotion masthead topbar modal overlay toolbar copyright skip login".split())
#: Words that begin a name of a state or layout, or stand before a mark in one.
STATES = frozenset("has have no not with without is are hide show enable disable".split())
#: What makes search a box and not what was found.
BOXES = frozenset("form box bar field input button toggle widget container wrapper icon".split())
#: Elements of other languages, which may be closed in themselves.
FOREIGN = frozenset(["svg", "math"])
NONE, SOFT, HARD = 0, 1, 2
REMARKS = frozenset("comment comments disqus reply replies respond".split())
#: What an opening tag closes if it is open in the same scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


FOREIGN_TAG = {name: re.compile(rf"<(/?){name}\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>", re.I) for name in FOREIGN}


class Tree:
    """Nodes in page order with their parents and ends, and the texts and breaks between tags."""

    def __init__(self, page: str):
        self.tags, self.parent, self.end, self.mark = ["#"], [-1], [0], [NONE]
        self.events: list[tuple[int, str | None]] = []
        self.open = [0]
        self.depths: dict[str, list[int]] = {}  # where in the stack each tag is open
        self.blocks = [0]  # and where those are that aren't inline
        at, last = 0, page.rfind(">") + 1  # no tag ends behind it
        foreign: dict[str, dict[int, int]] = {}
        while m := TOKEN.search(page, at, last):
            self.text(page[at : m.start()])
            at = m.end()
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                at = len(page)
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            if m[1] or m[4]:
                self.close(name)
                continue
            attributes = m[3] or m[6] or ""
            self.start(name, attributes)
            if name in RAW:
                if name not in FOREIGN:
                    stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                    at = stop.end() if stop else len(page)
                elif not attributes.endswith("/"):
                    if name not in foreign:
                        foreign[name] = self.foreign_ends(page, name, last)
                    at = foreign[name].get(m.start(), at)
                self.pop()
        self.text(page[at:].partition("<!--")[0])
        while self.open:
            self.pop()
        self.gone = self.settled()

    @staticmethod
    def foreign_ends(page: str, name: str, last: int) -> dict[int, int]:
        """Where each drawing or formula that ends does so, by where it begins; others of its kind may stand inside it."""
        ends, open_ = {}, []
        for m in FOREIGN_TAG[name].finditer(page, 0, last):
            if m[1]:
                if open_:
                    ends[open_.pop()] = m.end()
            elif not m[0].endswith("/>"):
                open_.append(m.start())
        return ends

    def settled(self) -> list[bool]:
        """Which nodes go: marked ones and all below them, but for a soft mark on what holds more than half of the text that hard ones leave."""
        n = len(self.tags)
        hard, chars = [False] * n, [0] * n
        for i in range(1, n):
            hard[i] = self.mark[i] == HARD or hard[self.parent[i]]
        for i, text in self.events:
            if text and not hard[i]:
                chars[i] += len(text.strip())
        for i in range(n - 1, 0, -1):
            chars[self.parent[i]] += chars[i]
        gone = [False] * n
        for i in range(1, n):
            gone[i] = hard[i] or gone[self.parent[i]] or self.mark[i] == SOFT and 2 * chars[i] <= chars[0]
        return gone

    def text(self, raw: str) -> None:
        if raw:
            self.events.append((self.open[-1], html.unescape(raw) if "&" in raw else raw))

    def push(self, name: str) -> None:
        depth = len(self.open)
        self.open.append(len(self.tags) - 1)
        self.depths.setdefault(name, []).append(depth)
        if name not in INLINE:
            self.blocks.append(depth)

    def pop(self) -> None:
        i = self.open.pop()
        self.end[i] = len(self.tags)
        if i:
            self.depths[self.tags[i]].pop()
        if self.blocks and self.blocks[-1] == len(self.open):
            self.blocks.pop()

    def depth(self, names: set[str] | frozenset[str]) -> int:
        """Where in the stack the last of these tags is open, 0 for none."""
        return max((self.depths[x][-1] for x in names if self.depths.get(x)), default=0)

    def unwind(self, depth: int) -> None:
        while len(self.open) > depth:
            self.pop()

    def start(self, name: str, attributes: str) -> None:
        tags, stack = self.tags, self.open
        if name not in INLINE:
            self.events.append((stack[-1], None))
            if name != "br" and tags[stack[self.blocks[-1]]] == "p":
                self.unwind(self.blocks[-1])
        if name in CLOSES and (k := self.depth(CLOSES[name])) > self.depth(SCOPES[name]):
            self.unwind(k)
        up = stack[-1]
        self.tags.append(name)
        self.parent.append(up)
        self.end.append(0)
        self.mark.append(self.marked(name, attributes))
        if name in VOID or attributes.endswith("/") and name in RAW | {"path"}:
            self.end[-1] = len(tags)
            if name in RAW:
                self.push(name)
        else:
            self.push(name)

    def marked(self, name: str, attributes: str) -> int:
        if name in GONE or name in RAW:
            return HARD
        if name == "header" and not self.depth(WHOLE):
            return HARD
        if name in ("html", "body") or not attributes:
            return NONE
        marks, found = REMARKS if name in WHOLE else MARKS, NONE
        for m in NAMED.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                found = HARD if value in ROLES else found
                continue
            for token in value.split():
                words = PART.findall(token)
                own = {w for before, w in zip(["", *words], words, strict=False) if w in marks and before not in STATES}
                if not own or words[0] in STATES:
                    continue
                if own == {"search"} and len(words) > 1 and words[-1] != "search" and BOXES.isdisjoint(words):
                    continue
                found = max(found, SOFT if own <= WEAK else HARD)
        return found

    def close(self, name: str) -> None:
        if self.depths.get(name):
            k = self.depths[name][-1]
            if name not in INLINE:
                self.events.append((self.open[k], None))
            self.unwind(k)


def densities(tree: Tree) -> tuple[list[float], list[int]]:
    """Composite densities, and characters, of all nodes; what is gone counts for nothing."""
    n = len(tree.tags)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[tree.parent[i]] or tree.tags[i] == "a"
    for i, text in tree.events:
        if text and not tree.gone[i]:
            size = len(text.strip())
            chars[i] += size
            link_chars[i] += size if linked[i] else 0
    for i in range(n - 1, 0, -1):
        if not tree.gone[i]:
            up = tree.parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (tree.tags[i] == "a")
    body = next((i for i in range(n) if tree.tags[i] == "body"), 0)
    share = link_chars[body] / chars[body] if chars[body] else 0.0
    out = [0.0] * n
    for i in range(n):
        c = chars[i]
        if c and not tree.gone[i]:
            t, lc, lt = max(tags[i], 1), max(link_chars[i], 1), max(link_tags[i], 1)
            base = math.log(math.log(c * lc / max(c - lc, 1) + share * c + math.e))
            out[i] = c / t * math.log(max(c * t / (lc * lt), 1.0)) / base
    return out, chars


def main_node(tree: Tree) -> int:
    """The root of the main text, -1 if there is none."""
    density, chars = densities(tree)
    n = len(tree.tags)
    # text of a block outside its inner blocks is a child of the block too, with its share of the block's density
    block, own = [0] * n, [0] * n
    for i in range(1, n):
        block[i] = block[tree.parent[i]] if tree.tags[i] in INLINE else i
    for i, text in tree.events:
        if text and not tree.gone[i]:
            own[block[i]] += len(text.strip())
    sums = [density[i] * own[i] / chars[i] if chars[i] else 0.0 for i in range(n)]
    for i in range(1, n):
        if block[i] == i:
            sums[block[tree.parent[i]]] += density[i]
    best = max((i for i in range(n) if block[i] == i and not tree.gone[i] and chars[i]), key=lambda i: (sums[i], i), default=-1)
    if best < 0:
        return -1
    path, i = [], best
    while i >= 0:
        path.append(i)
        i = tree.parent[i]
    inner = [i for i in path if tree.tags[i] not in ("body", "html", "#")]
    threshold = min((density[i] for i in inner), default=0.0)
    beside: dict[int, list[int]] = {i: [] for i in path}
    for k in range(1, n):
        if tree.parent[k] in beside and not tree.gone[k]:
            beside[tree.parent[k]].append(k)
    on_path, top = set(path), best
    for i in path[1:]:
        if any(k not in on_path and density[k] >= threshold and tree.tags[k] not in INLINE for k in beside[i]):
            top = i
    return top


def main_text(page: str | None) -> str:
    if not page:
        return ""
    tree = Tree(page)
    root = main_node(tree)
    if root < 0:
        return ""
    blocks, parts = [], []
    for i, text in [*tree.events, (root, None)]:
        if root <= i < tree.end[root] and not tree.gone[i]:
            if text is not None:
                parts.append(text)
            elif parts:
                blocks.append(" ".join("".join(parts).split()))
                parts = []
    return "\n".join(b for b in blocks if b)


def extract(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """``key``, url and the main text of every row."""
    python_batches(pages.sparkSession)
    rows = pages.select(F.col(key).alias("k"), F.col("url").cast("string").alias("url"), F.col(page).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([main_text(h) for h in batch.column(2).to_pylist()], pa.string())], ["k", "url", "text"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, url string, text string").withColumnRenamed("k", key)


def op5_html_extract(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
