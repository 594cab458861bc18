"""Main text of web pages by composite text density.

A page becomes a tree of its block elements. Every node gets its characters per tag, adjusted by how many of them stand in
links (composite text density); a node's density sum adds the densities of its children. The subtree of the largest sum is
the article. The smallest density on the way from the body to it is the threshold that decides which neighbours along that
way belong to it too. Menus, forms, adverts, notices, comments and the like, known by their elements, roles and class
names, are taken out before. Everything is linear in the length of a page, whatever its markup, and no page is cut.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import EMPTY, read_table

# Elements by their kind in HTML.
BLOCKS = frozenset("address article blockquote caption center dd details dir div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header footer hgroup hr legend li listing main nav aside form menu ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul dialog".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
#: Never part of an article.
DROPPED = frozenset("nav footer aside menu dialog script style xmp iframe noembed noframes noscript textarea title template object applet canvas svg math audio video map select datalist button input label fieldset legend search".split())
#: Dropped, unless the article stands in them.
OFTEN_DROPPED = frozenset(("form", "header"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form tablist toolbar status".split())
#: Words of class and id attributes.
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsors sponsored promo promos promoted promotion banner banners cookie cookies consent gdpr notice notices notification notifications alert alerts disclaimer popup modal overlay newsletter subscribe subscription signup login signin nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager header masthead footer sidebar sidebars aside rail widget widgets share sharing social related recommended recommendations trending toolbar skip sitemap copyright outbrain taboola".split())
COMMENTS = frozenset("comment comments commentlist disqus livefyre respond replies discussion".split())
#: After these words a class says something of the page, not of the element.
OF_THE_PAGE = frozenset("no with has without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCKS = HEADINGS | frozenset(("p", "blockquote", "pre", "figure", "ul", "ol", "dl", "hgroup"))
#: What a start tag closes, if it is open and none of the second set is open inside it.
CLOSES = {
    "li": (("li",), frozenset(("ul", "ol", "menu", "dir"))), "dt": (("dt", "dd"), frozenset(("dl",))), "dd": (("dt", "dd"), frozenset(("dl",))),
    "tr": (("tr",), frozenset(("table",))), "td": (("td", "th"), frozenset(("table", "tr"))), "th": (("td", "th"), frozenset(("table", "tr"))),
    "option": (("option",), frozenset(("select",))),
}

MARKUP = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
TAG_REST = re.compile(r"(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+>")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
WORD = re.compile(r"[A-Z]*[a-z]+|[A-Z]+")
COMMENT_END = re.compile(r"--!?>")
ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def verdict_of(name: str, attributes: str) -> int:
    """0: may be text; 1: boilerplate unless the article stands in it; 2: never part of an article."""
    if name in DROPPED:
        return 2
    found = 1 if name in OFTEN_DROPPED else 0
    for key, value in ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and HIDDEN_STYLE.search(value)):
            return 2
        if key == "role" and value.lower() in ROLES:
            found = 1
        if key in ("class", "id"):
            words = [w.lower() for w in WORD.findall(value)]
            if not OF_THE_PAGE.isdisjoint(words):
                words = [w for before, w in zip([""] + words, words) if before not in OF_THE_PAGE]
            if not COMMENTS.isdisjoint(words):
                return 2
            if not BOILERPLATE.isdisjoint(words):
                found = 1
    return found


class Tree:
    """Block elements in the order of the page; node 0 is the body. parts: pieces of text, and numbers of child nodes."""

    def __init__(self, page: str):
        self.names, self.parents, self.verdicts, self.parts = ["body"], [-1], [0], [[]]
        self.tags, self.link_tags, self.chars, self.link_chars = [0], [0], [0], [0]
        self.stack, self.open = [0], {}
        self.link = -1  # the node in which a link is open
        self.read(page)

    def push(self, name: str, verdict: int) -> None:
        at = len(self.names)
        self.names.append(name)
        self.parents.append(self.stack[-1])
        self.verdicts.append(verdict)
        for column in (self.tags, self.link_tags, self.chars, self.link_chars):
            column.append(0)
        self.parts.append([])
        self.parts[self.stack[-1]].append(at)
        self.stack.append(at)
        self.open[name] = self.open.get(name, 0) + 1

    def pop(self) -> str:
        at = self.stack.pop()
        if self.link == at:
            self.link = -1
        self.open[self.names[at]] -= 1
        return self.names[at]

    def close(self, names, inside: frozenset = frozenset()) -> None:
        """Closes the innermost open one of names, unless one of inside is open in it."""
        if not any(self.open.get(n) for n in names):
            return
        for at in reversed(self.stack):
            if self.names[at] in names:
                break
            if self.names[at] in inside:
                return
        while self.pop() not in names:
            pass

    def text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        n = len(" ".join(text.split()))
        at = self.stack[-1]
        self.parts[at].append(text)
        self.chars[at] += n
        if self.link >= 0:
            self.link_chars[at] += n

    def start(self, name: str, attributes: str) -> None:
        at = self.stack[-1]
        self.tags[at] += 1
        if name in VOID:
            if name == "hr":
                self.close(("p",))
                self.push(name, 0)
                self.pop()
            elif name == "br":
                self.parts[at].append(" ")
            return
        if name == "a":
            self.link_tags[at] += 1
            self.link = at
        verdict = verdict_of(name, attributes)
        if name in BLOCKS:
            self.close(("p",))
            if name in CLOSES:
                self.close(*CLOSES[name])
            self.push(name, verdict)
        elif verdict or (self.verdicts[self.stack[-1]] and self.names[self.stack[-1]] == name):
            self.push(name, verdict)  # not a block, but to be left out; and what it holds of its own name, for the end tags

    def end(self, name: str) -> None:
        if name == "a":
            self.link = -1
        if self.open.get(name):
            while self.pop() != name:
                pass

    def read(self, page: str) -> None:
        at, size, quotes = 0, len(page), True
        while at < size:
            found = MARKUP.search(page, at)
            if not found:
                break
            begin, name = found.start(), (found[2] or "").lower()
            if begin > at:
                self.text(page[at:begin])
            if not name:
                if page.startswith("<!--", begin):
                    last = COMMENT_END.search(page, begin + 4)
                    short = re.compile(r"-?>").match(page, begin + 4)
                    at = short.end() if short else last.end() if last else size
                else:
                    at = page.find(">", begin) + 1 or size
                continue
            rest = TAG_REST.match(page, found.end()) if quotes else None
            if rest:
                at = rest.end()
            else:  # a quote that nothing ends: from here on tags end at the next >
                quotes = False
                at = page.find(">", found.end()) + 1
                if not at:
                    at = size
                    break  # a tag that isn't complete is no text
            if found[1]:
                self.end(name)
            elif name in ("html", "head", "body"):
                continue
            elif name in RAW:
                last = ENDS[name].search(page, at)
                at = (page.find(">", last.end()) + 1 or size) if last else size
            else:
                self.start(name, page[found.end() : at - 1])
        if at < size:
            self.text(page[at:])


def density(chars: int, tags: int, link_chars: int, link_tags: int, page_links: float) -> float:
    """Characters per tag, less the more of them stand in links; page_links: the share of link characters in the page."""
    if not chars or link_chars >= chars:
        return 0.0
    tags, linked, link_tags = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars * linked / max(1, chars - link_chars) + page_links * chars + math.e)
    return max(0.0, chars / tags * math.log(max(1.0, chars * tags / (linked * link_tags))) / math.log(base))


def kept_nodes(tree: Tree) -> list[bool]:
    """Which nodes aren't boilerplate."""
    n = len(tree.names)
    holds = [False] * n  # an article, or what stands for one
    semantic = any(name in ("article", "main") and not v for name, v in zip(tree.names, tree.verdicts, strict=True))
    for i in range(n - 1, 0, -1):
        name = tree.names[i]
        if tree.verdicts[i] < 2 and (name in ("article", "main") and not tree.verdicts[i] or name == "h1" or holds[i]):
            holds[tree.parents[i]] = True
    kept, inside = [True] * n, [not semantic] * n
    for i in range(1, n):
        up = tree.parents[i]
        inside[i] = inside[up] or tree.names[i] in ("article", "main")
        verdict = tree.verdicts[i]
        # A page's header, with the site's name, isn't the header of its article.
        site = tree.names[i] == "header" and (not inside[up] or (not semantic and up == 0))
        kept[i] = kept[up] and not (verdict == 2 or (verdict == 1 and (site or not holds[i])))
        if site and holds[i] and any(isinstance(c, int) and tree.names[c] in ("article", "main") for c in tree.parts[i]):
            kept[i] = kept[up]
    return kept


def main_nodes(tree: Tree) -> list[int]:
    """The nodes whose subtrees are the article, in the order of the page."""
    n, kept = len(tree.names), kept_nodes(tree)
    tree.verdicts = [0 if k else 2 for k in kept]
    total = [list(c) for c in (tree.chars, tree.tags, tree.link_chars, tree.link_tags)]
    for i in range(n - 1, 0, -1):
        if kept[i]:
            for c in total:
                c[tree.parents[i]] += c[i]
    if not total[0][0]:
        return []
    page_links = total[2][0] / total[0][0]
    dense = [density(total[0][i], total[1][i], total[2][i], total[3][i], page_links) if kept[i] else 0.0 for i in range(n)]
    sums = [density(tree.chars[i], tree.tags[i], tree.link_chars[i], tree.link_tags[i], page_links) if kept[i] else 0.0 for i in range(n)]
    for i in range(1, n):
        if kept[i]:
            sums[tree.parents[i]] += dense[i]
    # Where the page says what its article is, the largest sum is looked for there.
    home = [-1] * n
    for i in range(1, n):
        if kept[i]:
            home[i] = home[tree.parents[i]] if home[tree.parents[i]] >= 0 else i if tree.names[i] in ("article", "main") and total[0][i] else -1
    pool = [i for i in range(n) if kept[i] and home[i] >= 0] or [i for i in range(n) if kept[i]]
    best = max(pool, key=lambda i: (sums[i], -i))
    if home[best] >= 0:
        return [home[best]]
    way = [best]
    while way[-1]:
        way.append(tree.parents[way[-1]])
    threshold = min(dense[i] for i in way)
    if best == 0:  # text blocks of the body itself, and those of its containers that are as dense as the page
        return [0] + [-c for c in tree.parts[0] if isinstance(c, int) and not (tree.names[c] in TEXT_BLOCKS or dense[c] >= threshold)]
    chosen = {best}
    for below, up in zip(way, way[1:]):
        seen = False
        for c in tree.parts[up]:
            if not isinstance(c, int) or not kept[c] or not total[0][c]:
                continue
            seen |= c == below
            near = dense[c] >= threshold and (up or sums[c] >= sums[best] / 4)
            if c != below and (near or (tree.names[c] in HEADINGS if up else tree.names[c] == "h1" and not seen)):
                chosen.add(c)
    return sorted(chosen)


def extract(page: str) -> str:
    tree = Tree(page)
    nodes = main_nodes(tree)
    left_out = {-i for i in nodes if i < 0}
    lines, line = [], []

    def flush() -> None:
        if line:
            words = " ".join("".join(line).split())
            if words:
                lines.append(words)
            line.clear()

    for top in (i for i in nodes if i >= 0):
        todo: list = [top]
        while todo:
            part = todo.pop()
            if isinstance(part, str):
                line.append(part)
            elif part is None:
                flush()
            elif part in left_out or tree.verdicts[part]:
                if tree.names[part] in BLOCKS:
                    flush()
            else:
                flush()
                todo.append(None)
                todo.extend(reversed(tree.parts[part]))
        flush()
    return "\n".join(lines)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row: the page's main text, its blocks joined by newlines.

    Null and empty pages, and pages of boilerplate alone, have an empty text. Rows without an id and repeated rows are kept;
    an empty table gives an empty result; other columns are ignored, whatever their names. Equal pages have equal texts.
    """
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit(EMPTY)).alias("html"))

    def run(batches):
        for batch in batches:
            texts = [extract(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))
