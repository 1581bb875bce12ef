"""Main text of web pages by composite text density."""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Elements of HTML and words that name what is not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript template svg iframe object select xmp noembed noframes".split())  # of these xmp is text
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul head".split()
)
DROPPED = set("nav footer aside head menu dialog search button annotation annotation-xml".split())
# Blocks in which a label is part of a sentence.
SENTENCES = set("p li dd td blockquote figcaption h1 h2 h3 h4 h5 h6".split())
FORMS = set("form fieldset".split())
ENDS_P = BLOCK - {"html", "head", "body"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
CLOSES |= {t: ({"thead", "tbody", "tfoot"}, {"table"}) for t in ("thead", "tbody", "tfoot")}
SCOPE = set("article aside section div main nav footer header form td th table ul ol dl body html".split())
BOILERPLATE = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup paywall nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside widget widgets "
    "related recommended recommendations share sharing social footer header masthead toolbar skip copyright login search tags complementary contentinfo".split()
)
COMMENTS = set("comment comments commentlist disqus respond reply replies".split())
CONTENT = set("article entry post posts story stories title headline content page".split())  # their header is a heading
NEUTRAL = set(
    "area bar block body bottom box btn button buttons center col column container div fixed floating form global group head holder icons inner inline item items left link links list "
    "main mobile module nav panel primary right row secondary section site slot small sticky text top ul unit wrap wrapper zone".split()
)
LEAST_SHARE = 0.05
HALF, MOST = 0.5, 0.8  # shares of the page's text that a name can't drop: with a mark or heading in it, and without any elsewhere
LINKED = 0.7  # the share of link text from which a list beside the main text only leads elsewhere
WORDS = re.compile(r"[a-z]{2,}|[A-Z][a-z]+|[A-Z]{2,}(?![a-z])")
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*?)(>|\Z))", re.S)
NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
CLASS = re.compile(r"""(?:^|[\s"'])class\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


class Page:
    """The block elements of a page in order, with the text directly in each; inline elements are transparent."""

    def __init__(self, source: str):
        self.tag, self.parent, self.gone, self.main = ["#root"], [-1], [False], []
        self.kind = [""]  # of each block its element and class
        self.named: dict[int, bool] = {}  # blocks that name themselves as boilerplate, and whether as readers' comments
        self.text: list[tuple[int, str, bool]] = []  # (block, decoded text or a line break, in a link)
        self.links: list[int] = []
        stack: list[tuple[str, int]] = [("#root", 0)]  # (element, its block)
        at, end, link = 0, len(source), 0
        search = TAG.search
        while at < end:
            m = search(source, at)
            if m is None:
                if source.find("<", at) < 0:
                    self.add(stack[-1][1], source[at:], link)
                break
            if m.start() > at:
                self.add(stack[-1][1], source[at : m.start()], link)
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                link = self.close(stack, name, link)
                continue
            if name in RAW:
                stop = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>", re.I).search(source, at) if not m[3].endswith("/") else None
                if name == "xmp":
                    self.text.append((self.block(stack[-1][1], "pre", False), source[at : stop.start() if stop else end], link > 0))
                at = stop.end() if stop else at if m[3].endswith("/") else end
                continue
            if name == "br":
                self.text.append((stack[-1][1], "\n", False))
            if name in VOID:
                continue
            if name in BLOCK:
                if name in ENDS_P:
                    self.pop_to(stack, {"p"}, SCOPE)
                if name in CLOSES:
                    self.pop_to(stack, *CLOSES[name])
                link = sum(1 for t, _ in stack if t == "a") if link else 0
                self.open(stack, name, m[3])
            else:
                if name == "a":
                    if link:
                        link = self.close(stack, "a", link)
                    link = 1
                    self.links.append(stack[-1][1])
                alone = name == "label" and not (self.tag[stack[-1][1]] in SENTENCES and all(t not in FORMS for t, _ in stack))
                stack.append((name, stack[-1][1] if not alone and not self.odd(name, m[3]) else self.block(stack[-1][1], name, True)))

    def add(self, block: int, text: str, link: int) -> None:
        self.text.append((block, entities.unescape(text) if "&" in text else text, link > 0))

    @staticmethod
    def odd(name: str, attributes: str) -> bool:
        """Whether an inline element is hidden or named as boilerplate."""
        if name in DROPPED:
            return True
        return name != "a" and bool(attributes) and (bool(boilerplate(attributes)) or HIDDEN.search(attributes) is not None)

    def block(self, parent: int, name: str, gone: bool, kind: str = "") -> int:
        self.tag.append(name)
        self.kind.append(kind)
        self.parent.append(parent)
        self.gone.append(gone)
        return len(self.tag) - 1

    def open(self, stack: list, name: str, attributes: str) -> None:
        named = CLASS.search(attributes) if attributes else None
        kind = f"{name}.{' '.join(sorted((named[1] or named[2] or named[3] or '').split()))}" if named else ""
        own = self.block(stack[-1][1], name, name in DROPPED or bool(attributes) and HIDDEN.search(attributes) is not None, kind)
        inside = any(self.tag[b] in ("article", "main") for _, b in stack)
        if name in FORMS or name == "header" and not inside:
            self.named[own] = False
        if attributes and name not in ("html", "body"):
            kind = boilerplate(attributes)
            if kind:
                self.named[own] = kind == "comments"
            if re.search(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody", attributes):
                self.main.append(own)
        if name in ("article", "main") and self.main[-1:] != [own]:
            self.main.append(own)
        stack.append((name, own))

    @staticmethod
    def pop_to(stack: list, names: set, scope: set) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in scope:
                return

    def close(self, stack: list, name: str, link: int) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                del stack[i:]
                break
            if name not in BLOCK and stack[i][0] in SCOPE:
                break  # a stray inline end tag doesn't leave its block
        return int(any(t == "a" for t, _ in stack)) if link else 0


def boilerplate(attributes: str) -> str:
    """``comments`` or ``other`` if a whole class, id or role says that the element is no part of the text, else nothing.
    A name of which some word is neither boilerplate nor about layout (login-guide, has-sidebar, social-history) says so
    of nothing."""
    out = ""
    for m in NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in WORDS.findall(name)}
            own = words & (BOILERPLATE | COMMENTS)
            if own and words <= BOILERPLATE | COMMENTS | CONTENT | NEUTRAL:
                if own & COMMENTS:
                    return "comments"
                if own - {"header"} or not words & CONTENT:
                    out = "other"
    return out


def density(c: int, t: int, lc: int, lt: int, body_links: float) -> float:
    """Composite text density of a node with c characters and t tags, lc and lt of these in links: characters per tag,
    weighed by the logarithm of how rare links are. Their shares count as LEAST_SHARE at least, so that of two nodes
    without links the larger isn't denser for its size."""
    if not c:
        return 0.0
    base = math.log(c / max(c - lc, 1) * lc + body_links * c + math.e)
    ratio = 1 / max(lc / c, LEAST_SHARE) / max(lt / max(t, 1), LEAST_SHARE)
    return c / max(t, 1) * math.log(ratio + 1) / math.log(base + 1)


class Sizes:
    """Text, link and tag counts of each block that isn't gone, with all below it, and the densities from these."""

    def __init__(self, page: Page, gone: list[bool]):
        n, parent = len(page.tag), page.parent
        self.chars, tags, self.link_chars, self.link_tags = [0] * n, [0] * n, [0] * n, [0] * n
        for block, text, link in page.text:
            if not gone[block]:
                size = len(text) - text.count(" ") - text.count("\n")
                self.chars[block] += size
                if link:
                    self.link_chars[block] += size
        for block in page.links:
            tags[block] += 1
            self.link_tags[block] += 1
        for i in range(n - 1, 0, -1):
            if not gone[i]:
                p = parent[i]
                self.chars[p] += self.chars[i]
                self.link_chars[p] += self.link_chars[i]
                self.link_tags[p] += self.link_tags[i]
                tags[p] += tags[i] + 1
        body = self.link_chars[0] / max(self.chars[0], 1)
        self.dense = [density(*x, body) for x in zip(self.chars, tags, self.link_chars, self.link_tags)]
        self.sums, self.kids = [0.0] * n, [0] * n
        for i in range(1, n):
            if not gone[i]:
                self.sums[parent[i]] += self.dense[i]
                self.kids[parent[i]] += 1

    def leads_elsewhere(self, i: int) -> bool:
        return self.link_chars[i] >= LINKED * self.chars[i] > 0


def _below(page: Page, flags: list[bool]) -> list[bool]:
    """flags, set below every block where they are set."""
    out = list(flags)
    for i in range(1, len(out)):
        out[i] = out[i] or out[page.parent[i]]
    return out


def _gone(page: Page) -> list[bool]:
    """Blocks that are no part of the text by what they are, or by their names. A name drops no block that has half of the
    page's text with a mark or first heading in it, or most of it where there is none elsewhere; readers' comments stay
    only where there is nothing else."""
    n, hard = len(page.tag), _below(page, page.gone)
    own = Sizes(page, hard)
    heads = [0] * n  # marks and first headings in each block
    for i in {*page.main, *(i for i in range(n) if page.tag[i] == "h1")}:
        heads[i] = int(not hard[i])
    for i in range(n - 1, 0, -1):
        heads[page.parent[i]] += heads[i]
    out = list(page.gone)
    for i, comments in page.named.items():
        if comments:
            out[i] = own.chars[i] < own.chars[0]
            continue
        share = own.chars[i] / max(own.chars[0], 1)
        out[i] = out[i] or not (share >= HALF and heads[i] or share >= MOST and not heads[0])
    return _below(page, out)


def choose(page: Page, gone: list[bool]) -> list[bool]:
    """Which blocks are the main text: the node with the largest sum of its children's densities decides.

    Where marks hold it (article, main), the outermost is taken whole, with sibling articles; lists of links in it, but
    beside the chosen node and its article, go. Where it holds marks with half its text, these are taken. Else it is taken
    itself, and with the least density on its path to the body as threshold the densest subtree of each node beside the
    path that has it, and what is of one element and class with a node of the path. A first heading beside the path, alone in
    what holds it, is taken where there is none in what is.
    """
    own, parent, n = Sizes(page, gone), page.parent, len(page.tag)
    keep, dense, sums = [False] * n, own.dense, own.sums
    if not own.chars[0]:
        return keep
    top = max((i for i in range(n) if not gone[i]), key=lambda i: (sums[i], -i))
    if not own.kids[top]:
        top = 0
    path = set(_path(top, parent))
    marks = {i for i in page.main if not gone[i] and own.chars[i]}
    above = [i for i in marks if i == top or i in path]
    held = [i for i in marks if top in (ahead := _path(i, parent)) and marks.isdisjoint(ahead)]
    beside = [i for i in range(1, n) if not gone[i] and parent[i] in path and i != top and i not in path]
    drop: list[int] = []
    if above:
        root = min(above)
        roots = [root, *(i for i in marks if parent[i] == parent[root] and not own.leads_elsewhere(i))]
        article = max((i for i in above if page.tag[i] == "article"), default=top)
        drop = [i for i in beside if root in _path(i, parent) and article not in _path(i, parent) and own.link_tags[i] >= 3 and own.leads_elsewhere(i)]
    elif sum(own.chars[i] for i in held) >= HALF * own.chars[top]:
        roots = held
    else:
        least = min([dense[top], *(dense[j] for j in path if j)])
        best = list(range(n))  # of each subtree the node with the largest sum
        for i in range(n - 1, 0, -1):
            if not gone[i] and sums[best[i]] > sums[best[parent[i]]]:
                best[parent[i]] = best[i]
        alike = {page.kind[j] for j in (top, *path) if page.kind[j]}  # sections of one class are of one text
        whole = [i for i in beside if page.kind[i] in alike and not own.leads_elsewhere(i)]
        roots = [top, *whole, *(best[i] if own.kids[best[i]] else i for i in beside if i not in whole and dense[i] >= least and not own.leads_elsewhere(i))]
    for i in roots:
        keep[i] = True
    keep = _below(page, keep)
    if not any(keep[i] and page.tag[i] == "h1" and own.chars[i] for i in range(n)):
        around = {j for i in roots for j in _path(i, parent)}
        for i in range(1, n):
            if page.tag[i] == "h1" and not gone[i]:
                j = i
                while parent[j] > 0 and parent[j] not in around and own.chars[parent[j]] == own.chars[i]:
                    j = parent[j]  # what holds the heading alone
                keep[i] = keep[i] or parent[j] in around
        keep = _below(page, keep)
    dropped = [False] * n
    for i in drop:
        dropped[i] = True
    return [k and not d for k, d in zip(keep, _below(page, dropped))]


def extract(source: str | None) -> str:
    """The main text of a page: its blocks in page order, white space as one space, joined by line ends.

    Scripts, menus, footers and their like, and what names itself as boilerplate, go first (see :func:`_gone`); densities
    of what is left choose the subtree (see :func:`choose`), of which nothing else is dropped.
    """
    if not source:
        return ""
    page = Page(source)
    gone = _gone(page)
    keep = choose(page, gone)
    blocks, last = [[]], None
    for block, text, _ in page.text:
        if gone[block] or not keep[block]:
            if page.tag[block] in BLOCK:
                last = None
            continue
        if block != last or text == "\n":
            blocks.append([])
        last = block
        blocks[-1].append(text)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def _path(i: int, parent: list[int]) -> list[int]:
    out = []
    while parent[i] >= 0:
        i = parent[i]
        out.append(i)
    return out


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html).

    Null and empty pages, and pages without text, give an empty text; null ids and urls and repeated rows are rows like
    others; an empty table gives no rows; other columns are ignored. Pages are read whole and there is no shuffle.
    """

    def run(batches):
        for b in batches:
            texts = [extract(x) for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
