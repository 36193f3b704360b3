"""Main text of web pages by wrapper induction.

Pages of a host that have the same kinds of elements at the top of their body are of one layout. For each layout a few
pages with different html are aligned by simple tree matching (Yang 1991): the largest ordered match of two DOM trees
whose roots have equal labels; siblings with the same text are matched first. That gives a skeleton. Every page of the
layout is then aligned with it, and a node is template if it has equal text in all pages in which it occurs, and occurs
in LEAST_PAGES different ones (constancy takes two); the others are slots. Each page is aligned with its template:
aligned nodes with the template's text are dropped, and what stands in the slots is the main text, in page order.

Slots that the contract names go whatever they hold: menus, page headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments, as element, role, class or id say. A class or id says so where the whole of it, or
its last word, is one of SKIPPED_WORDS, or its first one with nothing but words of LAYOUT_WORDS behind. A header within
an article is part of it.

A page whose layout has no second page cannot be compared with anything; of such pages alone, article and main elements
tell the content, if there are any.

Only the skeleton comes from a sample: PAGES pages for each layout, the first and last of each of its hash slots. What tasks found about its
nodes is summed by layout and node. Skeletons and templates are joined to the pages by host and layout; Spark broadcasts
them only where the written table is under its threshold, and splits a hot host's rows otherwise.

Text: character references are decoded, white space (as Unicode has it) within a block becomes one space, blocks are
trimmed and joined by one space.

Defined cases: null or empty html gives empty text; a page without a host (or url) is extracted without a template;
a page none of whose slots holds text keeps its constant text; a tag cut off by the end of the page is ignored; elements
nested to any depth are read, and aligned down to DEPTH; loose text and inline elements stay or go with their block; repeated rows are extracted each; other columns aren't read.
"""

from __future__ import annotations

import functools
import html as htmllib
import itertools
import json
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import discard, materialize
from chronoloom.llm.line_align import _increasing

#: Pages of a layout that its skeleton is made from, and in how many different pages a node of a template occurs at least.
PAGES, LEAST_PAGES = 8, 2
#: Nesting that is aligned; deeper elements are compared as a part of the one at that depth.
DEPTH = 150

# Element names by their treatment in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
SKIPPED = frozenset("head nav footer aside form script style textarea title xmp iframe noembed noframes noscript template button select option object svg canvas audio video map dialog menu input".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in class or id that mark what isn't the article.
SKIPPED_WORDS = frozenset("nav navbar navigation menu topmenu breadcrumb breadcrumbs sidebar aside footer masthead banner ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus reply replies respond related recommended widget toolbar pagination pager skip".split())
#: Words that may follow the first one in a class or id that marks what isn't the article.
LAYOUT_WORDS = frozenset("area bar block bottom box btn button buttons center col column container content desktop footer form group header icons inner item items left link links list main middle mobile module outer panel right row section side slot strip text top unit widget wrap wrapper zone".split())
LIST_CLOSES = {"li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
LIST_BOUNDS = frozenset("ul ol dl table tbody thead tfoot select".split())
SCOPES = frozenset("html body table td th button object template".split())

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_ATTR = re.compile(r"(?i)(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"'>]|$)")


class Node:
    __slots__ = ("children", "label", "mark", "skip", "tag")

    def __init__(self, tag: str, label: str, skip: bool):
        self.tag, self.label, self.skip, self.children, self.mark = tag, label, skip, [], 0


@functools.lru_cache(maxsize=20_000)
def _kind(tag: str, attrs: str) -> tuple[str, bool]:
    """Label and whether it is left out, from the element's name and attributes."""
    names, skip = [], tag in SKIPPED
    if attrs:
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), "".join(values).lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in SKIPPED_ROLES):
                skip = True
            elif name in ("class", "id"):
                skip = skip or (tag not in ("html", "body", "article", "main") and any(map(_says_skip, value.split())))
                names += sorted(w for w in re.split(r"[^a-z]+", value) if w)
    return " ".join([tag, *names]), skip


def _says_skip(name: str) -> bool:
    """Whether a class or id marks what isn't the article: menu, cookie-notice and ad-slot-2 do, notice-board-history doesn't."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    return bool(words) and ("".join(words) in SKIPPED_WORDS or words[-1] in SKIPPED_WORDS or (words[0] in SKIPPED_WORDS and LAYOUT_WORDS.issuperset(words[1:])))


def parse(text: str) -> Node:
    """A DOM tree of Nodes and strings (decoded text), with marks."""
    root = Node("#", "#", False)
    stack, at, n = [root], 0, len(text)
    made, opened = [root], Counter()

    def cut(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    search = _TOKEN.search
    while at < n:
        m = search(text, at)
        if not m:
            stack[-1].children.append(htmllib.unescape(text[at:]))
            break
        if m.start() > at:
            piece = text[at : m.start()]
            stack[-1].children.append(htmllib.unescape(piece) if "&" in piece else piece)
        at = m.end()
        close, tag, attrs, end = m.group(1, 2, 3, 4) if m.group(2) else m.group(5, 6, 7, 8)
        if not tag or end != ">":
            continue
        tag = tag.lower()
        if close:
            for k in () if not opened[tag] else range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    cut(k)
                    break
                if stack[k].tag in ("article", "main", "body", "td", "th", "table") and tag in INLINE | {"p", "li"}:
                    break
            continue
        if tag in CLOSES_P:
            for k in () if not opened["p"] else range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    cut(k)
                    break
                if stack[k].tag in SCOPES or stack[k].tag in CLOSES_P:
                    break
        elif tag in LIST_CLOSES:
            for k in () if not any(opened[x] for x in LIST_CLOSES[tag]) else range(len(stack) - 1, 0, -1):
                if stack[k].tag in LIST_CLOSES[tag]:
                    cut(k)
                    break
                if stack[k].tag in LIST_BOUNDS and not (tag == "tr" and stack[k].tag in ("td", "th")):
                    break
        elif tag == "body":
            for k in range(1, len(stack)):
                if stack[k].tag == "head":
                    cut(k)
                    break
        node = Node(tag, *_kind(tag, attrs))
        stack[-1].children.append(node)
        made.append(node)
        if tag in RAW:
            stop = re.compile(rf"(?i)</{tag}(?=[\s/>])[^>]*>?|\Z").search(text, at) if tag != "plaintext" else None
            node.children.append(text[at : stop.start()])
            at = stop.end()
        elif tag not in VOID and not attrs.endswith("/"):
            stack.append(node)
            opened[tag] += 1
    _skip_headers(root)
    for node in reversed(made):  # children come after their parents
        node.mark = _mark(node)
    return root


def _skip_headers(root: Node) -> None:
    """Headers of the page or of its parts, at any depth, but not those of an article."""
    todo = [root]
    while todo:
        node = todo.pop()
        for c in node.children:
            if not isinstance(c, str) and c.tag != "article":
                if c.tag == "header":
                    c.skip = True
                todo.append(c)


def _mark(node: Node) -> int:
    """Hash of the text that is kept below node, from its children's marks; 0 if there is none."""
    parts = []
    for c in node.children:
        if isinstance(c, str):
            parts += c.split()
        elif not c.skip and c.mark:
            parts.append(str(c.mark))
    return (zlib.crc32(" ".join(parts).encode("utf-8", "replace")) or 1) if parts else 0


def pieces(node, out: list, drop: frozenset = frozenset()) -> None:
    """Text pieces below node in order; " " stands where a block begins or ends. drop: nodes (by id) that are left out."""
    todo = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag in INLINE and not c.skip:
            if id(c) not in drop:
                todo.extend(reversed(c.children))
        else:
            out.append(" ")
            if not c.skip and id(c) not in drop:
                todo.append(" ")
                todo.extend(reversed(c.children))


def text_of(nodes: list, drop: frozenset = frozenset()) -> str:
    out: list[str] = []
    for x in nodes:
        pieces(x, out, drop)
        out.append(" ")
    return " ".join("".join(out).split())


def shape(node: Node, depth: int = 0, inside: bool = False) -> list:
    """The tree that is aligned: [label, nodes, children's shapes, mark, hash of the labels, size]; inline and left-out elements don't count.

    Successive paragraphs of an article or main element are its running text: they are aligned, but have no mark of their own."""
    inside = inside or node.tag in ("article", "main")
    kids = []
    if depth < DEPTH:
        for c in node.children:
            if not (isinstance(c, str) or c.tag in INLINE or c.tag in VOID or c.tag in SKIPPED):
                kids.append(shape(c, depth + 1, inside))
                if inside and c.tag == "p" and len(kids) > 1 and kids[-2][0] == kids[-1][0]:
                    kids[-2][3] = kids[-1][3] = 0
    return _with_hashes([node.label, [node], kids, node.mark])


def _with_hashes(s: list) -> list:
    return [*s, hash((s[0], *(c[4] for c in s[2]))), 1 + sum(c[5] for c in s[2])]


def _same(p: list, q: list) -> bool:
    return len(p) > 4 and len(q) > 4 and p[4] == q[4]


def _ends(x: list, y: list) -> tuple[int, int]:
    """How many children at the begin, and then at the end, have equal trees of labels: to match those is always best."""
    most, i = min(len(x), len(y)), 0
    while i < most and _same(x[i], y[i]):
        i += 1
    j = 0
    while j < most - i and _same(x[-1 - j], y[-1 - j]):
        j += 1
    return i, j


def _table(x: list, y: list, known: dict) -> tuple[list, dict]:
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    own = {}
    for i, p in enumerate(x, 1):
        row, above = best[i], best[i - 1]
        for j, q in enumerate(y, 1):
            w = own[i, j] = _size(p, q, known) if p[0] == q[0] else 0
            row[j] = max(above[j], row[j - 1], above[j - 1] + w)
    return best, own


def _size(a: list, b: list, known: dict) -> int:
    """Simple tree matching: the size of the largest match. known: sizes by hashes of the labels, so equal subtrees are matched once."""
    if a[0] != b[0]:
        return 0
    if _same(a, b):
        return a[5]
    key = (a[4], b[4]) if len(a) > 4 and len(b) > 4 else None
    if key in known:
        return known[key]
    x, y = a[2], b[2]
    i, j = _ends(x, y)
    size = 1 + sum(c[5] for c in x[:i] + x[len(x) - j :]) + _table(x[i : len(x) - j], y[i : len(y) - j], known)[0][-1][-1]
    if key:
        known[key] = size
    return size


def _anchors(x: list, y: list) -> list[tuple[int, int]]:
    """Children with equal label and text that occur once on either side, in an order that both have."""
    sides = []
    for z in (x, y):
        at: dict = {}
        for k, c in enumerate(z):
            if len(c) > 3 and c[3]:
                at.setdefault((c[0], c[3]), []).append(k)
        sides.append({m: ks[0] for m, ks in at.items() if len(ks) == 1})
    return _increasing([(k, sides[1][m]) for m, k in sides[0].items() if m in sides[1]])


def _align(a: list, b: list, pairs: list, known: dict) -> None:
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        pairs.append((a, b))
        x, y, i0, j0 = a[2], b[2], 0, 0
        for i1, j1 in [*_anchors(x, y), (len(x), len(y))]:
            u, v = x[i0:i1], y[j0:j1]
            if i1 < len(x):
                todo.append((x[i1], y[j1]))
            i0, j0 = i1 + 1, j1 + 1
            head, tail = _ends(u, v)
            todo += list(zip(u[:head], v[:head], strict=True)) + list(zip(u[len(u) - tail :], v[len(v) - tail :], strict=True))
            u, v = u[head : len(u) - tail], v[head : len(v) - tail]
            best, own = _table(u, v, known)
            i, j = len(u), len(v)
            while i and j:
                if own[i, j] and best[i][j] == best[i - 1][j - 1] + own[i, j]:
                    todo.append((u[i - 1], v[j - 1]))
                    i, j = i - 1, j - 1
                elif best[i][j] == best[i - 1][j]:
                    i -= 1
                else:
                    j -= 1


def match(a: list, b: list, pairs: list | None = None) -> int:
    """Simple tree matching of two shapes: the size of the largest match; with pairs, also nodes matched.

    For pairs, children whose text is the same are matched first, and a largest match is made between them."""
    known: dict = {}
    size = _size(a, b, known)
    if pairs is not None and size:
        _align(a, b, pairs, known)
    return size


def layout_of(s: list) -> int:
    """Hash of the labels at the top of the body, each once."""
    for label in ("html", "body"):
        s = next((c for c in s[2] if c[0].split(" ")[0] == label), s)
    return zlib.crc32("\n".join(sorted({c[0] for c in s[2]})).encode())


def skeleton(pages: list[str]) -> list:
    """Of a layout's sampled pages: [label, mark of the text if no page has another there, children]."""
    first, *others = sorted((shape(parse(p)) for p in pages), key=lambda s: len(json.dumps(_labels(s))))
    differs: set[int] = set()
    for other in others:
        found: list = []
        match(first, other, found)
        differs.update(id(a) for a, b in found if a[3] != b[3])

    def build(s):
        return [s[0], s[3] if s[3] and id(s) not in differs else None, [build(c) for c in s[2]]]

    return build(first)


def tally(template: str, page: str, h: int, into: dict, key: tuple = ()) -> None:
    """into: by key and node, whether its text was the same in all pages so far, and hashes of LEAST_PAGES of them at most."""
    found: list = []
    match(_loaded(template), shape(parse(page)), found)
    for t, s in found:
        if t[1] is not None:
            seen = into.setdefault((*key, t[6]), [True, set()])
            seen[0] = seen[0] and t[1] == s[3]
            if len(seen[1]) < LEAST_PAGES:
                seen[1].add(h)


def constant(template: str, nodes: set) -> list:
    """The skeleton with the marks of these nodes alone."""

    def build(t):
        return [t[0], t[1] if t[6] in nodes else None, [build(c) for c in t[2]]]

    return build(_loaded(template))


def induce(pages: list[str]) -> list | None:
    """The template of pages of one layout: [label, mark of the text if it is constant, children]; None under LEAST_PAGES."""
    if len(pages) < LEAST_PAGES:
        return None
    made, into = json.dumps(skeleton(pages[:PAGES])), {}
    for p in pages:
        tally(made, p, zlib.crc32(p.encode("utf-8", "replace")), into)
    return constant(made, {k for (k,), (same, seen) in into.items() if same and len(seen) >= LEAST_PAGES})


def _labels(s: list) -> list:
    return [s[0], [_labels(c) for c in s[2]]]


@functools.lru_cache(maxsize=512)
def _loaded(template: str) -> list:
    number = itertools.count()

    def build(t):
        k = next(number)
        return [*_with_hashes([t[0], t[1], [build(c) for c in t[2]], t[1]]), k]

    return build(json.loads(template))


def extract(html: str | None, template: str | None = None) -> str:
    """The main text of one page; template: that of its layout, if it has one."""
    if not html:
        return ""
    root = parse(html)
    drop: set[int] = set()
    if template:
        found: list = []
        match(_loaded(template), shape(root), found)
        for t, s in found:
            if t[1] is not None and t[1] == s[3]:
                drop.update(id(n) for n in s[1])
        return text_of([root], frozenset(drop)) or text_of([root])
    regions, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main"):
            regions.append(node)
            continue
        todo += reversed([c for c in node.children if not isinstance(c, str) and not c.skip])
    return text_of(regions or [root])


def host_of(url):
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def laid_out(pages: DataFrame) -> DataFrame:
    """page_id, url, html, host (empty: none), layout of each page; a written table."""
    rows = pages.select("page_id", "url", "html", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"))
    page_id = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            layout = [layout_of(shape(parse(x))) if x and host else 0 for x, host in zip(b.column("html").to_pylist(), b.column("host").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(layout, pa.int64())], [*b.schema.names, "layout"])

    return materialize(rows.mapInArrow(run, f"page_id {page_id}, url string, html string, host string, layout bigint"), "html-pages")


def templates(laid: DataFrame) -> DataFrame:
    """t_host, t_layout, template (JSON) for each layout with different pages; a written table."""
    own = laid.select("host", "layout", F.xxhash64("html").alias("h"), "html").where("host <> '' and html <> ''")
    slots = own.groupBy("host", "layout", F.pmod("h", F.lit(PAGES // 2)).alias("slot")).agg(F.array(F.min("h"), F.max("h")).alias("ends"))
    slots = materialize(slots.select("host", "layout", F.explode("ends").alias("h")).distinct(), "html-slots")
    sampled = own.join(slots, ["host", "layout", "h"]).groupBy("host", "layout", "h").agg(F.min("html").alias("html"))
    key_of = lambda key: [pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int64())]

    def first(key, rows):
        pages = rows.column("html").to_pylist()
        found = json.dumps(skeleton(pages)) if len(pages) >= LEAST_PAGES else None
        return pa.table([*key_of(key), pa.array([found], pa.string())], ["t_host", "t_layout", "made"])

    made = materialize(sampled.groupBy("host", "layout").applyInArrow(first, "t_host string, t_layout bigint, made string").where("made is not null"), "html-skeletons")

    def count(batches):
        into: dict = {}

        def flush():
            items = list(into.items())
            into.clear()
            for at in range(0, len(items), 10_000):
                host, layout, node, same, hs = zip(*((*k, v[0], list(v[1])) for k, v in items[at : at + 10_000]), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(layout, pa.int64()), pa.array(node, pa.int32()), pa.array(same, pa.bool_()), pa.array(hs, pa.list_(pa.int64()))], ["host", "layout", "node", "same", "hs"])

        for b in batches:
            for host, layout, h, html, template in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tally(template, html, h, into, (host, layout))
                if len(into) > 200_000:
                    yield from flush()
        yield from flush()

    rows = own.join(made, (F.col("host") == F.col("t_host")) & (F.col("layout") == F.col("t_layout"))).select("host", "layout", "h", "html", "made")
    counted = rows.mapInArrow(count, "host string, layout bigint, node int, same boolean, hs array<bigint>").groupBy("host", "layout", "node")
    counted = counted.agg(F.min("same").alias("same"), F.size(F.array_distinct(F.flatten(F.collect_list("hs")))).alias("n")).where(F.col("same") & (F.col("n") >= LEAST_PAGES))
    # as many nodes as the skeleton has at most; without a constant node all of it is slots
    nodes = counted.groupBy("host", "layout").agg(F.collect_list("node").alias("nodes"))
    kept = made.join(nodes, (F.col("host") == F.col("t_host")) & (F.col("layout") == F.col("t_layout")), "left").select("t_host", "t_layout", "made", "nodes")

    def finish(batches):
        for b in batches:
            found = [json.dumps(constant(m, set(n or ()))) for m, n in zip(b.column("made").to_pylist(), b.column("nodes").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("t_host"), b.column("t_layout"), pa.array(found, pa.string())], ["t_host", "t_layout", "template"])

    out = materialize(kept.mapInArrow(finish, "t_host string, t_layout bigint, template string"), "html-templates")
    discard(slots, made)
    return out


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text for each page."""
    laid = laid_out(pages)
    made = templates(laid)
    rows = laid.join(made, (F.col("host") == F.col("t_host")) & (F.col("layout") == F.col("t_layout")), "left").select("page_id", "url", "html", "template")
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        for b in batches:
            text = [extract(h, t) for h, t in zip(b.column("html").to_pylist(), b.column("template").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, f"page_id {types['page_id']}, url string, text string")


def html_digest(pages: DataFrame) -> DataFrame:
    return extract_pages(pages).withColumn("n_chars", F.length("text").cast("bigint"))
