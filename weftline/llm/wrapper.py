"""Main-text extraction by wrapper induction.

Pages become trees of elements, in which runs of sibling elements of one kind (tag, class, id) are folded into
one node. For each host one page, picked by a hash, is the pivot; all pages of the host are aligned with it by
simple tree matching, and for every pivot node it is counted how many pages match it, in how many its text is
the same, and how much text and link text it holds. Nodes with one text on nearly all pages are the host's template;
of the slots that vary, the content slot is the one that keeps most of the varying text outside links: the largest
article or main element, or else the deepest node that still has it. Extraction aligns each page again and takes the blocks of
what matches the content slot, without template nodes, menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and comments, which their elements' names tell. A page that doesn't match its pivot's content
slot is judged by itself.

A host's pages meet only as sums per pivot node. Pivots are broadcast while they are small, else joined.
Defined cases: a null or empty html gives an empty text; pages without a host, or of a null url, are one host;
elements nested deeper than 150 are read as if they stood side by side, but what a menu or the like holds stays
its own; long lists of children are matched along a band; repeated rows are pages of their own.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.state import small_batches, written
from weftline.llm.text import prefix_hash, releasing, span_hash, text_slices

#: Bytes of all pivots up to which they are broadcast.
SMALL = 16_000_000
_DEEPEST = 150
#: Pairs of children up to which two nodes' children are matched in full.
CELLS = 1_000_000
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed xmp template".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("""address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
header hgroup hr main menu nav ol p pre section table ul""".split())
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_DROPPED = frozenset("head script style noscript template iframe svg object embed nav aside footer form button select textarea input dialog menu canvas audio video map".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|alert|newsletter|subscribe|subscription|social|share|sharing|related|recommended|"
    r"comments?|commentlist|respond|replies|disqus|sidebar|side|breadcrumbs?|menu|navbar|nav|navigation|footer|masthead|topbar|popup|modal|overlay|paywall|pagination|pager|widget|toolbar|skip|login|signup|search)(?:$|[\s_-])",
    re.I,
)
#: The names that drop a text element of an article, too; others may style what the article says. Fixed values.
_STRONG = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|cookies?|consent|gdpr|newsletter|comments?|commentlist|disqus)(?:$|[\s_-])", re.I)
_TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table caption tr td th figcaption".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)(?:>|\Z)|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


class Element:
    __slots__ = ("tag", "name", "role", "children")

    def __init__(self, tag: str, name: str = "", role: str = ""):
        self.tag, self.name, self.role = tag, name, role
        self.children: list[Element | str] = []


_CONTAINERS = ("html", "body", "div", "section", "main", "article")
#: Pages of one layout that make a wrapper of their own; a host's other pages share one over all its pages, under the layout "".
OWN_LAYOUT = 4


def parse(text: str) -> Element:
    """The page's tree; unclosed and misplaced tags are mended as browsers mostly do."""
    root = Element("#page")
    stack, at = [root], 0
    homes = [root]  # where what an open element holds goes: from _DEEPEST on to elements side by side

    def opened(element: Element) -> None:
        if len(homes) < _DEEPEST or element.tag in _INLINE or homes[-1].tag in _DROPPED or boilerplate(homes[-1], True):
            homes[-1].children.append(element)
        else:
            homes[_DEEPEST - 1].children.append(element)

    def closed(k: int) -> None:
        deep = len(stack) > _DEEPEST and stack[-1].tag not in _INLINE
        del stack[k:], homes[k:]
        if deep and len(stack) > _DEEPEST and not boilerplate(stack[-1], True):  # what follows stands behind what was closed
            homes[-1] = Element(stack[-1].tag, stack[-1].name, stack[-1].role)
            homes[_DEEPEST - 1].children.append(homes[-1])

    while m := _TOKEN.search(text, at):
        if m.start() > at:
            homes[-1].children.append(entities.unescape(text[at : m.start()]))
        at = m.end()
        if m[1]:
            homes[-1].children.append(m[1])
        elif m[2]:
            tag = m[2].lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    closed(k)
                    break
        elif tag := (m[3] or m[5] or "").lower():
            if m.end() == len(text) and text[-1] != ">":
                break  # the page ends within a tag
            names = {"class": "", "id": "", "role": ""}
            if attributes := m[4] or m[6]:
                for a in _ATTRIBUTE.finditer(attributes):
                    key = a[1].lower()
                    names[key] = a[2] or a[3] or a[4] or ("true" if "hidden" in key else "")
            element = Element(tag, f"{names['class']} {names['id']}".strip(), "hidden" if names.get("hidden") or names.get("aria-hidden") == "true" else names["role"].lower())
            if tag in _CLOSES_P:
                _close(stack, ("p",), _CLOSES_P - {"p"}, closed)
            elif tag in _CLOSES:
                _close(stack, _CLOSES[tag][0].split(), _CLOSES[tag][1], closed)
            opened(element)
            if tag in _RAW:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)", re.I).search(text, at)
                stop = end.start() if end else len(text)
                element.children.append(text[at:stop])
                at = stop
                if end:
                    closing = text.find(">", stop)
                    at = closing + 1 if closing >= 0 else len(text)
            elif tag not in _VOID and not (attributes or "").endswith("/"):
                inside = len(homes) >= _DEEPEST and element.tag not in _INLINE and (homes[-1].tag in _DROPPED or boilerplate(homes[-1], True))
                stack.append(element)
                homes.append(homes[-1] if inside or len(homes) > 4 * _DEEPEST else element)
    else:
        if at < len(text):
            homes[-1].children.append(entities.unescape(text[at:]))
    return root


def _close(stack: list[Element], tags, scopes, closed: Callable[[int], None]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            closed(k)
            return
        if stack[k].tag in scopes:
            return


def boilerplate(element: Element, inside: bool) -> bool:
    """Whether the element's name says that it isn't article text; inside: whether an article or main element holds it."""
    tag = element.tag
    if tag in _DROPPED or element.role in _ROLES or element.role == "hidden" or tag == "header" and not inside:
        return True
    if not element.name or tag in ("html", "body", "article", "main"):
        return False
    return bool((_STRONG if inside and tag in _TEXTS else _NAMES).search(element.name))


def blocks(elements: list[Element], skip: set[int] = frozenset(), inside: bool = False) -> list[str]:
    """The texts of the block elements, white space collapsed."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    def walk(element: Element, inside: bool) -> None:
        for child in element.children:
            if isinstance(child, str):
                held.append(child)
            elif child.tag == "br":
                held.append("\n")
            elif id(child) in skip or boilerplate(child, inside):
                if child.tag not in _INLINE:
                    flush()
            elif child.tag in _INLINE:
                walk(child, inside)
            else:
                flush()
                walk(child, inside or child.tag in ("article", "main"))
                flush()

    for element in elements:
        walk(element, inside or element.tag in ("article", "main"))
        flush()
    return out


class Node:
    """A folded run of sibling elements of one kind; inline elements belong to their block's text."""

    __slots__ = ("key", "elements", "children", "index")

    def __init__(self, key: str, elements: list[Element], inside: bool = False):
        self.key, self.elements, self.index = key, elements, -1
        self.children: list[Node] = []
        for element in elements:
            for child in element.children:
                if isinstance(child, str) or child.tag in _INLINE or child.tag == "br":
                    continue
                if boilerplate(child, inside):
                    continue
                kind = f"{child.tag} {child.name}".strip()
                if self.children and self.children[-1].key == kind:
                    self.children[-1].elements.append(child)
                else:
                    node = Node.__new__(Node)
                    node.key, node.elements, node.index, node.children = kind, [child], -1, []
                    self.children.append(node)
        self.children = [Node(c.key, c.elements, inside or c.elements[0].tag in ("article", "main")) for c in self.children]

    def walk(self) -> Iterator[Node]:
        yield self
        for child in self.children:
            yield from child.walk()

    def skeleton(self) -> list:
        return [self.key, [c.skeleton() for c in self.children]]


def _pairs(a: list[str], b: list[str], size: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """The order-preserving pairs of equal keys with the largest sum of sizes. Lists of over CELLS pairs are first cut at their common
    beginning and end, and what is left is matched along a band around its diagonal."""
    head = tail = 0
    if len(a) * len(b) > CELLS:
        least = min(len(a), len(b))
        while head < least and a[head] == b[head]:
            head += 1
        while tail < least - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
    n, m = len(a) - head - tail, len(b) - head - tail
    ends = [(k, k) for k in range(head)], [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]
    if not n or not m:
        return [*ends[0], *ends[1]]
    width = m if n * m <= CELLS else max(8, CELLS // n)
    # rows of scores from place low[i] on; a step is 1: skip in a, 2: skip in b, 3: a pair
    low = [min(max(0, i * m // n - width // 2), max(0, m - width)) for i in range(n + 1)]
    before, steps = [0] * (m + 1), []
    for i in range(1, n + 1):
        first, last = low[i], min(m, low[i] + width)
        now, step = [0] * (m + 1), bytearray(last - first + 1)
        key = a[head + i - 1]
        now[first] = before[first]
        step[0] = 1
        for j in range(first + 1, last + 1):
            best, way = (before[j], 1) if before[j] >= now[j - 1] else (now[j - 1], 2)
            if key == b[head + j - 1]:
                total = before[j - 1] + size(head + i - 1, head + j - 1)
                if total > best:
                    best, way = total, 3
            now[j], step[j - first] = best, way
        for j in range(last + 1, m + 1 if width < m else 0):
            now[j] = now[last]
        before = now
        steps.append(step)
    found, i, j = [], n, m
    while i and j:
        at = j - low[i]
        way = steps[i - 1][at] if 0 <= at < len(steps[i - 1]) else 2 if at > 0 else 1
        if way == 3:
            found.append((head + i - 1, head + j - 1))
            i, j = i - 1, j - 1
        elif way == 2:
            j -= 1
        else:
            i -= 1
    return [*ends[0], *reversed(found), *ends[1]]


def matched(a: list, b: Node) -> list[tuple[list, Node]]:
    """Simple tree matching: the largest order-preserving mapping of two trees with equal keys at equal depth.
    a: a skeleton [key, children, ...]; gives the pairs of matched nodes."""
    if a[0] != b.key:
        return []
    sizes: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def size(x: list, y: Node) -> int:
        """Pairs in the largest mapping of two trees with equal keys."""
        if not x[1] or not y.children:
            return 1
        at = id(x), id(y)
        if (known := sizes.get(at)) is None:
            pairs = _pairs([c[0] for c in x[1]], [c.key for c in y.children], lambda i, j: size(x[1][i], y.children[j]))
            chosen[at] = pairs
            known = sizes[at] = 1 + sum(size(x[1][i], y.children[j]) for i, j in pairs)
        return known

    def walk(x: list, y: Node) -> Iterator[tuple[list, Node]]:
        yield x, y
        if x[1] and y.children:
            size(x, y)
            for i, j in chosen[id(x), id(y)]:
                yield from walk(x[1][i], y.children[j])

    return list(walk(a, b))


def _numbered(skeleton: list, start: int = 0) -> int:
    """Gives the skeleton's nodes their numbers, in page order, as third entries; gives their count."""
    skeleton.append(start)
    start += 1
    for child in skeleton[1]:
        start = _numbered(child, start)
    return start


def _link_chars(node: Node) -> int:
    total = 0
    todo = [(e, False) for e in node.elements]
    while todo:
        element, link = todo.pop()
        for child in element.children:
            if isinstance(child, str):
                total += len(child.strip()) if link else 0
            elif not boilerplate(child, True):
                todo.append((child, link or child.tag == "a"))
    return total


def _text_of(node: Node) -> str:
    return "\n".join(blocks(node.elements, inside=True))


def _hash(text: str) -> int:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return int(span_hash(prefix_hash(raw), np.zeros(1, np.int64), np.full(1, len(raw)))[0].view(np.int64))


def content_slot(skeleton: list, sums: dict[int, list[int]]) -> tuple[int, list[int]]:
    """The number of the content slot, and those of the template nodes within it. sums: for each node pages, pages with the pivot's
    text, characters and link characters."""

    def template(node: list) -> bool:
        pages, same, *_ = sums.get(node[2], (0, 0, 0, 0))
        return pages >= 4 and same >= 0.9 * pages and not any(name in node[0].split(" ")[0] for name in ("html", "body", "article", "main"))

    def mass(node: list) -> int:
        pages, same, chars, links = sums.get(node[2], (0, 0, 0, 0))
        return 0 if template(node) else max(0, chars - links)

    def every(node: list) -> Iterator[list]:
        yield node
        for child in node[1]:
            yield from every(child)

    total = mass(skeleton)
    named = [n for n in every(skeleton) if n[0].split(" ")[0] in ("article", "main") and mass(n) > 0.3 * total]
    if named:
        slot = max(named, key=lambda n: (n[0].split(" ")[0] == "article", mass(n), -n[2]))
    else:
        slot = skeleton
        while slot[1]:
            child = max(slot[1], key=lambda n: (mass(n), -n[2]))
            if mass(child) < 0.8 * mass(slot) or not child[1]:
                break
            slot = child
    return slot[2], [n[2] for n in every(slot) if n is not slot and template(n)]


def _tree(html: str | None) -> Node:
    return Node("#page", [parse(html or "")])


def layout(tree: Node) -> str:
    """A page's layout: the names of the containers from the page to the article, each with half of the text of its parent at least."""
    def own(element: Element) -> int:
        return sum(len(c) if isinstance(c, str) else own(c) for c in element.children if isinstance(c, str) or c.tag in _INLINE)

    def total(node: Node) -> int:
        size = sum(map(own, node.elements)) + sum(map(total, node.children))
        sizes[id(node)] = size
        return size

    sizes: dict[int, int] = {}
    total(tree)
    node, names = tree, []
    while node.children:
        child = max(node.children, key=lambda c: sizes[id(c)])
        if 2 * sizes[id(child)] < sizes[id(node)] or child.key.split(" ")[0] not in _CONTAINERS:
            break
        names.append(child.key)
        if child.key.split(" ")[0] == "article":
            break
        node = child
    return f"{_hash('>'.join(names)):x}" if names else "none"


def extract(tree: Node, skeleton: list | None, slot: int, template: list[int]) -> str:
    """The main text of a page, by its host's wrapper."""
    taken: list[Element] = []
    skip: set[int] = set()
    if skeleton is not None:
        for a, node in matched(skeleton, tree):
            if a[2] == slot:
                taken += node.elements
            elif a[2] in template:
                skip.update(id(e) for e in node.elements)
    if taken:
        texts = blocks(taken, skip)
        if texts or slot == 0:
            return "\n\n".join(texts)
    own = tree.skeleton()
    count = _numbered(own)
    nodes = list(tree.walk())
    sums = {k: [1, 0, len(_text_of(nodes[k])), _link_chars(nodes[k])] for k in range(count)}
    return "\n\n".join(blocks(nodes[content_slot(own, sums)[0]].elements))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _with_pivots(pages: DataFrame, pivots: DataFrame, run, schema: str) -> DataFrame:
    """run(batches, pivots by host or None) over the pages, the pivots broadcast if they are small; else joined in. A host's
    pivots are texts by layout."""
    pivots = pivots.groupBy("host").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("layout", "pivot")))).alias("pivot"))
    if (pivots.agg(F.sum(F.length("pivot") + 100)).first()[0] or 0) <= SMALL:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: json.loads(r["pivot"]) for r in pivots.collect()})
        return pages.mapInArrow(releasing(lambda batches: run(batches, shared.value)), schema)
    return pages.join(pivots, "host", "left").mapInArrow(releasing(lambda batches: run(batches, None)), schema)


class _Pivots:
    """A host's pivots by layout, read once while they are remembered."""

    def __init__(self, known: dict | None, numbered: bool):
        self.known, self.numbered = known, numbered
        self.ready: dict[str, dict] = {}

    def of(self, batch: pa.RecordBatch, row: int) -> dict:
        name = batch.column("host")[row].as_py()
        if (found := self.ready.get(name)) is None:
            texts = self.known.get(name) if self.known is not None else json.loads(batch.column("pivot")[row].as_py() or "{}")
            found = {k: json.loads(t) for k, t in (texts or {}).items()}
            if self.numbered:
                for skeleton in found.values():
                    _numbered(skeleton)
            if len(self.ready) >= 2000:
                self.ready.clear()
            self.ready[name] = found
        return found


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of pages: page_id, url, text and n_chars, the text's code points."""
    small_batches(pages.sparkSession)
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    host = F.coalesce(F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    pages = pages.withColumn("host", host)

    first = pa.schema([("host", pa.string()), ("layout", pa.string()), ("rank", pa.int64()), ("pages", pa.int64()), ("pivot", pa.string())])

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, str], list] = {}
        for whole in batches:
            for batch in text_slices(whole, "html"):
                hosts, ranks = batch.column("host").to_pylist(), batch.column("rank").to_pylist()
                for name, rank, html in zip(hosts, ranks, batch.column("html").to_pylist(), strict=True):
                    tree = _tree(html)
                    entry = best.setdefault((name, layout(tree)), [rank, 0, None])
                    entry[1] += 1
                    if entry[2] is None or rank < entry[0]:
                        entry[0], entry[2] = rank, json.dumps(tree.skeleton())
                if len(best) > 2000:
                    yield send(best)
                    best = {}
        if best:
            yield send(best)

    def send(best: dict[tuple[str, str], list]) -> pa.RecordBatch:
        rows = [(*key, *entry) for key, entry in best.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), first.types, strict=True)], schema=first)

    picked = pages.where("html is not null and html <> ''").select("host", F.xxhash64("page_id", "html").alias("rank"), "html")
    layouts = picked.mapInArrow(releasing(candidates), "host string, layout string, rank long, pages long, pivot string").groupBy("host", "layout")
    layouts = written(layouts.agg(F.min("rank").alias("rank"), F.sum("pages").alias("pages"), F.min_by("pivot", "rank").alias("pivot")))
    shared = layouts.groupBy("host").agg(F.lit("").alias("layout"), F.min_by("pivot", "rank").alias("pivot"), F.min("pages").alias("pages")).where(F.col("pages") < OWN_LAYOUT)
    pivots = written(layouts.where(F.col("pages") >= OWN_LAYOUT).select("host", "layout", "pivot").unionByName(shared.drop("pages")))

    counted = pa.schema([("host", pa.string()), ("layout", pa.string()), ("node", pa.int32()), ("text", pa.int64()), ("pages", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch], known: dict | None) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, int, int], list[int]] = {}
        pivots = _Pivots(known, True)

        def send() -> pa.RecordBatch:
            rows = [(*key, *value) for key, value in sums.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), counted.types, strict=True)], schema=counted)

        for whole in batches:
            for batch in text_slices(whole, "html"):
                for row, (name, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
                    if not html or not (own := pivots.of(batch, row)):
                        continue
                    tree = _tree(html)
                    seen: dict[int, tuple[int, int, int]] = {}
                    for kind in {layout(tree), ""} & own.keys():
                        for a, node in matched(own[kind], tree):
                            if id(node) not in seen:
                                text = _text_of(node)
                                seen[id(node)] = _hash(text), len(text), _link_chars(node)
                            text, chars, links = seen[id(node)]
                            entry = sums.setdefault((name, kind, a[2], text), [0, 0, 0])
                            entry[0] += 1
                            entry[1] += chars
                            entry[2] += links
                if len(sums) > 50_000:
                    yield send()
                    sums = {}
        if sums:
            yield send()

    schema = "host string, layout string, node int, text long, pages long, chars long, links long"
    sums = _with_pivots(pages.select("host", "html"), pivots, count, schema).groupBy("host", "layout", "node", "text").agg(*(F.sum(c).alias(c) for c in ("pages", "chars", "links")))
    # a node's commonest text, of whatever length
    sums = sums.groupBy("host", "layout", "node").agg(F.sum("pages").alias("pages"), F.max("pages").alias("same"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    sums = sums.groupBy("host", "layout").agg(F.collect_list(F.struct("node", "pages", "same", "chars", "links")).alias("sums"))

    @F.udf("string")
    def wrapper(pivot, rows):
        skeleton = json.loads(pivot)
        _numbered(skeleton)
        slot, template = content_slot(skeleton, {r["node"]: [r["pages"], r["same"], r["chars"], r["links"]] for r in rows or ()})
        return json.dumps([skeleton, slot, template])

    wrappers = written(pivots.join(sums, ["host", "layout"], "left").select("host", "layout", wrapper("pivot", "sums").alias("pivot")))
    result = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def take(batches: Iterator[pa.RecordBatch], known: dict | None) -> Iterator[pa.RecordBatch]:
        wrappers = _Pivots(known, False)
        for whole in batches:
            for batch in text_slices(whole, "html"):
                texts = []
                for row, html in enumerate(batch.column("html").to_pylist()):
                    own, tree = (wrappers.of(batch, row), _tree(html)) if html else ({}, None)
                    found = own.get(layout(tree), own.get("")) if own else None
                    texts.append(extract(tree, *found) if found else "\n\n".join(blocks([parse(html)])) if html else "")
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=result)

    return _with_pivots(pages, wrappers, take, "page_id long, url string, text string, n_chars long")
