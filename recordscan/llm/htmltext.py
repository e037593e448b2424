"""Main text of web pages by wrapper induction.

Pages of a host that are laid out alike are aligned with a reference page by
simple tree matching: the largest order-preserving match of equal tags from
the roots down. A reference node whose text is the same in most of the pages
that it is aligned in is template, as is what its aligned nodes hold; varying
slots are content. What a page's own markup says (an article, a menu, a form,
a comment) decides only among the slots that are left, and where a page has no
sibling to be aligned with.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, lean, settle, slices, table

#: A node is template if it is the same in `same` of `aligned` pages and same >= CONSTANT * (aligned + 1): in three of three, or in most of many.
CONSTANT = 0.75
#: Share of a page's varying text that its articles hold, if they are the content.
ARTICLES = 1 / 3
#: Bytes of references that are broadcast; a larger set is joined by host and layout.
BROADCAST_BYTES = 64 << 20
#: Elements whose order makes a page's layout.
SECTIONS = "div|nav|header|main|article|section|aside|form|footer"
#: Pairs of children from which their table is filled by diagonals instead of cell by cell, with the same result.
BY_CELLS = 4_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements whose text is never content.
_NEVER = frozenset("script style title head nav footer aside form noscript template iframe object embed svg math canvas audio video map button select option textarea input label fieldset legend dialog menu noembed noframes xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An open element of the value that a start tag of the key ends.
_ENDS = {k: frozenset(v.split()) for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "thead": "tr td th", "tbody": "tr td th thead", "tfoot": "tr td th tbody", "option": "option"}.items()}
_SCOPE = frozenset("ul ol dl table article main section aside nav body html".split())
#: Words that name what is not the article, and words that such names have beside them; a name of other words as well says nothing.
_ASIDE = frozenset("ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus disclaimer footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promos related replies respond search share sharing sidebar social sponsor sponsored subscribe toolbar topbar widget widgets".split())
_BESIDE = frozenset("area article bar bottom box block btn button buttons container content form global group header icons inner item items left link links list main message outer page policy post posts primary right row secondary section signup site slot text thread top unit wrap wrapper".split())
#: Elements whose names are heeded: an anchor on a heading or a paragraph names what it says.
_NAMED = frozenset("div section ul ol aside nav header footer table dl span article form".split())


def is_aside(name: str) -> bool:
    """Whether a class, id or role is made of nothing but words for what is not the article, and words that go with them."""
    words = [w for w in re.split(r"[-_\s]+", name.lower()) if w]
    return any(w in _ASIDE for w in words) and all(w in _ASIDE or w in _BESIDE for w in words)


class Node:
    __slots__ = ("tag", "boilerplate", "children", "text", "kids", "size", "key")

    def __init__(self, tag: str, boilerplate: bool = False):
        self.tag, self.boilerplate = tag, boilerplate
        self.children: list[Node | str] = []
        #: set by nodes_of: its own and its inline descendants' text, its block children, its nodes, a digest of all it holds
        self.text, self.kids, self.size, self.key = "", [], 1, 0

    def elements(self) -> list[Node]:
        return [c for c in self.children if not isinstance(c, str)]


def parse(source: str) -> Node:
    """The tree of a page, however broken: text is kept as strings, references decoded later. Time grows with the length alone."""
    root = Node("html")
    stack = [root]
    opened: dict[str, int] = {}
    at, end = 0, len(source)
    told = False

    def say(text: str) -> None:
        if text:
            stack[-1].children.append(text)

    def cut(i: int) -> None:
        for n in stack[i:]:
            opened[n.tag] -= 1
        del stack[i:]

    while at < end:
        m = _TOKEN.search(source, at)
        if not m:
            say(source[at:])
            break
        say(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag == "html":
            continue
        if tag in _BLOCK and opened.get("p"):
            for i in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph
                if stack[i].tag == "p":
                    cut(i)
                    break
                if stack[i].tag in _BLOCK:
                    break
        if tag in _ENDS and any(opened.get(t) for t in _ENDS[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _ENDS[tag]:
                    cut(i)
                    if tag not in ("tr", "thead", "tbody", "tfoot"):
                        break
                elif stack[i].tag in _SCOPE:
                    break
        aside = False
        if tag in _NAMED and "=" in m[3]:
            for name, *values in _ATTRIBUTE.findall(m[3]):
                value = next(filter(None, values), "")
                aside = aside or any(map(is_aside, value.split() if name.lower() == "class" else [value]))
        node = Node(tag, aside)
        stack[-1].children.append(node)
        if tag in ("article", "main"):
            if not opened.get("article") and not told:
                told = True
                for n in stack:  # what holds a page's first article is not beside it
                    n.boilerplate = False
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
            stop = close.start() if close else end
            node.children.append(source[at:stop])
            at = close.end() if close else end
            continue
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
    return root


def nodes_of(root: Node) -> list[Node]:
    """Block elements in page order; what tree matching needs to know of each is taken on the way."""
    found: list[Node] = []
    todo = [root]
    while todo:  # parents first; a stack, as broken pages may nest deeper than Python calls may
        node = todo.pop()
        found.append(node)
        node.text = tidy(own_text(node))
        node.kids = block_children(node)
        todo += reversed(node.kids)
    for node in reversed(found):
        node.size = 1 + sum(c.size for c in node.kids)
        node.key = hash((node.tag, node.text, *(c.key for c in node.kids)))
    return found


def block_children(node: Node) -> list[Node]:
    """The nearest block (or never shown) elements below a node."""
    found: list[Node] = []
    todo = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            continue
        if c.tag in _BLOCK or c.tag in _NEVER or c.boilerplate:
            found.append(c)
        else:
            todo += reversed(c.children)
    return found


def own_text(node: Node) -> str:
    parts: list[str] = []
    todo = list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            parts.append(c)
        elif c.tag in _BLOCK or c.tag in _NEVER or c.boilerplate:
            parts.append(" ")
        else:
            if c.tag in ("br", "wbr"):
                parts.append(" " if c.tag == "br" else "")
            todo += reversed(c.children)
    return "".join(parts)


def tidy(text: str) -> str:
    return " ".join((html.unescape(text) if "&" in text else text).split())


#: A matched pair of nodes counts so much more than a pair's equal texts: these decide between matches of the same size.
_PAIR = 1 << 20


def simple_tree_matching(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of the largest order-preserving match of two trees with equal tags at the roots.

    Of matches of the same size one with the most equal texts is taken. Trees
    are as nodes_of has left them. Weights of subtrees are found from the
    leaves up, each pair of nodes once.
    """
    if a.tag != b.tag:
        return []
    known: dict[tuple[int, int], tuple[int, list[tuple[Node, Node]]]] = {}

    def weight(u: Node, v: Node) -> int:
        if u.tag != v.tag:
            return 0
        if u.kids and v.kids:
            return known[id(u), id(v)][0]
        return _PAIR + (u.text == v.text)

    stack = [(a, b)]
    while stack:
        u, v = stack[-1]
        if (id(u), id(v)) in known:
            stack.pop()
            continue
        us, vs = u.kids, v.kids
        # children that are equal all through cannot be matched better than with each other, at either end
        n, m = len(us), len(vs)
        first = 0
        while first < min(n, m) and us[first].key == vs[first].key:
            first += 1
        last = 0
        while last < min(n, m) - first and us[n - 1 - last].key == vs[m - 1 - last].key:
            last += 1
        same = [*zip(us[:first], vs[:first]), *zip(us[n - last :], vs[m - last :])]
        us, vs = us[first : n - last], vs[first : m - last]
        need = [(x, y) for x, y in same if x.kids and (id(x), id(y)) not in known]
        with_kids = [y for y in vs if y.kids]
        need += [(x, y) for x in us if x.kids for y in with_kids if x.tag == y.tag and (id(x), id(y)) not in known]
        if need:
            stack += need
            continue
        stack.pop()
        total, pairs = _largest(us, vs, weight)
        total += sum(weight(x, y) for x, y in same)
        known[id(u), id(v)] = _PAIR + (u.text == v.text) + total, [*same, *pairs]
    out, todo = [(a, b)], [(a, b)]
    while todo:
        u, v = todo.pop()
        for pair in known.get((id(u), id(v)), (0, ()))[1]:
            out.append(pair)
            if pair[0].kids and pair[1].kids:
                todo.append(pair)
    return out


def _largest(us: list[Node], vs: list[Node], weight) -> tuple[int, list[tuple[Node, Node]]]:
    """The heaviest order-preserving match of two lists."""
    n, m = len(us), len(vs)
    if not n or not m:
        return 0, []
    if n * m > BY_CELLS:
        return _by_diagonals(us, vs, weight)
    best = [[0] * (m + 1)]
    rows = [[weight(u, v) for v in vs] for u in us]
    for w in rows:
        above, row = best[-1], [0] * (m + 1)
        for j in range(m):
            k = above[j] + w[j]
            if above[j + 1] > k:
                k = above[j + 1]
            row[j + 1] = k if k > row[j] else row[j]
        best.append(row)
    i, j, pairs = n, m, []
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((us[i], vs[j]))
    return best[n][m], pairs[::-1]


def _by_diagonals(us: list[Node], vs: list[Node], weight) -> tuple[int, list[tuple[Node, Node]]]:
    """The same for long lists: the cells of a diagonal at once, and of each cell only where its value comes from (two bits)."""
    n, m = len(us), len(vs)
    tags = {t: k for k, t in enumerate({x.tag for x in (*us, *vs)})}
    texts: dict[str, int] = {}
    tag_u, tag_v = (np.array([tags[x.tag] for x in xs]) for xs in (us, vs))
    text_u, text_v = (np.array([texts.setdefault(x.text, len(texts)) for x in xs]) for xs in (us, vs))
    inner_v = [j for j, v in enumerate(vs) if v.kids]
    inner = {(i, j): weight(u, vs[j]) for i, u in enumerate(us) if u.kids for j in inner_v if u.tag == vs[j].tag}
    by_diagonal: dict[int, list[tuple[int, int]]] = {}
    for (i, j), w in inner.items():
        by_diagonal.setdefault(i + j, []).append((i, w))
    before, last = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)  # value of cell (i, d - i) of the two diagonals before, by i
    from_: list[tuple[int, np.ndarray, np.ndarray]] = []
    for d in range(2, n + m + 1):
        lo, hi = max(1, d - m), min(n, d - 1)
        i = np.arange(lo, hi + 1)
        j = d - i
        w = np.where(tag_u[i - 1] == tag_v[j - 1], _PAIR + (text_u[i - 1] == text_v[j - 1]), 0)
        for k, heavy in by_diagonal.get(d - 2, ()):
            if lo <= k + 1 <= hi:
                w[k + 1 - lo] = heavy
        up, left, both = last[i - 1], last[i], before[i - 1] + w
        value = np.maximum(np.maximum(up, left), both)
        from_.append((lo, np.packbits(value == up), np.packbits(value == left)))
        before, last = last, np.zeros(n + 1, np.int64)
        last[i] = value
    total = int(last[n])
    i, j, pairs = n, m, []
    while i and j:
        lo, up, left = from_[i + j - 2]
        k = i - lo
        if up[k >> 3] >> (7 - (k & 7)) & 1:
            i -= 1
        elif left[k >> 3] >> (7 - (k & 7)) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((us[i], vs[j]))
    return total, pairs[::-1]


def main_text(root: Node, template: set[int]) -> str:
    """Blocks of a page's content; template: ids of nodes that are the host's template."""

    def collect(top: Node, use: set[int]) -> list[str]:
        blocks: list[str] = []
        todo: list[Node | str | None] = [top]
        held: list[str] = []

        def close() -> None:
            if held:
                text = tidy("".join(held))
                held.clear()
                if text:
                    blocks.append(text)

        while todo:
            c = todo.pop()
            if c is None:
                close()
            elif isinstance(c, str):
                held.append(c)
            elif c is not top and (c.tag in _NEVER or c.boilerplate):
                close()
            elif id(c) in use:
                close()
                # a template node's own text goes; blocks inside it speak for themselves
                todo += [None, *reversed(c.kids)]
            elif c.tag in _BLOCK:
                close()
                todo += [None, *reversed(c.children)]
            else:
                if c.tag == "br":
                    held.append(" ")
                todo += reversed(c.children)
        close()
        return blocks

    whole = collect(root, template)
    if not whole and template:  # pages that are all alike leave no slot: what markup says is all there is to go by
        template = set()
        whole = collect(root, template)
    size = sum(map(len, whole))
    for tag in ("article", "main"):
        blocks = [b for top in _outermost(root, tag) for b in collect(top, template)]
        if blocks and sum(map(len, blocks)) >= ARTICLES * size:
            return "\n\n".join(blocks)
    header = _page_headers(root)
    return "\n\n".join(collect(root, template | header) if header else whole)


def _outermost(root: Node, tag: str) -> list[Node]:
    """The outermost elements of a name that are not beside the content."""
    found: list[Node] = []
    todo: list[Node] = [root]
    while todo:
        n = todo.pop()
        if n.tag == tag and not n.boilerplate:
            found.append(n)
        elif n is root or n.tag not in _NEVER and not n.boilerplate:
            todo += reversed(n.elements())
    return found


def _page_headers(root: Node) -> set[int]:
    """Nodes of headers of a page without an article, and of all that is in them."""
    found: set[int] = set()
    todo = [(root, False)]
    while todo:
        n, inside = todo.pop()
        inside = inside or n.tag == "header"
        if inside:
            found.add(id(n))
        todo += ((c, inside) for c in n.elements())
    return found


def host_of(url: Column) -> Column:
    """The host of a url, lower-cased, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


_references: dict[str, tuple[Node, dict[int, int]]] = {}
#: Characters of the references whose trees a worker keeps.
KEPT_CHARS = 4_000_000


def _reference(source: str) -> tuple[Node, dict[int, int]]:
    """A reference page's tree, and the number of each node."""
    if source not in _references:
        if sum(map(len, _references)) + len(source) > KEPT_CHARS:
            _references.clear()
        root = parse(source)
        _references[source] = root, {id(n): i for i, n in enumerate(nodes_of(root))}
    return _references[source]


def _page(source: str | None) -> Node:
    page = parse(source or "")
    nodes_of(page)
    return page


def layout_of(source: Column) -> Column:
    """What pages that are laid out alike have in common: their sectioning elements, in order of first appearance."""
    tags = F.regexp_extract_all(F.lower(source), F.lit(rf"<({SECTIONS})[\s/>]"), F.lit(1))
    return F.coalesce(F.array_join(F.array_distinct(tags), " "), F.lit(""))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, layout, mark, aligned, same): for each page, bitmaps of the reference nodes with text that it has, and with the same text."""
    for batch in slices(batches, "html"):
        keep, bitmaps = [], ([], [])
        for i, (source, ref) in enumerate(zip(batch.column("html").to_pylist(), batch.column("reference").to_pylist())):
            if ref is None or ref == source:
                continue
            root, number = _reference(ref)
            bits = np.zeros((2, len(number)), bool)
            for theirs, ours in simple_tree_matching(root, _page(source)):
                if theirs.text:
                    bits[:, number[id(theirs)]] = True, theirs.text == ours.text
            keep.append(i)
            for held, row in zip(bitmaps, bits):
                held.append(np.packbits(row).tobytes())
        part = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("host", "layout", "mark")), *(pa.array(x, pa.binary()) for x in bitmaps)], ["host", "layout", "mark", "aligned", "same"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, layout, node, aligned, same) of bitmaps, summed."""
    held: dict[tuple[str, str], np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (host, layout), n in held.items():
            nodes = np.flatnonzero(n[0])
            yield pa.RecordBatch.from_arrays([pa.array([host] * len(nodes), pa.string()), pa.array([layout] * len(nodes), pa.string()), pa.array(nodes.astype(np.int32)), pa.array(n[0][nodes]), pa.array(n[1][nodes])], ["host", "layout", "node", "aligned", "same"])
        held.clear()

    for batch in batches:
        for host, layout, *bitmaps in zip(*(batch.column(c).to_pylist() for c in ("host", "layout", "aligned", "same"))):
            bits = np.stack([np.unpackbits(np.frombuffer(x, np.uint8)) for x in bitmaps]).astype(np.int64)
            held[host, layout] = held.get((host, layout), 0) + bits
        if sum(x.size for x in held.values()) > 1_000_000:
            yield from out()
    yield from out()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = []
        for source, ref, constant in zip(*(batch.column(c).to_pylist() for c in ("html", "reference", "constant"))):
            page = _page(source)
            template: set[int] = set()
            if ref is not None and constant:
                root, number = _reference(ref)
                fixed = set(constant)
                # an aligned node that says something else here is a slot after all
                template = {id(ours) for theirs, ours in simple_tree_matching(root, page) if number[id(theirs)] in fixed and theirs.text == ours.text}
            texts.append(main_text(page, template))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _with_side(pages: DataFrame, side: DataFrame, size: int) -> DataFrame:
    """Pages with what a small or large table has of their host and layout; pages without an entry get nulls."""
    return pages.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, ["host", "layout"], "left")


def extract_pages(pages: DataFrame, constant: float = CONSTANT) -> DataFrame:
    """page_id, url and main text of every row of pages (page_id, url, html; other columns are ignored).

    Null or empty html and pages without content have an empty text. Pages of
    a host with the same layout share a reference, the shortest of them (then
    the one with the smallest page_id, then by its text). Pages that are alike
    in every character count once. A reference node is template if it has the
    same text in at least `constant` times one more than the pages that it is
    aligned in. Pages without a host, and those without a sibling, have no
    template: what their markup says is all there is. Repeated rows are rows
    of their own; an empty table gives no rows.
    """
    lean(pages.sparkSession)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), layout_of(F.col("html")).alias("layout"))
    told = rows.filter("host IS NOT NULL AND html <> ''").withColumn("mark", F.xxhash64("html"))
    # the shortest page, by its number; pages themselves are fetched for the chosen ones alone
    place = F.struct(F.octet_length("html"), "page_id", "mark")
    first = settle(told.groupBy("host", "layout").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("host", "layout", "at"), "hosts")
    small = first.count() * 128 <= BROADCAST_BYTES
    found = told.select("host", "layout", place.alias("at"), F.col("html").alias("reference")).join(F.broadcast(first) if small else first, ["host", "layout", "at"])
    reference = settle(found.groupBy("host", "layout").agg(F.min("reference").alias("reference")), "references")
    size, = reference.agg(F.coalesce(F.sum(F.octet_length("reference") + 128), F.lit(0))).first()
    votes = _with_side(told.select("host", "layout", "mark", "html"), reference, size).mapInArrow(frugal(_votes), "host string, layout string, mark long, aligned binary, same binary")
    counts = votes.distinct().drop("mark").mapInArrow(frugal(_counts), "host string, layout string, node int, aligned long, same long")
    fixed = counts.groupBy("host", "layout", "node").agg(F.sum("aligned").alias("aligned"), F.sum("same").alias("same"))
    fixed = fixed.filter(F.col("same") >= constant * (F.col("aligned") + 1)).groupBy("host", "layout").agg(F.sort_array(F.collect_list("node")).alias("constant"))
    side = settle(reference.join(fixed, ["host", "layout"], "left"), "templates")
    out = _with_side(rows, side, 2 * size)
    kinds = {f.name: f.dataType for f in pages.schema}
    schema = T.StructType([T.StructField("page_id", kinds["page_id"]), T.StructField("url", kinds["url"]), T.StructField("text", T.StringType())])
    return out.select("page_id", "url", "html", "reference", "constant").mapInArrow(frugal(_extract), schema)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


#: The same for pages whose content is one plain article, as that of the test tables is; pages of other shapes are held against fixtures.
ORACLE = r"""
WITH blocks AS (
    SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?b>', '', 'g'), '<br>', ' ', 'g'), '</?(?:p|h1)>'),
        lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS b
    FROM pages
)
SELECT page_id, url, array_to_string(b, chr(10) || chr(10)) AS text, length(array_to_string(b, chr(10) || chr(10))) AS n_chars FROM blocks
"""
