"""HTML extraction by wrapper induction.

Pages of one host share a template, or a few: one page (the smallest content
hash) of each of its most frequent layouts is a model tree; every other distinct
page is aligned with its layout's model, or the first one, by simple tree matching, which finds the largest top-down matching of two ordered
trees with equal node labels.  A model node whose text is the same in nearly
all pages that have it is a constant node: template.  Nodes aligned with
constant nodes are dropped; varying slots are content.

Inside a varying ``article`` or ``main`` slot constant frames (``div``, lists,
tables, ...) that nearly all pages of the host have are template; constant
paragraphs and headings stay (pages may share passages).  An ``article`` that is
constant is template as a whole.  Elements that are
menus, footers, sidebars, forms, scripts or styles by their tag are never
content, varying or not.  A listed word in role, class or id (adverts, notices,
comments) drops an element only if it is constant, or if it holds no article
and less than a share of the page's varying text; reader comments always go.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from html.parser import HTMLParser
from math import isqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import BROADCAST_IDS, let, map_rows, shared_table

#: a model node is constant when so many distinct pages have it, and so large
#: a share of them has it with the model's text
LEAST_PAGES, CONSTANT_SHARE = 5, 0.9
#: alignment tables up to this size are filled without numpy, and up to the
#: second kept whole; of larger ones only some rows are kept at a time
SMALL_CELLS, ALIGN_CELLS = 400, 250_000
#: models per host: its most frequent layouts
LAYOUTS = 8

#: hosts' models up to this many bytes in all are sent to every task
BROADCAST_BYTES = 32 << 20

#: fixed values of HTML: elements without an end tag, and elements that start a block
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: what an opening tag closes when it is the innermost open element of its kind
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: never content: by tag, by role, by a word of class or id
TAGS_OUT = frozenset(
    "script style noscript template nav footer aside form button select textarea input label iframe object embed svg canvas menu dialog head title "
    "fieldset datalist audio video map".split()
)
ROLES_OUT = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
WORDS_OUT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead footer sidebar aside rail widget comment comments reply replies disqus respond notice cookie cookies consent gdpr alert popup modal "
    "overlay newsletter subscribe subscription signup login form search share sharing social related recommended pagination pager skip toolbar".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: frames inside an article: constant ones on nearly all pages of the host are template; constant paragraphs,
#: headings, items and cells may be passages that pages share
FRAMES = frozenset("address aside center details div dl figure menu ol section summary table ul".split())
#: words that leave a listed word its meaning (promo-box), and first words that make it a flag of the layout (has-sidebar)
NEUTRAL = frozenset("box list section area container wrapper wrap inner outer block bar button buttons link links item items row col column left right top bottom site slot panel".split())
FLAGS = frozenset("has no not with without is".split())
COMMENTS = frozenset("comment comments reply replies disqus respond".split())
#: a marked element is content if it holds this share of the page's varying text: MOST for a mark of listed words, LITTLE
#: for one with other words in it; reader comments are never content
MOST, LITTLE = 0.5, 0.1


class Node:
    """An element, or a text node (tag ``#text``)."""

    __slots__ = ("children", "label", "marks", "slug", "tag", "text")

    def __init__(self, tag: str, marks: str = "", text: str = "", slug: str = ""):
        self.tag, self.marks, self.text, self.slug = tag, marks, text, slug
        self.label = f"{tag}.{marks}" if marks else tag
        self.children: list[Node] = []


_PARAGRAPH, _OTHER_BLOCKS = frozenset({"p"}), BLOCKS - {"p"}


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not needed

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._close(_PARAGRAPH, _OTHER_BLOCKS)
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES[tag])
        if attrs:
            given = dict(attrs)
            marks = " ".join(given[k] or "" for k in ("role", "class", "id", "itemprop") if given.get(k)).lower()
            node = Node(tag, marks, slug=(given.get("id") or "").lower())
        else:
            node = Node(tag)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def _close(self, tags: set[str], scope: set[str] | frozenset[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in scope:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        last = self.open[-1].children
        if last and last[-1].tag == "#text":
            last[-1].text += data
        else:
            last.append(Node("#text", text=data))


def parse(page: str | None) -> Node:
    """The tree of a page; broken and cut-off markup is closed where it ends."""
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


def preorder(root: Node) -> list[Node]:
    out, work = [], [root]
    while work:
        node = work.pop()
        out.append(node)
        work.extend(reversed(node.children))
    return out


def text_key(node: Node) -> int:
    """Hash of the text below a node, white space folded."""
    return zlib.crc32(" ".join(" ".join(n.text for n in preorder(node) if n.tag == "#text").split()).encode())


class Texts:
    """``text_key`` of the nodes of one tree: each node covers a run of the
    tree's folded text pieces, so a tree is walked once for all its keys."""

    def __init__(self, root: Node):
        self.pieces: list[str] = []
        self.first: dict[int, int] = {}
        self.end: dict[int, int] = {}
        work: list[tuple[Node, bool]] = [(root, False)]
        while work:
            node, left = work.pop()
            if left:
                self.end[id(node)] = len(self.pieces)
                continue
            self.first[id(node)] = len(self.pieces)
            if node.tag == "#text":
                folded = " ".join(node.text.split())
                if folded:
                    self.pieces.append(folded)
                self.end[id(node)] = len(self.pieces)
            else:
                work.append((node, True))
                work.extend((c, False) for c in reversed(node.children))

    def key(self, node: Node) -> int:
        return zlib.crc32(" ".join(self.pieces[self.first[id(node)] : self.end[id(node)]]).encode())


def _shapes(root: Node, known: dict[tuple, int]) -> dict[int, int]:
    """The shape of every node: equal numbers for equal trees of labels.  A
    shape's number is larger than those of its children."""
    out: dict[int, int] = {}
    for node in reversed(preorder(root)):
        key = (node.label, *[out[id(c)] for c in node.children])
        out[id(node)] = known.setdefault(key, len(known))
    return out


def tree_match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the pairs of the largest top-down matching.

    Elements match if their labels do; children are matched in order.  Text
    nodes match each other.  How much two trees match depends on their shapes
    alone, so it is found once for each pair of shapes."""
    known: dict[tuple, int] = {}
    left, right = _shapes(a, known), _shapes(b, known)
    shapes, sizes = list(known), []
    for shape in shapes:
        sizes.append(1 + sum(sizes[c] for c in shape[1:]))
    values: dict[tuple[int, int], int] = {}

    def value(x: int, y: int) -> int:
        if x == y:
            return sizes[x]
        if shapes[x][0] != shapes[y][0]:
            return 0
        return values[x, y] if len(shapes[x]) > 1 and len(shapes[y]) > 1 else 1

    def prepare(x: int, y: int) -> None:  # post-order over the pairs that can match, without recursion
        work = [(x, y, False)]
        while work:
            x, y, ready = work.pop()
            if x == y or (x, y) in values or shapes[x][0] != shapes[y][0] or len(shapes[x]) == 1 or len(shapes[y]) == 1:
                continue
            if ready:
                values[x, y] = 1 + _best(shapes[x][1:], shapes[y][1:], value)
            else:
                work.append((x, y, True))
                work.extend((p, q, False) for p in set(shapes[x][1:]) for q in set(shapes[y][1:]))

    if a.label != b.label:
        return []
    prepare(left[id(a)], right[id(b)])
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if left[id(x)] == right[id(y)]:
            todo.extend(zip(x.children, y.children, strict=True))
        elif x.children and y.children:
            pairs = _aligned([left[id(c)] for c in x.children], [right[id(c)] for c in y.children], value)
            todo.extend((x.children[i], y.children[j]) for i, j in pairs)
    return out


Value = Callable[[int, int], int]


def _gains(xs: Sequence[int], ys: Sequence[int], value: Value, first: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Rows of the alignment table, the one before the first x included."""
    kinds, place = np.unique(np.asarray(ys), return_inverse=True)
    row = np.zeros(len(ys) + 1, dtype=np.int32) if first is None else first
    yield row
    for x in xs:
        worth = np.array([value(x, int(y)) for y in kinds], dtype=np.int32)[place]
        step = np.where(worth > 0, row[:-1] + worth, 0)
        row = np.concatenate([row[:1], np.maximum.accumulate(np.maximum(row[1:], step))])
        yield row


def _table(xs: Sequence[int], ys: Sequence[int], value: Value) -> list[list[int]]:
    gain = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row = gain[-1], [0]
        for j, y in enumerate(ys):
            best = max(row[j], above[j + 1])
            worth = value(x, y)
            if worth:
                best = max(best, above[j] + worth)
            row.append(best)
        gain.append(row)
    return gain


def _best(xs: Sequence[int], ys: Sequence[int], value: Value) -> int:
    if len(xs) * len(ys) <= SMALL_CELLS:
        return _table(xs, ys, value)[-1][-1]
    row = None
    for row in _gains(xs, ys, value):
        pass
    return int(row[-1])


def _aligned(xs: Sequence[int], ys: Sequence[int], value: Value) -> list[tuple[int, int]]:
    """Places of the children paired by the best alignment, in order.  Only
    every k-th row of a large table is kept, and the rows between are made
    again on the way back: exact, in memory of about the lists' lengths times
    the square root of the number of rows."""
    n, j, pairs = len(xs), len(ys), []
    small = n * j <= SMALL_CELLS
    block = n if n * j <= ALIGN_CELLS else isqrt(n) + 1
    kept = [] if small else [row for k, row in enumerate(_gains(xs, ys, value)) if k % block == 0]
    for start in range((n - 1) // block * block, -1, -block):
        part = xs[start : start + block]
        gain = _table(part, ys, value) if small else list(_gains(part, ys, value, kept[start // block]))
        i = len(part)
        while i and j:
            if gain[i][j] == gain[i - 1][j]:
                i -= 1
            elif gain[i][j] == gain[i][j - 1]:
                j -= 1
            else:
                pairs.append((start + i - 1, j - 1))
                i, j = i - 1, j - 1
    return pairs[::-1]


def _tag_out(node: Node, in_article: bool) -> bool:
    """Never content by its tag; a form around an article is a frame of the layout."""
    if node.tag in ("form", "fieldset") or node.tag == "header" and not in_article:
        return in_article or not _holds_article(node)
    return node.tag in TAGS_OUT


def _holds_article(node: Node) -> bool:
    return any(n.tag in ("article", "main") for n in preorder(node)[1:])


#: what ``_mark`` found; a plain dict, so that tasks get it with the function
_MARKS: dict[tuple[str, str, str], int] = {}


def _mark(tag: str, marks: str, slug: str) -> int:
    """``_read_mark`` with a memory of bounded size."""
    key = (tag, marks, slug)
    found = _MARKS.get(key)
    if found is None:
        if len(_MARKS) >= 4096:
            _MARKS.clear()
        found = _MARKS[key] = _read_mark(tag, marks, slug)
    return found


def _read_mark(tag: str, marks: str, slug: str) -> int:
    """What the words of role, class, id and itemprop say: 0 nothing, 1 a listed
    word beside others, 2 listed words only, 3 reader comments.  An id names its
    section's subject, so only one of listed words counts, and none on a heading."""
    if tag in ("html", "body", "main"):
        return 0
    found, ids = 0, slug.split()
    for token in marks.split():
        words = [w for w in re.split(r"[^a-z0-9]+", token) if w]
        listed = {w for w in words if w in WORDS_OUT or w in ROLES_OUT} - ({"widget", "form"} if tag == "article" else set())
        if not listed or words[0] in FLAGS:
            continue
        whole = all(w in listed or w in NEUTRAL or w.isdigit() for w in words)
        if token in ids and (tag in HEADINGS or not whole):
            continue
        found = max(found, 1 if not whole else 3 if listed & COMMENTS else 2)
    return found


def _varying_size(node: Node, template: set[int] | frozenset[int]) -> int:
    """Characters below a node, without template and elements that are never content by tag."""
    size, work = 0, [node]
    while work:
        n = work.pop()
        if id(n) not in template and n.tag not in TAGS_OUT:
            size += len(n.text.strip())
            work.extend(n.children)
    return size


def _is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or bool({"main", "articlebody"} & set(node.marks.split()))


def main_text(root: Node, template: set[int] = frozenset()) -> str:
    """The article's blocks, one per line.  ``template``: ids of nodes that are
    constant on the host."""
    total: list[int] = []

    def dropped(node: Node, in_article: bool, within: bool) -> bool:
        if _tag_out(node, in_article):
            return True
        mark = _mark(node.tag, node.marks, node.slug) if node.marks else 0
        if not mark or id(node) in template:
            return bool(mark)
        if not within and _holds_article(node) or mark == 1 and any(n.tag == "h1" for n in preorder(node)):
            return False
        if mark == 3:
            return True
        if not total:
            total.append(_varying_size(root, template))
        return _varying_size(node, template) < (MOST if mark == 2 else LITTLE) * total[0]

    found: list[tuple[int, Node]] = []
    work = [(0, root)]
    while work:  # outermost article or main elements, in page order, with the marked elements around them
        depth, node = work.pop()
        if _tag_out(node, False):
            continue
        depth += bool(node.marks and _mark(node.tag, node.marks, node.slug))
        if _is_main(node):
            inner = [n for n in preorder(node) if n.tag == "article" and n is not node and not _mark(n.tag, n.marks, n.slug)] if node.tag != "article" else []
            # a lone article stands for its main element if it holds most of what varies there
            lone = len(inner) == 1 and _varying_size(inner[0], template) >= MOST * _varying_size(node, template)
            found.append((depth, inner[0] if lone else node))
        else:
            work.extend((depth, c) for c in reversed(node.children))
    # articles inside more marked elements than others are teasers or comments
    least = min((depth for depth, _ in found), default=0)
    articles = [node for depth, node in found if depth == least]
    lines: list[str] = []
    part: list[str] = []

    def flush() -> None:
        line = " ".join("".join(part).split())
        part.clear()
        if line:
            lines.append(line)

    varying = [n for n in articles if id(n) not in template] or articles
    for top in varying or [root]:
        inside = bool(articles)
        todo: list[Node | str] = [top]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                flush()
            elif node.tag == "#text":
                if inside or id(node) not in template:
                    part.append(node.text)
            elif node is not top and (dropped(node, inside, top.tag == "article") or id(node) in template and (not inside or node.tag in FRAMES)):
                continue
            elif inside and node.tag == "header":
                todo.extend(reversed([n for n in preorder(node) if n.tag in HEADINGS]))
            else:
                if node.tag == "br":
                    part.append(" ")
                if node.tag in BLOCKS:
                    flush()
                    todo.append("end")
                todo.extend(reversed(node.children))
        flush()
    return "\n".join(lines)


def host_of(url: Column) -> Column:
    """Lower-case host without port; empty for none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


def layout_of(page: Column) -> Column:
    """Hash of the set of a page's frames: tags and classes without digits."""
    tags = F.regexp_extract_all(page, F.lit(r"(?i)<((?:body|main|article|section|nav|aside|header|footer|form|table|div)\b[^<>]*|[a-z][a-z0-9]*\s[^<>]*class\s*=[^<>]*)>"), F.lit(1))
    kind = lambda t: F.lower(F.concat_ws(" ", F.regexp_extract(t, r"^(\w+)", 1), F.regexp_replace(F.regexp_extract(t, r"(?i)\bclass\s*=\s*[\"']?([^\"'>]*)", 1), r"\d+", "")))
    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(tags, kind))))


def models(pages: DataFrame) -> DataFrame:
    """``host, layout, place, model``: the page with the smallest content hash
    of each host's most frequent layout (place 1) and of up to ``LAYOUTS`` - 1
    others with enough distinct pages.  Only hashes are shuffled, then the
    chosen pages."""
    laid = pages.select("host", layout_of(F.col("html")).alias("layout"), "page_hash").distinct()
    sizes = laid.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("page_hash").alias("page_hash"))
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "page_hash"))
    ranked = sizes.withColumn("place", place).filter(F.col("place") <= LAYOUTS).filter((F.col("place") == 1) | (F.col("n") >= LEAST_PAGES))
    chosen = shared_table(ranked.select("host", "layout", "place", "page_hash"), "models")
    side = F.broadcast(chosen) if chosen.count() <= BROADCAST_IDS else chosen
    return shared_table(
        pages.select("host", "page_hash", "html").join(side, ["host", "page_hash"])
        .groupBy("host", "layout", "place").agg(F.first("html").alias("model")),
        "models",
    )


def by_host(flat: DataFrame) -> DataFrame:
    """``host, models``: the models of a host in one array, by place."""
    fields = [c for c in ("place", "layout", "model", "constant", "usual") if c in flat.columns]
    return flat.groupBy("host").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("models"))


def _with_model(pages: DataFrame, hosts: DataFrame, how: str) -> DataFrame:
    """Pages with the model of their layout, or else of their host's first one;
    the hosts are broadcast only if their models are small altogether, else both
    sides are shuffled on the host."""
    size = hosts.agg(F.sum(F.octet_length(F.array_join(F.col("models.model"), "")))).first()[0] or 0
    joined = pages.join(F.broadcast(hosts) if size <= BROADCAST_BYTES else hosts, "host", how)
    of_layout = let(layout_of(F.col("html")), lambda own: F.get(F.filter("models", lambda m: m["layout"] == own), F.lit(0)))
    first = F.get("models", F.lit(0))
    return joined.withColumn("picked", F.when(F.size("models") > 1, F.coalesce(of_layout, first)).otherwise(first)).select(*pages.columns, "picked.*")


def constant_nodes(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """``host, layout, constant, usual``: preorder numbers of a model's constant
    nodes, from all distinct pages aligned with it, and of those among them that
    nearly all pages of the host have, in whichever layout.  A page votes with
    one list, twice the number of each node it has, plus one if the text is the
    model's; equal pages are merged before their votes are counted."""

    def make() -> Callable[[list[tuple]], list[tuple]]:
        known: dict[tuple, tuple] = {}

        def work(rows: list[tuple]) -> list[tuple]:
            out = []
            for host, layout, page_hash, page, model in rows:
                if (host, layout) not in known:
                    if len(known) >= 64:
                        known.clear()
                    root = parse(model)
                    texts = Texts(root)
                    known[host, layout] = (root, {id(n): (i, texts.key(n)) for i, n in enumerate(preorder(root))})
                root, numbers = known[host, layout]
                tree = parse(page)
                texts = Texts(tree)
                pairs = [(*numbers[id(x)], y) for x, y in tree_match(root, tree)]
                out.append((host, layout, page_hash, [2 * i + (texts.key(y) == key) for i, key, y in pairs]))
            return out

        return work

    votes = map_rows(
        _with_model(pages.select("host", "page_hash", "html"), by_host(chosen), "inner").select("host", "layout", "page_hash", "html", "model"),
        make, "host string, layout bigint, page_hash bigint, votes array<int>",
    ).dropDuplicates(["host", "page_hash"])
    each = votes.select("host", "layout", F.explode_outer("votes").alias("vote"))
    counts = (
        each.groupBy("host", "layout", F.shiftright("vote", 1).alias("node"))
        .agg(F.count("*").alias("n"), F.sum(F.col("vote").bitwiseAND(1)).alias("same"))
        .withColumn("is_constant", (F.col("n") >= LEAST_PAGES) & (F.col("same") >= CONSTANT_SHARE * F.col("n")))
        .groupBy("host", "layout")  # every page has the root, so the largest n counts the pages
        .agg(F.collect_list(F.when(F.col("is_constant"), F.struct("node", "n"))).alias("found"), F.max("n").alias("pages"))
    )
    found = counts.select("host", "layout", "pages", F.col("found.node").alias("node"), F.col("found.n").alias("n"))
    hosts = chosen.join(found, ["host", "layout"]).groupBy("host").agg(*[F.collect_list(c).alias(c) for c in ("layout", "model", "pages", "node", "n")])
    return map_rows(hosts, lambda: _usual, "host string, layout bigint, constant array<int>, usual array<int>", chunk=16)


def _usual(rows: list[tuple]) -> list[tuple]:
    """One row per layout of each host: its constant nodes, and those whose text
    is constant in nearly all pages of the host's layouts taken together."""
    out = []
    for host, layouts, texts, pages, nodes, counts in rows:
        having: dict[tuple[str, int], int] = {}
        keyed = []
        for model, places, n in zip(texts, nodes, counts, strict=True):
            tree = preorder(parse(model)) if len(places) else []
            keys = [(tree[i].label, text_key(tree[i])) for i in places]
            keyed.append(keys)
            most: dict[tuple[str, int], int] = {}
            for key, k in zip(keys, n, strict=True):
                most[key] = max(most.get(key, 0), int(k))
            for key, k in most.items():
                having[key] = having.get(key, 0) + k
        least = CONSTANT_SHARE * sum(pages)
        for layout, places, keys in zip(layouts, nodes, keyed, strict=True):
            out.append((host, layout, [int(i) for i in places], [int(i) for i, key in zip(places, keys, strict=True) if having[key] >= least]))
    return out


def _content_nodes(root: Node) -> dict[int, bool]:
    """Ids of the nodes whose constancy can decide: outside articles those not
    excluded by tag (False), inside frames and marked elements (True).  Aligned
    nodes have the same labels up to the root, so this holds for every page
    node aligned with them."""
    out: dict[int, bool] = {}
    work = [(root, False)]
    while work:
        node, inside = work.pop()
        if _tag_out(node, inside):
            continue
        if not inside or node.tag in FRAMES or node.marks and _mark(node.tag, node.marks, node.slug):
            out[id(node)] = inside
        inside = inside or _is_main(node)
        work.extend((c, inside) for c in node.children)
    return out


class Wrapper:
    """A host's model tree with the texts of its constant nodes, as far as
    they decide anything: others need no alignment."""

    def __init__(self, model: str | None, constant: Iterable[int] | None, usual: Iterable[int] | None):
        self.root = parse(model)
        chosen, common = (set() if nodes is None else {int(i) for i in nodes} for nodes in (constant, usual))
        content, empty = _content_nodes(self.root), text_key(Node("#text"))
        decides = ((n, content.get(id(n))) for i, n in enumerate(preorder(self.root)) if i in chosen and (i in common or not content.get(id(n))))
        texts = Texts(self.root)
        keys = {id(n): texts.key(n) for n, inside in decides if inside is not None}
        self.keys = {n: key for n, key in keys.items() if key != empty}

    def extract(self, page: str | None) -> str:
        root = parse(page)
        template = set()
        if self.keys:
            texts = Texts(root)
            template = {id(y) for x, y in tree_match(self.root, root) if id(x) in self.keys and self.keys[id(x)] == texts.key(y)}
        return main_text(root, template)


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages(page_id, url, html)``.

    Null and empty pages have the empty text.  Pages without a host share one
    (empty) host; hosts with fewer than ``LEAST_PAGES`` distinct pages have no
    template, only the structural rules.  Repeated rows and null ids are kept,
    copies of a page vote once; other columns are ignored."""
    rows = pages.select(
        F.col("page_id").cast("long"), "url", "html", host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page_hash")
    )
    voting = rows.filter("html IS NOT NULL AND html <> ''")
    chosen = models(voting)
    wrappers = shared_table(by_host(chosen.join(constant_nodes(voting, chosen), ["host", "layout"], "left")), "wrappers")

    def make() -> Callable[[list[tuple]], list[tuple]]:
        known: dict[tuple, Wrapper] = {}

        def work(batch: list[tuple]) -> list[tuple]:
            out = []
            for page_id, url, page, host, layout, model, constant, usual in batch:
                if (host, layout) not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[host, layout] = Wrapper(model, constant, usual)
                text = known[host, layout].extract(page)
                out.append((page_id, url, text, len(text)))
            return out

        return work

    joined = _with_model(rows, wrappers, "left").select("page_id", "url", "html", "host", "layout", "model", "constant", "usual")
    return map_rows(joined, make, "page_id bigint, url string, text string, n_chars bigint")

