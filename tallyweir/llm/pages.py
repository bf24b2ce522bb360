"""Main text of web pages by wrapper induction.

Pages of one host share a few layouts. A layout is the set of the page's containers and named elements, outside
of menus and the like; pages without text have none. Every layout that is frequent on its host has a reference,
its page with the smallest id, and each page is aligned with the reference of its layout, or else with that which
shares most of its elements, by simple tree matching, the largest order-preserving match of equal elements. Per
node of a reference, the pages aligned with it vote: a node whose own text is the same in nearly all pages that
have it is template, every other node, and everything that matches no node, is a slot. Pages of one content have
one vote together. If the template would take most of what the voting pages hold, they are near copies of one
text and nothing tells wrapper from content: then nothing is template. The text of a page is what its slots
hold, without the parts whose element or class names another role (menus, forms, notices, comments, adverts ...),
inline ones included. An article element outside such parts is evidence, not a switch: the text is then what it holds, its
pages vote like all others, and a node inside it is template only if nearly all of many pages (ARTICLE_PERCENT,
ARTICLE_PAGES) agree on it. Of several articles those whose headings are all links are teasers, if another one has a
heading of its own.

The votes are sums per reference and node, added up in the tasks first, so a host with a third of all pages is
only a larger count. The references are broadcast after their size is checked, and joined by host otherwise.

Text: character references decoded; white space inside a block becomes one blank; blocks are trimmed and
joined by a newline; empty blocks vanish. Inline elements do not end a block, a line break is white space.

Defined results: a null or empty page has an empty text; broken markup is read as far as it goes (missing end
tags, unclosed tags at the end are text); a page without a usable URL has a host of its own kind ("") and is
aligned with those; repeated rows are extracted one by one; an empty table gives an empty result; other
columns are kept, except that ``text`` and ``n_chars`` of the input are replaced.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyweir.llm.links import stored

#: Bytes of references up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: A node is template if at least this share of the pages that have it agree on its text, and at least so many pages have it.
AGREE_PERCENT, LEAST_PAGES = 90, 5
#: The same for a node inside an article, where a text may well be content that some pages share.
ARTICLE_PERCENT, ARTICLE_PAGES = 99, 20
#: A layout is frequent if it has LEAST_PAGES pages and this share of its host's; the most frequent layout always is.
LAYOUT_PERCENT = 1
#: Largest share of the voting pages' text that may be template.
TEMPLATE_PERCENT = 75
CONTAINERS = frozenset("html body div section main center".split())

INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template noscript iframe object svg math head title canvas audio video".split())
RAW = re.compile(r"<(script|style|template|noscript|iframe|svg|textarea|title)\b", re.I)
ROLES = frozenset("nav footer aside form menu button select option textarea dialog fieldset input label legend".split())
ROLE_WORDS = frozenset(
    "nav navbar navigation menu sidebar ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner footer cookie cookies "
    "consent gdpr notice notices alert popup modal overlay comment comments disqus replies respond share sharing social related newsletter subscribe "
    "subscription breadcrumb breadcrumbs pagination pager toolbar widget login signup search skip disclaimer masthead "
    "nav-menu nav-bar main-nav main-menu main-navigation site-nav site-navigation primary-menu primary-nav post-navigation menu-item nav-links "
    "site-header site-footer page-footer footer-widgets sidebar-primary widget-area cookie-banner cookie-notice cookie-bar cookie-consent "
    "ad-banner ad-container ad-slot ad-wrapper share-buttons social-share social-links related-posts related-articles comment-list comments-area "
    "comment-form comment-respond newsletter-signup search-form skip-link login-form popup-overlay related-stories more-stories recommended "
    "comment-thread thread reader-comments user-comments share-links share-bar ad-label ad-unit advertisement-label sponsored-content".split()
)
#: Names for which an inline element is left out; others of these names (a comment in highlighted code) are content there.
INLINE_ROLE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo share sharing social ad-label ad-unit share-link share-links share-buttons social-share skip-link".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose names say nothing about their role: themes write the state of the page there.
NAMELESS = frozenset("html body main article".split())
MAIN_NAMES = frozenset("main main-content maincontent site-main".split())
HIDDEN = "[hidden]"
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    """An element that is not inline, with its text pieces and child elements in order."""

    __slots__ = ("tag", "names", "content", "link_chars", "shape", "size", "place")

    def __init__(self, tag: str, names: frozenset[str] = frozenset()):
        self.tag, self.names = tag, names
        self.content: list[str | Node] = []
        self.link_chars = 0
        self.place = -1

    def children(self) -> list[Node]:
        return [c for c in self.content if isinstance(c, Node)]

    def own_text(self) -> str:
        return " ".join(" ".join(c for c in self.content if isinstance(c, str)).split())

    def apart(self, inside_article: bool, by_name: bool = True) -> bool:
        """Whether the element's role is another than content; names count as whole words of class, id and role."""
        if self.tag in ROLES or self.tag in SKIPPED:
            return True
        if self.tag in NAMELESS:
            return HIDDEN in self.names and self.tag in ("main", "article")
        if HIDDEN in self.names or "hidden" in self.names:
            return True
        if self.tag == "header":
            return not inside_article
        return by_name and bool(self.names & ROLE_WORDS)


def names_of(rest: str) -> frozenset[str]:
    """Words of class, id, role and itemprop of a tag, and a mark if the element is not shown."""
    words: list[str] = []
    for a in ATTRIBUTE.finditer(rest):
        kind, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
        if kind == "hidden":
            words.append(HIDDEN if a[2] is None and a[3] is None and a[4] is None else "")
        elif kind == "style":
            words.append(HIDDEN if UNSEEN.search(value) else "")
        else:
            words += value.split()
    return frozenset(w for w in words if w)


def parse(html: str) -> Node:
    """The tree of a page. Inline elements of another role, or not shown, leave no text."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(html)
    links = 0
    pieces: list[str] = []
    muted: list[str] = []  # the open inline elements without text: an odd one and those of its tag inside

    def put(text: str) -> None:
        if text and not muted:
            pieces.append(text)
            if links:
                stack[-1].link_chars += len(text)

    def settle() -> None:
        if pieces:
            joined = "".join(pieces)
            stack[-1].content.append(entities.unescape(joined) if "&" in joined else joined)
            pieces.clear()

    while at < n:
        cut = html.find("<", at)
        if cut < 0:
            put(html[at:])
            break
        put(html[at:cut])
        if html.startswith("<!--", cut):
            end = html.find("-->", cut + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith(("<!", "<?"), cut):
            end = html.find(">", cut)
            at = n if end < 0 else end + 1
            continue
        if not html[cut + 1 : cut + 2].isalpha() and html[cut + 1 : cut + 2] != "/":
            put("<")
            at = cut + 1
            continue
        if html.find(">", cut) < 0:  # no tag can end any more
            put(html[cut:])
            break
        found = TAG.match(html, cut) or LOOSE_TAG.match(html, cut)
        if not found:
            put("<" if html[cut + 1 : cut + 2] != "/" else "")
            at = cut + 1 if html[cut + 1 : cut + 2] != "/" else html.find(">", cut) + 1
            continue
        at = found.end()
        closing, tag, rest = found[1], found[2].lower(), found[3]
        if tag == "a":
            links = 0 if closing else 1
        if tag == "br":
            put(" ")
            continue
        if tag in INLINE:
            if muted:
                if tag == muted[0]:
                    muted.pop() if closing else muted.append(tag)
            elif not closing and tag not in VOID and ("=" in rest or "hidden" in rest) and not rest.rstrip().endswith("/"):
                names = names_of(rest)
                if HIDDEN in names or names & INLINE_ROLE_WORDS:
                    muted.append(tag)
            continue
        muted.clear()  # an inline element ends with its block at the latest
        settle()
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    del stack[depth:]
                    links = 0
                    break
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    del stack[depth:]
                    break
                if stack[depth].tag not in ("p",):
                    break
        if tag in CLOSED_BY:
            while len(stack) > 1 and stack[-1].tag in CLOSED_BY[tag] | {"p"}:
                stack.pop()
        names = names_of(rest) if "=" in rest or "hidden" in rest else frozenset()
        node = Node(tag, names)
        stack[-1].content.append(node)
        if RAW.match(found[0]):
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = n if end is None else end.end()
            continue
        if tag not in VOID and not rest.rstrip().endswith("/"):
            stack.append(node)
    settle()
    return root


def measured(root: Node) -> Node:
    """Number the nodes in page order and give each its size and the shape of its tree; without recursion."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.place = len(order)
        order.append(node)
        todo.extend(reversed(node.children()))
    for node in reversed(order):
        kids = node.children()
        node.size = 1 + sum(k.size for k in kids)
        node.shape = hash((node.tag, node.names, tuple(k.shape for k in kids)))
    return root


def _alike(a: Node, b: Node) -> bool:
    return a.tag == b.tag and a.names == b.names


def _pair_all(a: Node, b: Node, out: dict[int, int]) -> None:
    """Trees of one shape match node by node."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        out[x.place] = y.place
        todo.extend(zip(x.children(), y.children(), strict=True))


def match_size(a: Node, b: Node, known: dict[tuple[int, int], int]) -> int:
    """Nodes in the largest match of two trees whose roots match."""
    if not _alike(a, b):
        return 0
    if a.shape == b.shape:
        return a.size
    key = (a.place, b.place)
    if key not in known:
        known[key] = 1 + _best(a.children(), b.children(), known, None)
    return known[key]


def _best(xs: list[Node], ys: list[Node], known: dict[tuple[int, int], int], out: list[tuple[Node, Node]] | None) -> int:
    """Size of the best order-preserving match of two rows of trees; its pairs go to ``out``."""
    head = 0
    while head < min(len(xs), len(ys)) and xs[head].shape == ys[head].shape:
        head += 1
    tail = 0
    while tail < min(len(xs), len(ys)) - head and xs[-1 - tail].shape == ys[-1 - tail].shape:
        tail += 1
    total = sum(x.size for x in xs[:head]) + sum(x.size for x in xs[len(xs) - tail :])
    left, right = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
    if out is not None:
        out += zip(xs[:head], ys[:head], strict=True)
        out += zip(xs[len(xs) - tail :], ys[len(ys) - tail :], strict=True)
    if not left or not right:
        return total
    table = [[0] * (len(right) + 1)]
    for x in left:
        above, row = table[-1], [0]
        for j, y in enumerate(right):
            row.append(max(above[j + 1], row[j], above[j] + match_size(x, y, known)))
        table.append(row)
    if out is not None:
        i, j = len(left), len(right)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                out.append((left[i - 1], right[j - 1]))
                i, j = i - 1, j - 1
    return total + table[-1][-1]


def align(page: Node, reference: Node) -> dict[int, int]:
    """By simple tree matching: place in the page -> place in the reference. Both are measured."""
    out: dict[int, int] = {}
    known: dict[tuple[int, int], int] = {}
    todo = [(page, reference)]
    while todo:
        a, b = todo.pop()
        if a.shape == b.shape:
            _pair_all(a, b, out)
            continue
        out[a.place] = b.place
        pairs: list[tuple[Node, Node]] = []
        _best(a.children(), b.children(), known, pairs)
        todo += pairs
    return out


def nodes(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(reversed(node.children()))


def _outermost(root: Node, wanted: str, by_name: bool) -> list[Node]:
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.apart(False, by_name):
            continue
        if node.tag == wanted or (wanted == "article" and "articlebody" in node.names) or (wanted == "main" and node.tag == "div" and node.names & MAIN_NAMES):
            found.append(node)
            continue
        todo.extend(reversed(node.children()))
    return found


def _chars(parts: list[Node]) -> int:
    """Length of the text of parts, without what their tags set apart."""
    total, todo = 0, list(parts)
    while todo:
        node = todo.pop()
        total += len(node.own_text())
        todo.extend(c for c in node.children() if not c.apart(True, False))
    return total


def in_article(regions: list[Node]) -> bool:
    return any(r.tag == "article" or "articlebody" in r.names for r in regions)


def contents(regions: list[Node]) -> Iterator[Node]:
    """The nodes of regions in page order, without parts of another role."""
    whole_page = regions[0].tag == "#root"
    todo = [(r, not whole_page) for r in reversed(regions)]
    while todo:
        node, inside = todo.pop()
        yield node
        todo.extend((c, inside) for c in reversed(node.children()) if not c.apart(inside))


def _own_heading(article: Node) -> bool | None:
    """Whether an article has a heading that is not a link; None without headings."""
    kinds = [2 * n.link_chars > len(n.own_text()) for n in nodes(article) if n.tag in HEADINGS and n.own_text()]
    return not all(kinds) if kinds else None


def _without_teasers(articles: list[Node]) -> list[Node]:
    own = [_own_heading(a) for a in articles] if len(articles) > 1 else []
    return [a for a, known in zip(articles, own, strict=True) if known is not False] if True in own else articles


def _regions(root: Node) -> list[Node]:
    """The outermost article elements outside of other parts, else the main element, else the whole page.

    If articles or main elements lie only in elements named like another part, the names do not count where the
    regions hold most of the page's text: then the name is a state of the page, not the role of the element.
    """
    for wanted in ("article", "main"):
        if found := _outermost(root, wanted, True):
            return _without_teasers(found)
        if (found := _outermost(root, wanted, False)) and 2 * _chars(found) > _chars([root]):
            return _without_teasers(found)
    return [root]


def blocks(page: Node, template: set[int]) -> list[str]:
    """The texts of the page's content blocks in page order; ``template`` has the places of template nodes."""
    regions = _regions(page)
    whole_page = regions == [page]
    if not any(n.own_text() for n in contents(regions) if n.place not in template):
        template = set()
    out: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        text = " ".join("".join(buffer).split())
        if text:
            out.append(text)
        buffer.clear()

    for region in regions:
        todo: list[tuple[Node, bool] | tuple[str, bool] | None] = [(region, not whole_page)]
        while todo:
            item = todo.pop()
            if item is None:
                flush()
                continue
            part, inside = item
            if isinstance(part, str):
                buffer.append(part)
                continue
            if part is not region and part.apart(inside):
                flush()
                continue
            flush()
            mute = part.place in template
            todo.append(None)
            for c in reversed(part.content):
                if isinstance(c, str):
                    if not mute:
                        todo.append((c, inside))
                else:
                    todo.append((c, inside or part.tag == "article"))
        flush()
    return out


def layout(root: Node) -> frozenset[int]:
    """Hashes of the paths of the page's containers, named elements and children of the body; empty without text."""
    out: set[int] = set()
    todo, seen_text = [(root, "")], False
    while todo:
        node, path = todo.pop()
        seen_text = seen_text or bool(node.own_text())
        for c in node.children():
            if c.apart(False):
                continue
            names = sorted(n for n in c.names if not any(x.isdigit() for x in n))
            step = f"{path}/{c.tag}.{'.'.join(names)}"
            if c.tag in CONTAINERS or names or node.tag == "body":
                out.add(int.from_bytes(blake2b(step.encode(errors="replace"), digest_size=8).digest(), signed=True))
            todo.append((c, step))
    return frozenset(out) if seen_text else frozenset()


def shape_of(paths: frozenset[int]) -> int:
    return int.from_bytes(blake2b(",".join(map(str, sorted(paths))).encode(), digest_size=8).digest(), signed=True)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def _with_references(pages: DataFrame, references: DataFrame) -> DataFrame:
    """Pages with ``refs``, the references of their host by shape."""
    total = references.agg(F.sum(F.length("reference") + F.length("host") + 64)).first()[0] or 0
    by_host = references.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(*[c for c in references.columns if c != "host"]))).alias("refs"))
    return pages.join(F.broadcast(by_host) if total <= BROADCAST_BYTES else by_host, "host", "left")


class References:
    """The parsed references of the hosts met last."""

    def __init__(self):
        self.known: dict[str, list[tuple[int, Node, frozenset[int], list[str], dict]]] = {}

    def best(self, host: str, refs: list[dict] | None, paths: frozenset[int]) -> tuple[int, Node, frozenset[int], list[str], dict] | None:
        """(shape, tree, paths, own texts, row) of the reference nearest to a page; None if the host has none."""
        if not refs or not paths:
            return None
        if host not in self.known:
            if len(self.known) > 500:
                self.known.clear()
            trees = [(r, measured(parse(r["reference"]))) for r in refs]
            self.known[host] = [(r["shape"], t, layout(t), [n.own_text() for n in nodes(t)], r) for r, t in trees]
        return max(self.known[host], key=lambda k: (len(paths & k[2]) / len(paths | k[2]), -k[0]))


def _references(hosted: DataFrame) -> DataFrame:
    """(host, shape, reference): a page of every frequent layout of each host."""

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [parse(h) for h in batch.column("html").to_pylist()]
            found = [layout(t) for t in trees]
            rows = batch.append_column("shape", pa.array([shape_of(f) if f else None for f in found], pa.int64())).drop_columns(["html"])
            yield rows.filter(pc.is_valid(rows.column("shape")))

    keyed = hosted.where("trim(html) <> ''").withColumn("row", F.xxhash64("html"))
    kind = dict(hosted.dtypes)["id"]
    first = F.min(F.struct("id", "row")).alias("first")
    counted = keyed.mapInArrow(shapes, f"host string, id {kind}, row long, shape long").groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), first)
    counted = stored(counted, "layouts")
    totals = counted.groupBy("host").agg(F.sum("n").alias("total"), F.max(F.struct(F.col("n"), F.col("shape"))).alias("top")).withColumnRenamed("host", "h")
    often = (F.col("n") >= LEAST_PAGES) & (100 * F.col("n") >= LAYOUT_PERCENT * F.col("total"))
    chosen = counted.join(totals, F.col("host") == F.col("h")).where(often | (F.col("shape") == F.col("top.shape")))
    wanted = chosen.select("host", "shape", F.col("first.id").alias("wid"), F.col("first.row").alias("row")).withColumnRenamed("host", "h")
    wanted = stored(wanted, "wanted")
    few = wanted.count() * 256 <= BROADCAST_BYTES
    alike = keyed.join(F.broadcast(wanted) if few else wanted, (F.col("host") == F.col("h")) & F.col("id").eqNullSafe(F.col("wid")) & (keyed["row"] == wanted["row"]))
    return stored(alike.groupBy("host", "shape").agg(F.first("html").alias("reference")), "references")


def wrappers(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(host, shape, reference, template): the reference pages of each host and the places of their template nodes."""
    hosted = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{page_id}`").alias("id"), F.col(f"`{html}`").cast("string").alias("html"))
    references = _references(hosted)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = References()
        for batch in batches:
            out: dict[str, list] = {"host": [], "shape": [], "content": [], "chars": [], "votes": []}
            for host, source, refs in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "refs")), strict=True):
                page = measured(parse(source))
                regions = _regions(page)
                nearest = known.best(host, refs, layout(page))
                if nearest is None:
                    continue
                strict = in_article(regions)
                shape, reference, _, theirs, _ = nearest
                pairs = align(page, reference)
                own = [(n.place, n.own_text()) for n in contents(regions)]
                texts = "\n".join(t for _, t in own if t)
                out["host"].append(host)
                out["shape"].append(shape)
                out["content"].append(blake2b(texts.encode(errors="replace"), digest_size=16).digest())
                out["chars"].append(sum(len(t) for _, t in own))
                placed = ((pairs.get(place), t) for place, t in own)
                out["votes"].append([(at, len(t) if t == theirs[at] else 0, strict) for at, t in placed if at is not None and theirs[at]])
            yield pa.RecordBatch.from_pydict(out, schema)

    vote_type = pa.list_(pa.struct([("place", pa.int32()), ("same", pa.int32()), ("strict", pa.bool_())]))
    schema = pa.schema([("host", pa.string()), ("shape", pa.int64()), ("content", pa.binary()), ("chars", pa.int64()), ("votes", vote_type)])
    paired = _with_references(hosted.where("html IS NOT NULL"), references).select("host", "html", "refs")
    cast = paired.mapInArrow(vote, "host string, shape long, content binary, chars long, votes array<struct<place: int, same: int, strict: boolean>>")
    once = stored(cast.groupBy("host", "shape", "content").agg(F.min(F.struct("chars", "votes")).alias("v")).select("host", "shape", "v.*"), "votes")
    each = once.select("host", "shape", F.explode("votes").alias("v")).select("host", "shape", "v.*")
    votes = each.groupBy("host", "shape", "place").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("same") > 0).alias("agreed"), F.sum("same").alias("same"), F.max("strict").alias("strict"))
    least, share = (F.when(F.col("strict"), strict).otherwise(plain) for strict, plain in ((ARTICLE_PAGES, LEAST_PAGES), (ARTICLE_PERCENT, AGREE_PERCENT)))
    fixed = votes.where((F.col("pages") >= least) & (100 * F.col("agreed") >= share * F.col("pages")))
    by_shape = fixed.groupBy("host", "shape").agg(F.to_json(F.sort_array(F.collect_list("place"))).alias("template"), F.sum("same").alias("same"))
    held = once.groupBy("host", "shape").agg(F.sum("chars").alias("chars"))
    some = by_shape.join(held, ["host", "shape"]).where(100 * F.col("same") <= TEMPLATE_PERCENT * F.col("chars"))
    return stored(references.join(some, ["host", "shape"], "left").select("host", "shape", "reference", "template"), "wrappers")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without the markup, with ``text`` and ``n_chars`` (code points)."""
    wrapped = wrappers(pages, page_id, url, html)
    carried = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    source = pages.select(*[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(carried)], host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").cast("string").alias("html"))
    fields = {f.name: f for f in pages.schema.fields}
    schema = StructType([*(fields[c] for c in carried), StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = References()
        for batch in batches:
            out = []
            for host, markup, refs in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "refs")), strict=True):
                page = measured(parse(markup or ""))
                nearest = known.best(host, refs, layout(page))
                same: set[int] = set()
                if nearest and (fixed := set(json.loads(nearest[4]["template"] or "[]"))):
                    pairs, theirs = align(page, nearest[1]), nearest[3]
                    same = {n.place for n in nodes(page) if (at := pairs.get(n.place, -1)) in fixed and theirs[at] == n.own_text()}
                out.append("\n".join(blocks(page, same)))
            columns = [batch.column(f"c_{i}") for i in range(len(carried))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [*carried, "text", "n_chars"])

    return _with_references(source, wrapped).mapInArrow(run, schema)
