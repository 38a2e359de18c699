"""Main text of web pages by composite text density.

For each node of the page's tree: C characters, T tags, LC characters in links and
LT link tags give the link-adjusted characters per tag

    D = C / T * log(C * T / (LC * LT)) / log(ln(C * LC / (C - LC) + C * LCb / Cb + e))

(zero counts as 1 below a fraction, b is the body). The sum of its children's D
is a node's density sum. The subtree with the largest sum is the core; the smallest
D on its path to the body is the threshold that siblings on this path must reach to
belong to the text too (Sun, Song, Liao: DOM based content extraction via text
density, SIGIR 2011). This runs over the whole body of every page. An article or main
part is the core only if the densest subtree lies in it and it is as dense as the body.

What a page marks as something else (navigation, adverts, forms, comments, ...)
is left out before any density is computed. A name (``class="related-work"``) or a form
alone doesn't decide: the part stays if it has most of the page's text beside links.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
#: Elements that are never part of an article's text.
NOISE = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe object embed svg canvas math menu dialog audio video map".split())
#: Elements within which text runs on; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small source span strike strong sub sup time track tt u var wbr".split())
#: Roles and names that mark noise in role, class or id.
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
NOISE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promotion|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|aside|footer|masthead|site-header|page-header|topbar|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|comments?|commentlist|disqus|replies|reply|respond|pagination|pager|toolbar|widget|skip-link)(?:$|[\s_-]|\d)",
    re.I,
)
#: Names of readers' comments, which are never the page's text, however long.
COMMENT_NAME = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus)(?:$|[\s_-]|\d)", re.I)
#: A part that only its name or tag marks stays if it has so many times the text beside links of all that isn't marked.
MOST = 4
#: An open element of the key is closed by a start tag of the value.
BLOCK_START = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
#: A quoted value with "<" in it must end where an attribute can end; else the quote was never closed, and the tag ends at the next ">".
TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"<]*"|'[^'<]*'|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>]))*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


#: Tag of text beside blocks.
RUN = "#text"
#: Share of the threshold for siblings. The paper's pages hold their navigation, which lowers the threshold; here it is gone.
SIBLING = 0.5
#: Share of the core's density sum that another article or section beside one needs, if it is less dense.
PART = 0.15


class Node:
    __slots__ = ("tag", "parent", "children", "noise", "soft", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: "Node | None", noise: bool = False, soft: bool = False):
        self.tag, self.parent, self.noise, self.soft = tag, parent, noise, soft  # soft: noise by a name or as a form only
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _marked(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool]:
    """Whether an element is noise, and whether that rests on its name only (or its being a form)."""
    if tag in NOISE and tag != "form" or tag == "header" and not inside_article:
        return True, False
    soft = tag == "form"
    if not attributes or tag in ("html", "body", "main", "article"):
        return soft, soft
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and value.strip().lower() in NOISE_ROLES or name == "aria-hidden" and value == "true":
            return True, False
        if name in ("class", "id"):
            if COMMENT_NAME.search(value):
                return True, False
            soft = soft or bool(NOISE_NAME.search(value))
    if re.search(r"(?:^|\s)hidden(?:\s|/|$)", ATTRIBUTE.sub(" ", attributes), re.I):
        return True, False
    return soft, soft


class _Open:
    """The open elements of a page that is parsed: the innermost one, and how many there are of each tag."""

    def __init__(self, root: Node):
        self.root = self.node = root
        self.count: Counter = Counter()

    def enter(self, node: Node) -> None:
        self.node = node
        self.count[node.tag] += 1

    def back_to(self, node: Node) -> None:
        while self.node is not node:
            self.count[self.node.tag] -= 1
            self.node = self.node.parent

    def any(self, tags) -> bool:
        return any(self.count[t] for t in tags)


def parse(page: str) -> Node:
    """The page's tree, leniently: unclosed and stray tags do no harm."""
    root = Node("html", None)
    open_, at, end, main_seen, some_soft = _Open(root), 0, len(page), False, False
    while at < end:
        m = TOKEN.search(page, at)
        start = m.start() if m else end
        if start > at:
            open_.node.children.append(html.unescape(page[at:start]) if "&" in page[at:start] else page[at:start])
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if not open_.count[tag]:
                continue
            for x in _path(open_.node):
                if x.tag == tag:
                    if x is not root:
                        open_.back_to(x.parent)
                    break
                if x.tag in ("table", "article", "body") and tag in INLINE | {"p", "li"}:
                    break
            continue
        if tag == "html" or tag == "body" and open_.count["body"]:
            continue
        if tag in BLOCK_START:  # ends an open paragraph, with what is open in it
            if open_.count["p"]:
                for x in _path(open_.node):
                    if x.tag == "p":
                        open_.back_to(x.parent)
                        break
                    if x.tag not in INLINE:
                        break
            if tag in HEADINGS and open_.node.tag in HEADINGS:
                open_.back_to(open_.node.parent)
        elif tag in CLOSES:
            ends, stop = CLOSES[tag]
            if open_.any(ends):
                for x in _path(open_.node):
                    if x.tag in stop:
                        break
                    if x.tag in ends:
                        open_.back_to(x.parent)
                        if tag not in ("tr", "tbody", "tfoot"):
                            break
        elif tag == "body":
            open_.back_to(root)
        noise, soft = _marked(tag, attributes, tag == "header" and open_.any(("article", "main")))
        node = open_.node
        new = Node(tag, node, noise, soft)
        some_soft = some_soft or soft
        if tag in ("article", "main") and not new.noise and not main_seen:
            main_seen = True  # a wrapper such as class="has-sidebar", or a form around the page, is no noise if the main part lies in it
            for x in _path(node):
                if x.noise and (x.tag not in NOISE or x.tag == "form"):
                    x.noise = x.soft = False
        node.children.append(new)
        if tag in VOID or attributes.endswith("/") and tag not in INLINE and tag not in BLOCK_START:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            if tag not in NOISE and tag != "title":
                new.children.append(html.unescape(page[at : close.start() if close else end]))
            at = close.end() if close else end
            continue
        open_.enter(new)
    if some_soft:
        _settle(root)
    return root


def _settle(root: Node) -> None:
    """Parts that only their name marks (or their being a form) stay if they have most of the text.

    The one with most text beside links is looked at first, those inside a part once it stays.
    """
    order, todo = [], [(root, False)]
    full: dict[int, int] = {}  # text beside links, without what is noise for sure
    plain: dict[int, int] = {}  # the same outside of marked parts below
    while todo:
        node, link = todo.pop()
        link = link or node.tag == "a"
        order.append(node)
        full[id(node)] = plain[id(node)] = 0 if link else sum(len(x) - x.count(" ") - x.count("\n") for x in node.children if isinstance(x, str))
        todo.extend((x, link) for x in node.children if not isinstance(x, str) and (not x.noise or x.soft))
    inside: dict[int, list[Node]] = {id(root): []}  # of each marked part (and the root) the marked ones next below
    holder: dict[int, Node] = {id(root): root}
    for node in order[1:]:
        up = holder[id(node.parent)]
        if node.soft:
            inside[id(up)].append(node)
            inside[id(node)] = []
        holder[id(node)] = node if node.soft else up
    for node in reversed(order[1:]):
        full[id(node.parent)] += full[id(node)]
        if not node.soft:
            plain[id(node.parent)] += plain[id(node)]
    rest = plain[id(root)]
    heap = [(-full[id(x)], i, x) for i, x in enumerate(inside[id(root)])]
    heapq.heapify(heap)
    while heap:
        size, _, node = heapq.heappop(heap)
        if size and -size >= MOST * rest:
            node.noise = False
            rest += plain[id(node)]
            for x in inside[id(node)]:
                heapq.heappush(heap, (-full[id(x)], len(order) + len(heap), x))


def _path(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def _measure(root: Node) -> list[Node]:
    """Counts for all nodes that aren't noise, children before parents."""
    order, todo = [], [(root, False)]
    while todo:
        node, link = todo.pop()
        order.append(node)
        link = link or node.tag == "a"
        for x in node.children:
            if isinstance(x, str):
                n = len(" ".join(x.split()))
                node.chars += n
                node.link_chars += n if link else 0
            elif not x.noise:
                todo.append((x, link))
    order.reverse()
    for node in order:
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + (node.tag == "a")
    return order


def _density(node: Node, body: Node) -> float:
    c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
    if not c:
        return 0.0
    base = math.log(c * lc / max(1, c - node.link_chars) + body.link_chars / max(1, body.chars) * c + math.e)
    return c / t * math.log(max(1.0, c * t / (lc * lt))) / math.log(max(base, 1.0 + 1e-9)) if base > 1.0 else 0.0


def _runs(root: Node) -> None:
    """Text beside blocks becomes a child of its own, so that it has a density too."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(x for x in node.children if not isinstance(x, str) and not x.noise)
    holds: set[int] = set()  # nodes with a block in them
    for node in reversed(order):
        if node.parent is not None and (node.tag not in INLINE or id(node) in holds):
            holds.add(id(node.parent))
    for node in order:
        if id(node) not in holds:
            continue
        out: list[Node | str] = []
        for x in node.children:
            if isinstance(x, str) or x.tag in INLINE and not x.noise and id(x) not in holds:
                if not out or isinstance(out[-1], str) or out[-1].tag != RUN:
                    out.append(Node(RUN, node))
                out[-1].children.append(x)
                if not isinstance(x, str):
                    x.parent = out[-1]
            else:
                out.append(x)
        node.children = out


def core(root: Node) -> list[Node]:
    """The subtrees, in page order, that hold the page's main text."""
    _runs(root)
    order = _measure(root)
    body = next((x for x in reversed(order) if x.tag == "body"), root)
    for node in order:
        node.density = _density(node, body)
    for node in order:
        ways = [x for x in node.children if not isinstance(x, str) and not x.noise and x.tag not in INLINE]
        # Inline elements are part of their block's text, not blocks that add to it.
        node.total = sum(x.density for x in ways) + sum(x.total for x in node.children if not isinstance(x, str) and not x.noise and x.tag in INLINE) if ways or node.tag in INLINE else node.density
    inside, todo = [], [body]
    while todo:
        node = todo.pop()
        inside.append(node)
        todo.extend(x for x in reversed(node.children) if not isinstance(x, str) and not x.noise)
    best = max(inside, key=lambda x: (x.total, x.tag in ("article", "main"), x.chars))
    path = list(_path(best))
    path = path[: next(i for i, x in enumerate(path) if x is body) + 1]
    threshold = min((x.density for x in path if x.chars), default=0.0)
    # The article around the densest part, with its heading, if it is as dense as the page; a main part only if it holds no other articles.
    articles = {}
    for x in order:
        articles[id(x)] = (x.tag == "article" and x.chars > 0) + sum(articles[id(y)] for y in x.children if not isinstance(y, str) and not y.noise)
    own = articles[id(best)]
    named = next((x for x in path if x.density >= body.density and (x.tag == "article" or x.tag == "main" and articles[id(x)] == own)), None)
    most, best = best.total, named or best
    if best is body:
        return [body]
    sums = {}  # largest density sum in each subtree
    for x in order:
        sums[id(x)] = max([x.total, *(sums[id(y)] for y in x.children if not isinstance(y, str) and not y.noise)])
    parts = {(id(x.parent), x.tag) for x in path if x is not body and x.tag in ("article", "section")}
    belongs = lambda x: x.density >= threshold * SIBLING or (id(x.parent), x.tag) in parts and sums[id(x)] >= most * PART
    out, keep, todo = [], {id(x) for x in path}, [body]
    while todo:
        node = todo.pop()
        if node is best or id(node) not in keep:
            out.append(node)
            continue
        ways = [x for x in node.children if not isinstance(x, str) and not x.noise]
        todo.extend(x for x in reversed(ways) if id(x) in keep or x.chars > x.link_chars * 2 and belongs(x))
    return out


def blocks(node: Node) -> list[str]:
    """Texts of the blocks under ``node``, white space made single."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    todo: list[Node | str | None] = [node]  # None ends a block
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif not x.noise:
            if x.tag == "br":
                run.append(" ")
            elif x.tag not in INLINE:
                flush()
                todo.append(None)
            todo.extend(reversed(x.children))
    flush()
    return out


def main_text(page: str) -> str:
    """The main text of one page; empty for a page without any."""
    return "\n".join(b for x in core(parse(page)) for b in blocks(x)) if page.strip() else ""


def extract_main_text(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` (empty if the page has none) and ``n_chars`` (its code points).

    One row for each row of ``pages``, repeated and null ones too; a null page is
    empty; an empty table gives no rows. Of equally dense parts the first counts. Pages of
    any length are read whole, in time linear in their nodes. Pages are independent: no
    exchange. Other columns are not read, whatever their names.
    """
    fields = [pages.schema[k] for k in keep]
    schema = T.StructType([*fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            found = [main_text(x.decode("utf-8", "replace")) for x in texts(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, pages[html_column].alias("_html")).mapInArrow(run, schema)
