"""Main text of web pages by composite text density.

The tag soup is read in one pass into a tree of block elements. Chrome that a page declares itself (navigation, footers, scripts)
is cut off. What is left is judged by density: the characters of a node over its tags, adjusted by the share of its
characters and tags that are links. The node whose children's densities have the largest sum is the core; the least density on the
path from it to the body is the threshold, and every subtree as dense as that contributes its own node of largest sum. Headings
beside the path, before the core, belong to it. Nothing inside a chosen subtree is dropped but chrome.

Forms, and classes and ids that name nothing but chrome (adverts, reader comments), mark candidates, which density judges: it counts
for less there (``DISCOUNT``) when the core is looked for, but what holds the core is no chrome, whatever its name, and names that
articles use too (``DOUBTFUL``) count within the core only for what is less dense than the threshold. A page that has text in candidates
alone keeps it.

Reading is linear in a page's tags, however they nest.

Defined results: null, empty or markup-free input gives what text there is; an unfinished tag or reference at the end of a page
is dropped or kept as text, as browsers do; rows are judged each, repeated or not; other columns pass through, except that
``text`` is replaced.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A quote opens a value only behind "="; elsewhere in a tag it is a character like others.
VALUE = r"=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|{VALUE})*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
#: Fixed values of HTML: elements without content, of raw text, that start a block, and that a paragraph ends before.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp svg math object select".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}}
#: What a list item or cell may not close: the element that holds its kind.
HOLDS = frozenset("ul ol dl menu table body select".split())
MARKS = HOLDS.union(*CLOSES.values())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Chrome by element, by role, and by words of a class or id.
CHROME = frozenset("nav footer aside button dialog menu search head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs comment comments disqus footer login masthead menu nav navbar navigation newsletter pager pagination related recommended replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
DOUBTFUL = frozenset("aside banner consent cookie cookies gdpr modal notice overlay popup promo promotion skip".split())
#: How much of its density counts for what stands in elements named as chrome, when the core is looked for.
DISCOUNT = 1 / 16
#: What a name may hold besides and still name nothing but chrome.
GLUE = frozenset("area article bar block bottom box button buttons column container content entry footer form global group header inline inner item items left link links list main module page panel placement post posts primary right secondary section site slot story thread top unit wrap wrapper".split())
NAMED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s\"'>]+)))?", re.I)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("article", "chars", "chrome", "density", "kids", "link_chars", "link_tags", "mark", "named", "order", "own", "sum", "tag", "tags", "texts", "up")

    def __init__(self, tag: str, up: Node | None, chrome: bool, order: int):
        self.tag, self.up, self.chrome, self.order = tag, up, chrome, order
        self.article = tag in ("article", "main") or up is not None and up.article  # is this within one?
        self.mark = self if up is None or tag in MARKS else up.mark  # the nearest element that matters for what a tag closes
        self.kids, self.texts = [], []
        self.named, self.own = 0, None
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.sum = 0.0


def is_chrome(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in CHROME or tag == "header" and not in_article:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for m in NAMED.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
            return True
    return False


def named(tag: str, attributes: str) -> int:
    """Does a class or id name this as chrome (2), or as what may be chrome (1)? A form is of the first kind: some hold a whole page."""
    if tag == "form":
        return 2
    if "=" not in attributes or tag in ("body", "html"):
        return 0
    found = 0
    for m in NAMED.finditer(attributes):
        if m[1].lower() in ("class", "id"):
            for name in (m[2] or m[3] or m[4] or "").split():
                words = {w.lower() for w in SPLIT.split(name) if w and not w.isdigit()}
                if words <= WORDS | DOUBTFUL | GLUE:
                    found = max(found, 2 if words & WORDS else 1 if words & DOUBTFUL else 0)
    return found


def parse(html: str) -> Node:
    """The tree of block elements below a root; texts are kept as (order, text, is_link) at the nearest block."""
    root = Node("body", None, False, 0)
    node, at, order, links = root, 0, 0, 0
    n = len(html)
    match = TOKEN.search
    opened: dict[str, list[Node]] = {}

    def text(a: int, b: int) -> None:
        nonlocal order
        if b > a and not node.chrome:
            s = html[a:b]
            if "&" in s:
                s = unescape(s)
            node.texts.append((order, s))
            size = len(s) - s.count(" ") - s.count("\n")
            node.chars += size
            if links:
                node.link_chars += size
        order += 1

    def leave(up: Node) -> None:
        """Closes all elements below ``up``; each is closed once."""
        nonlocal node
        while node is not up:
            opened[node.tag].pop()
            node = node.up

    while at < n:
        m = match(html, at)
        if m is None:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        tag = m[2]
        if tag is None or not m[4]:  # a comment or declaration; a tag that the page's end cuts off
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK and tag not in ("body", "html"):
                if opened.get(tag):
                    leave(opened[tag][-1].up)
                    links = 0
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            at = n if end is None else html.find(">", end.start()) + 1 or n
            continue
        if tag == "br" or tag == "hr":
            node.texts.append((order, " "))
            order += 1
        if tag == "a":
            links += 1
            node.tags += 1
            node.link_tags += 1
        if tag in VOID or tag not in BLOCK or tag in ("html", "body"):
            continue
        if tag in CLOSES:
            up = node.mark
            while up is not root and up.tag not in HOLDS and up.tag not in CLOSES[tag]:
                up = up.up.mark
            while up.tag in CLOSES[tag]:
                leave(up.up)
                up = node
        elif node.tag == "p" or tag == "p" and node.tag in HEADINGS:
            leave(node.up)
        order += 1
        links = 0
        kid = Node(tag, node, node.chrome or is_chrome(tag, m[3], node.article), order)
        kid.named = 0 if kid.chrome else named(tag, m[3])
        node.kids.append(kid)
        opened.setdefault(tag, []).append(kid)
        node = kid
    judge_names(root)
    return root


def judge_names(root: Node) -> None:
    """Named elements become chrome with all below them, but for what holds the core and for dense ones of doubtful name in it; all stay
    where nothing else has any text."""
    nodes = _every(root)
    if not any(x.named for x in nodes):
        return
    measure(root)
    core = _core(root, DISCOUNT)
    path = _path(core)
    threshold = min(x.density for x in path)
    keep, within = {id(x) for x in path}, set()
    for x in nodes:
        if x is core or id(x.up) in within:
            within.add(id(x))
    before = [x.chrome for x in nodes]
    for x in nodes[1:]:
        out = x.named == 2 or x.named and not (id(x) in within and x.density >= threshold)
        x.chrome = x.chrome or x.up.chrome or bool(out) and id(x) not in keep
    if not any(x.own[0] for x in nodes if not x.chrome):
        for x, chrome in zip(nodes, before, strict=True):
            x.chrome = chrome


def _every(root: Node):
    """All nodes, parents first."""
    out = [root]
    for node in out:
        out += node.kids
    return out


def measure(root: Node) -> list[Node]:
    nodes = _every(root)
    for node in nodes:
        if node.own is None:
            node.own = node.chars, node.link_chars, node.tags, node.link_tags
        node.chars, node.link_chars, node.tags, node.link_tags = node.own
        node.density = 0.0
    for node in reversed(nodes):
        if node.up is not None and not node.chrome:
            up = node.up
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags
    share = root.link_chars / max(1, root.chars)
    for node in nodes:
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if c and not node.chrome:  # 1 is added to the base of the logarithm, which is 1 itself on pages without links
            base = 1 + math.log(c / max(1, c - lc) * lc + share * c + math.e)
            node.density = c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / math.log(base)
    for node in nodes:
        node.sum = sum(k.density for k in node.kids)
    return nodes


def _core(node: Node, discount: float = 1.0) -> Node:
    """The node of largest sum in a subtree; the first of equals, and the subtree itself if it has no block inside. The density of what stands in
    elements named as chrome counts for so much less."""
    nodes, within = _every(node), {}
    for x in nodes:
        within[id(x)] = x.named == 2 or x is not node and within[id(x.up)]
    worth = lambda x: x.sum if discount == 1 else sum(k.density * discount if within[id(k)] else k.density for k in x.kids)
    return max((x for x in nodes if x is node or not x.chrome), key=worth)


def _path(node: Node) -> list[Node]:
    """From a node to the body."""
    path = [node]
    while path[-1].up is not None:
        path.append(path[-1].up)
    return path


def chosen(root: Node) -> list[Node]:
    """Subtrees whose text is the page's."""
    measure(root)
    core = _core(root)
    path = _path(core)
    threshold, on_path = min(x.density for x in path), {id(x) for x in path}
    out = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.chrome:
            continue
        if node is core or node.tag in HEADINGS and id(node.up) in on_path and node.order < core.order:
            out.append(node)
        elif id(node) not in on_path and node.density >= threshold > 0:
            out.append(_core(node))
        else:
            stack += node.kids
    return out


def blocks(node: Node, out: list[tuple[int, str]]) -> None:
    """(order, text) of each block of a subtree; a block's text is cut where another block stands in it."""
    stack = [node]
    while stack:
        x = stack.pop()
        if x.chrome:
            continue
        cuts = sorted(k.order for k in x.kids)
        run: list[str] = []
        start, i = 0, 0
        for order, s in x.texts:
            while i < len(cuts) and cuts[i] <= order:
                if run:
                    out.append((start, "".join(run)))
                    run = []
                i += 1
            if not run:
                start = order
            run.append(s)
        if run:
            out.append((start, "".join(run)))
        stack += x.kids


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, white space within a block as one space, joined by two newlines."""
    if not html:
        return ""
    found: list[tuple[int, str]] = []
    for node in chosen(parse(html)):
        blocks(node, found)
    return "\n\n".join(t for t in (" ".join(s.split()) for _, s in sorted(found, key=lambda x: x[0])) if t)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text``, page by page: nothing is shuffled."""
    keep = [c for c in pages.columns if c != "text"]
    out = T.StructType([*[pages.schema[c] for c in keep], T.StructField("text", T.StringType())])

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array([main_text(x) for x in b[html_col].to_pylist()], pa.string())], [*keep, "text"])

    return pages.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, out)
