"""Main-text extraction from HTML by composite text density.

Every block node of a page's tree has a composite density: characters per tag, scaled by how few of the characters and
tags belong to links (Sun, Song and Liao, 2011). A node's density sum adds those of its children; the node with the
largest sum holds the article. The smallest density on the path from the body to that node is the page's own threshold:
outside that node, a subtree counts as content only if it is at least as dense and not made of links. Subtrees whose
role is known (menus, forms, adverts, comments and the like, in an article too) are cut from the tree before anything is
counted, and inline formatting belongs to its block. Where the body path runs through an `article` or `main`, its author
has drawn the article's bounds: all nodes of the path are as dense as the threshold, and the outermost such node is taken
whole, so that short headings and lists of links in it stay.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML and of common page roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template svg annotation".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img nobr "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover semantics".split()
)
DROPPED_TAGS = frozenset("nav footer aside form button select menu dialog object canvas audio video map applet head datalist optgroup option marquee".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored promo promos promoted promotion sidebar aside menu submenu nav navbar navigation breadcrumb "
    "breadcrumbs footer foot masthead topbar comment comments commentlist commentary disqus replies reply respond responses thread threads talkback guestbook cmt cmts kommentar kommentare commentaire commentaires "
    "comentario comentarios commenti cookie cookies consent gdpr notice notices disclaimer newsletter subscribe signup popup modal overlay paywall share sharing social related recommended recommendations "
    "widget widgets login signin search pagination pager toolbar toolbox tags copyright skip hidden".split()
)
DROPPED_PAIRS = frozenset(
    {("site", "info"), ("user", "review"), ("customer", "review"), ("reader", "review"), ("user", "reviews"), ("customer", "reviews"), ("reader", "reviews"), ("user", "rating"), ("user", "ratings")}
    | {("see", "also"), ("read", "next"), ("post", "meta"), ("entry", "meta"), ("article", "meta"), ("author", "bio"), ("author", "box"), ("reader", "feedback"), ("user", "feedback"), ("user", "discussion"), ("reader", "discussion")}
)
# Words that say what kind of box a role has, and so may follow the word that names it.
BOXES = frozenset(
    "list lists box boxes section sections area wrap wrapper container holder block blocks panel panels bar bars button buttons link links item items icon icons slot slots unit units zone top bottom left right inner outer "
    "module modules feed title heading header count media posts post articles article stories story content news topics videos products form field text body row col column group toggle cloud main".split()
)
LITTLE = frozenset("of on in for to from by and or the a an at as about with".split())  # a name with one inside is a phrase, not a role
RUN_TOGETHER = ("comments", "commentlist", "sidebar", "navbar", "newsletter", "advertisement")  # ends of names without breaks
NEGATIONS = frozenset("has with no without not".split())  # has-sidebar tells what a box holds, not what it is
LAYOUT = frozenset("wrap wrapper container layout grid".split())
CONTENT_WORDS = frozenset("content article post entry body story text".split())
ARTICLE_HEADERS = frozenset("article content entry post story section".split())  # whose header is the article's title
OTHER_ARTICLES = frozenset("comment reply ad ads advert sponsored promo promoted related recommended teaser".split())  # role of an <article> that is none
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("table td th body html article section div ul ol dl main button".split())

_TAG = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*?)(>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_NAME = re.compile(r"[-_:.\s]+|(?<=[a-z])(?=[A-Z\d])")  # words of a class or id
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    __slots__ = ("tag", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _role(name: str, tag: str, in_article: bool) -> bool:
    """Whether one class or id says that its element is no content.

    The word that names the box decides: article-comments and comment-list are comments, search-engines and notice-period
    are about engines and a period. A name that is a phrase (story-of-the-ads) is none; of headers an article's own is excused.
    """
    words = [w for w in _NAME.split(name) if w]
    words = [w.lower() for w in words]
    if not words or words[0] in NEGATIONS:
        return False
    if tag in ("article", "main"):
        return not OTHER_ARTICLES.isdisjoint(words)
    if words[-1] in LAYOUT and words[0] in CONTENT_WORDS:
        return False  # a box around the content and what is beside it
    if not LITTLE.isdisjoint(words[1:-1]):
        return False
    if not DROPPED_PAIRS.isdisjoint(zip(words, words[1:])):
        return True
    head = len(words)  # the word that names the box: the last that does not only say what kind of box it is
    while head > 1 and (words[head - 1] in BOXES or words[head - 1].isdigit()):
        head -= 1
    if words[head - 1] in DROPPED_WORDS or words[head - 1].endswith(RUN_TOGETHER):
        return True
    return "header" in words and not (in_article and (len(words) == 1 or not ARTICLE_HEADERS.isdisjoint(words)))


def _dropped(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in DROPPED_TAGS or tag == "header" and not in_article:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    at = {k.lower(): html_lib.unescape(a or b or c) for k, a, b, c in _ATTR.findall(attrs)}
    if "hidden" in at or at.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(at.get("style", "").lower()):
        return True
    if at.get("role", "").strip().lower() in DROPPED_ROLES:
        return True
    return any(_role(name, tag, in_article) for name in [*at.get("class", "").split(), at.get("id", "").strip()])


def parse(page: str) -> Node:
    """The block tree of a page without the dropped subtrees; parts are child nodes, and (text, in a link) pairs."""
    root = node = Node("#root", None)
    stack: list[tuple[str, Node | None]] = [("#root", root)]  # open elements; inline and dropped ones have no node
    dropped = links = articles = at = 0  # dropped: depth in the stack from which nothing counts

    def text(upto: int) -> None:
        if upto > at and not dropped:
            node.parts.append((html_lib.unescape(page[at:upto]), links > 0))

    def pop() -> None:
        nonlocal node, dropped, links, articles
        tag, own = stack.pop()
        if dropped and len(stack) <= dropped:
            dropped = 0
        links -= tag == "a"
        articles -= tag in ("article", "main")
        if own is not None:
            node = own.parent

    def close(names: tuple[str, ...], fence: frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in fence:
                return

    pos = 0
    while True:
        m = _TAG.search(page, pos)
        if not m:
            text(len(page))
            break
        text(m.start())
        at = pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag in ("body", "html"):
                continue
            close((tag,), frozenset(("td", "th", "table")) if tag in INLINE or tag in ("p", "li") else frozenset())
            if tag not in INLINE and not dropped:
                node.parts.append((" ", False))
            continue
        if not m[4]:
            break  # the page ends within a tag
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, pos)
            at = pos = end.end() if end else len(page)
            continue
        if tag == "br" or tag == "hr":
            if not dropped:
                node.parts.append((" ", False))
            if tag == "br":
                continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            close(("p",), SCOPES)
        if tag in IMPLIED:
            close(IMPLIED[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        if tag == "body" or tag == "html":
            if len(stack) > 1 and any(t == tag for t, _ in stack):
                continue
        if tag == "head" or tag == "body":
            close(("head",), frozenset())
        if tag == "a":
            links += 1
        articles += tag in ("article", "main")
        own = None
        if not dropped and _dropped(tag, m[3], articles > 0):
            dropped = len(stack)
            stack.append((tag, None))
            continue
        if not dropped and tag not in INLINE:
            own = Node(tag, node)
            node.parts.append(own)
            node = own
        elif not dropped and tag == "a":
            node.link_tags += 1
            node.tags += 1
        stack.append((tag, own))
    return root


def _measure(node: Node) -> list[Node]:
    """Fill the counts bottom-up; returns all nodes in document order."""
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(p for p in reversed(x.parts) if isinstance(p, Node))
    for x in reversed(order):
        x.tags += 1
        for p in x.parts:
            if isinstance(p, Node):
                x.chars, x.tags, x.link_chars, x.link_tags = x.chars + p.chars, x.tags + p.tags, x.link_chars + p.link_chars, x.link_tags + p.link_tags
            else:
                n = len("".join(p[0].split()))
                x.chars += n
                x.link_chars += n * p[1]
    return order


def _density(x: Node, body_links: float) -> float:
    """Composite density; 0 where all characters are in links."""
    if not x.chars or x.link_chars >= x.chars:
        return 0.0
    base = math.log(x.chars / (x.chars - x.link_chars) * x.link_chars + body_links * x.chars + math.e)
    ratio = x.chars / max(x.link_chars, 1) * x.tags / max(x.link_tags, 1)
    return max(0.0, x.chars / x.tags * math.log(max(ratio, 1.0)) / math.log(base)) if base > 1 else x.chars / x.tags


def _text_density(chars: int, body_links: float) -> float:
    """Composite density of a node's own text, as if it stood in an element by itself."""
    leaf = Node("#text", None)
    leaf.chars, leaf.tags = chars, 1
    return _density(leaf, body_links)


def extract(page: str | None) -> str:
    """The main text of one page; empty for a null, empty or text-less page."""
    if not page:
        return ""
    order = _measure(parse(page))
    body = next((x for x in order if x.tag == "body"), order[0])
    if body.chars == 0:
        body = order[0]
    share = body.link_chars / max(body.chars, 1)
    for x in order:
        x.density = _density(x, share)
    for x in reversed(order):
        own = sum(len("".join(p[0].split())) for p in x.parts if not isinstance(p, Node) and not p[1])
        x.total = sum(p.density for p in x.parts if isinstance(p, Node)) + _text_density(own, share)
    best = max(order, key=lambda x: x.total)  # the first of equals in page order
    if not best.total:
        return ""
    while (inner := next((p for p in best.parts if isinstance(p, Node) and p.total == best.total), None)) is not None:
        best = inner  # as much in a smaller box
    path, up = [], best
    while up is not None:
        path.append(up)
        up = None if up is body else up.parent
    threshold = min(x.density for x in path)
    for x in path:
        if x.tag == "article" or x.tag == "main" and best.tag not in ("article", "main"):
            best = x
    out: list[str] = []
    inside = {id(x) for x in path}

    def walk(x: Node, taken: bool) -> None:
        """taken: x lies in the article, or is as dense as the threshold asks."""
        todo: list[tuple[Node | tuple[str, bool], bool]] = [(p, taken) for p in reversed(x.parts)]
        while todo:
            p, t = todo.pop()
            if not isinstance(p, Node):
                if t:
                    out.append(p[0])
                continue
            linked = p.link_chars * 2 > p.chars and p.link_tags > 1  # a block of links; inside the article it is content
            now = t or p is best or id(p) not in inside and p.density >= threshold and p.chars > 0 and not linked
            out.append(" ")
            todo.append(((" ", False), now))
            todo.extend((q, now) for q in reversed(p.parts))

    walk(body, body is best)
    return " ".join("".join(out).split())


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.num_columns - 1
        texts = [extract(h.as_py()) for h in batch.column(k)]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(texts, pa.string())], names=[*batch.schema.names[:k], "text"])


def main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """keep + text: the main text of each row's whole html, one row per row, no shuffle.

    A null or empty html, and a page without text, give the empty string. Broken markup never fails: what is left open is
    closed, a tag cut off by the end of the page is dropped. Repeated rows stay; columns not named are not read.
    """
    schema = ", ".join([f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep] + ["text string"])
    return pages.select(*[F.col(k) for k in keep], F.col(html).cast("string").alias("__html")).mapInArrow(_run, schema)
