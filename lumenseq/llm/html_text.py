"""Main text of web pages by composite text density.

A page is read into a DOM. Elements that are never an article (menus, forms, adverts, ...) are
marked by tag, role and class. For every other node the composite text density is its characters
per tag, scaled down by the share of link characters and link tags. A node's density sum is the
sum over its children. The node with the largest sum leads to the article: it is that subtree, or the article or
main element that the subtree lies in. The least density on the
path from it to body is the threshold, and nodes beside that path which reach it in density and a
fair share of the sum belong to the article too, as do headings before it. Inside an article, a word of class or id
that may mean something else there ("related", "discussion") marks a part only if most of its text is links.
Reader comments without such names are known by their form: two or more like siblings, each with a short reply link or
button and a mark of author or time, each a small share of the page; the comment heading before them goes too. A block whose
whole text is an advert's label ("Advertisement") is none of the article.
The text of the chosen subtrees, block by block, is the result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

# HTML element names by role, and words of class, id and role that mark parts
# beside the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp template svg object select".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption html legend li summary tbody td tfoot th thead tr dd dt".split()) | {"li", "dd", "dt", "table"}
SAME_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article aside blockquote body div dl footer form header html main nav ol section table td th ul".split())
ASIDE_TAGS = frozenset("nav aside footer form button dialog menu head input".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adbox adslot adsbygoogle adsense dfp taboola outbrain advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "sidebar cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login comment comments commentlist commenter commenters respond disqus "
    "pagination pager toolbar widget widgets".split()
)
# Words that mark a part outside an article; inside one only with many links.
OUTER_WORDS = frozenset("banner aside rail footer foot masthead notice notices alert overlay reply replies discussion related recommended share sharing social copyright".split())
# Words that may stand beside these in one name; "related-work" is none.
LAYOUT_WORDS = frozenset("area author avatar badge bar block body bottom box button buttons by card close container content count counter date entry field float form google group heading holder icon icons id inline inner input item items js label left link links list main message meta module name native number outer panel policy post posts reader readers right row section single site slot stories submit text thread threads time title top total unit user users view visitor visitors wrap wrapper".split())
# Texts of links and buttons that answer a comment, and of headings above comments; labels of adverts.
REPLY_TEXTS = frozenset(["reply", "respond", "quote", "report", "like", "upvote", "répondre", "signaler", "citer", "antworten", "melden", "zitieren", "responder", "contestar", "denunciar", "citar"])
COMMENT_HEADS = frozenset("comment comments replies responses discussion kommentar kommentare antworten diskussion commentaire commentaires réactions réponses comentario comentarios respuestas".split())
ADVERT_TEXTS = frozenset(["ad", "ads", "advert", "advertisement", "advertising", "advertorial", "sponsored", "sponsored content", "paid content", "promoted", "anzeige", "werbung", "publicité", "annonce", "publicidad", "anuncio", "patrocinado"])
SIGN_WORDS = frozenset("author avatar user username commenter poster byline date time timestamp posted when ago meta".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Characters of a text, white space included, that may be a label, a link or a heading.
SHORT = 80
#: A comment holds at most this share of the page's characters.
UNIT_SHARE = 0.5
HEADER_WORDS = frozenset(["header", "topbar"])

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|</?[a-zA-Z][^>]*\Z", re.S)
HINTS = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "parts", "off", "in_link", "chars", "link_chars", "tags", "link_tags", "density", "total", "doubtful", "signed")

    def __init__(self, tag: str, parent: Node | None, off: bool = False, in_link: bool = False):
        self.tag, self.parent, self.off, self.in_link = tag, parent, off, in_link
        self.parts: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.doubtful = self.signed = False


def named(value: str, words: frozenset[str]) -> bool:
    """Whether a name in a class or id attribute is made of these words, layout words and numbers."""
    for name in value.split():
        parts = {w.lower() for w in WORDS.findall(name)}
        if parts & words and all(w in words or w in LAYOUT_WORDS or w in OUTER_WORDS or w.isdigit() for w in parts):
            return True
    return False


def signed(attributes: str) -> bool:
    """Whether class, id or a property names an author or a time."""
    return any(not SIGN_WORDS.isdisjoint(w.lower() for w in WORDS.findall("".join(values))) for name, *values in HINTS.findall(attributes) if name.lower() in ("class", "id"))


def aside(tag: str, attributes: str, inside: bool) -> int:
    """2 if an element is beside the article, 1 if it is when most of its text is links; inside: it is within article or main."""
    if tag in ASIDE_TAGS or (tag == "header" and not inside):
        return 2
    if not attributes or tag in ("html", "body"):
        return 0
    found = 0
    for name, *values in HINTS.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
            return 2
        if name == "role" and value.lower() in ASIDE_ROLES:
            return 2
        if name in ("class", "id") and tag not in ("article", "main"):
            if named(value, ASIDE_WORDS) or (not inside and named(value, OUTER_WORDS | ASIDE_WORDS | HEADER_WORDS)):
                return 2
            found |= named(value, OUTER_WORDS)
    return found


def parse(html: str) -> Node:
    """The page's DOM; tolerant of missing end tags and of a cut-off end."""
    root = Node("html", None)
    stack, at = [root], 0
    opened: Counter[str] = Counter()  # how many elements of a tag are open

    def close(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    def text(upto: int) -> None:
        if upto > at:
            stack[-1].parts.append(unescape(html[at:upto]))

    while m := TAG.search(html, at):
        text(m.start())
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in ("html", "body") and opened[tag]:
            continue
        if tag == "body":
            close(1)  # head ends here
        closes = SAME_CLOSES.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in closes) else ():
            if stack[k].tag in closes:
                close(k)
                break
            if stack[k].tag in SCOPES:
                break
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        top = stack[-1]
        if tag in VOID:
            top.parts.append(Node(tag, top))
            continue
        mark = aside(tag, attributes, opened["article"] + opened["main"] > 0)
        node = Node(tag, top, top.off or mark == 2, top.in_link or tag == "a")
        node.doubtful = mark == 1
        node.signed = tag == "time" or signed(attributes)
        top.parts.append(node)
        if not attributes.rstrip().endswith("/") or tag in BLOCKS:
            stack.append(node)
            opened[tag] += 1
    text(len(html))
    return root


def walk(root: Node) -> list[Node]:
    """All nodes that aren't aside, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.off:
            out.append(node)
            todo += [x for x in node.parts if isinstance(x, Node)]
    return out


def drop_discussion(root: Node) -> None:
    """Sets aside comments that are known by their form alone, and blocks that only label an advert.

    Every node is visited a fixed number of times, and only texts of up to SHORT characters are put together.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.parts if isinstance(x, Node)]
    sizes: dict[int, int] = {}
    brief: dict[int, str] = {}  # the texts of nodes with little text
    answers: dict[int, bool] = {}
    signs: dict[int, bool] = {}
    titled: dict[int, bool] = {}
    for node in reversed(order):
        inner = [x for x in node.parts if isinstance(x, Node)]
        own = sum(len(x) for x in node.parts if isinstance(x, str))
        size = sizes[id(node)] = own + sum(sizes[id(x)] for x in inner)
        brief[id(node)] = "".join(x if isinstance(x, str) else brief[id(x)] for x in node.parts) if size <= SHORT else ""
        short = " ".join(brief[id(node)].lower().split()).strip("()[]:·•- ")
        answers[id(node)] = any(answers[id(x)] for x in inner) or (node.tag in ("a", "button") and short in REPLY_TEXTS)
        signs[id(node)] = node.signed or any(signs[id(x)] for x in inner)
        titled[id(node)] = node.tag in ("h1", "article", "main") or any(titled[id(x)] for x in inner)
        if node.tag in BLOCKS and short in ADVERT_TEXTS and node.tag not in HEADS:
            node.off = True
    for node in order:
        inner = [x for x in node.parts if isinstance(x, Node)]
        units = [x for x in inner if answers[id(x)] and signs[id(x)] and not titled[id(x)] and sizes[id(x)] <= UNIT_SHARE * sizes[id(root)] and x.tag in BLOCKS]
        often = Counter(x.tag for x in units)
        units = [x for x in units if often[x.tag] > 1]
        if not units:
            continue
        for unit in units:
            unit.off = True
        around = [(inner, inner.index(units[0]))]
        if node.parent and len(units) >= len(inner) - 1:  # a list of comments: its heading may stand before the list
            beside = [x for x in node.parent.parts if isinstance(x, Node)]
            around.append((beside, beside.index(node)))
        for row, place in around:
            head = row[place - 1] if place else None
            if head is not None and head.tag in HEADS and not COMMENT_HEADS.isdisjoint(w.strip("():,") for w in brief[id(head)].lower().split()):
                head.off = True


def score(root: Node) -> list[Node]:
    """Sets the composite text density and the density sum of every node."""
    drop_discussion(root)
    nodes = walk(root)
    for node in reversed(nodes):
        own = sum(len("".join(x.split())) for x in node.parts if isinstance(x, str))
        node.chars += own
        node.link_chars += own * node.in_link
        if node.doubtful and 2 * node.link_chars > node.chars:
            node.off = True
        if node.parent and not node.off:
            up = node.parent
            up.chars, up.link_chars = up.chars + node.chars, up.link_chars + node.link_chars
            up.tags, up.link_tags = up.tags + node.tags + 1, up.link_tags + node.link_tags + (node.tag == "a")
    nodes = walk(root)
    share = root.link_chars / max(1, root.chars)
    for node in reversed(nodes):
        c, lc, t, lt = node.chars, node.link_chars, max(1, node.tags), max(1, node.link_tags)
        if c:
            base = log(c / max(1, c - lc) * lc + share * c + e)
            adjusted = log(max(1.0, c / max(1, lc) * t / lt)) / log(max(base, 1.0 + 1e-9))
            node.density = c / t * adjusted
        if node.parent:
            node.parent.total += node.density
    return nodes


def lifted(node: Node) -> Node:
    """The outermost article around a node, else the outermost main, else the node."""
    around = [node]
    while around[-1].parent:
        around.append(around[-1].parent)
    return next((x for tag in ("article", "main") for x in reversed(around) if x.tag == tag), node)


def chosen(root: Node) -> list[Node]:
    """The article's subtrees in page order: the one with the largest density sum (all of the
    article or main element around it, if there is one), and what belongs to it beside its path."""
    nodes = [x for x in score(root) if x.chars]
    if not nodes:
        return []
    best = lifted(max((x for x in nodes if x.tag in BLOCKS), key=lambda x: x.total, default=root))
    if not best.total:
        best = root  # no block inside another: all the text is one article
    path, node = [best], best
    while node.parent:
        node = node.parent
        path.append(node)
    threshold = min(x.density for x in path)
    beside = {id(x) for up, inner in zip(path[1:], path) for k, x in enumerate(up.parts) if isinstance(x, Node) and x is not inner and belongs(x, best, threshold, k < up.parts.index(inner))}
    picked = beside | {id(best)}
    return [x for x in in_order(root) if id(x) in picked]


def belongs(node: Node, best: Node, threshold: float, before: bool) -> bool:
    """Whether a node beside the path from the article to body is part of the article."""
    if node.off or not node.chars or 2 * node.link_chars >= node.chars or node.tag not in BLOCKS:
        return False
    return (before and node.tag in ("h1", "h2")) or (node.density >= threshold and 4 * max(node.total, node.density) >= best.total)


def in_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in reversed(node.parts) if isinstance(x, Node) and not x.off]
    return out


def blocks(top: Node) -> Iterator[str]:
    """The text of each block under top, white space as single spaces, in page order."""
    pieces: list[str] = []
    todo: list[Node | str | None] = [None, top]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            pieces.append(x)
        elif x is None:
            if found := " ".join("".join(pieces).split()):
                yield found
            pieces.clear()
        elif x.tag == "br":
            pieces.append(" ")
        elif not x.off:
            if x.tag in BLOCKS:
                todo += [None, *reversed(x.parts), None]
            else:
                todo += reversed(x.parts)


def main_text(html: str | None) -> str:
    """The article's blocks joined by newlines; empty if there is none."""
    return "\n".join(b for top in chosen(parse(html)) for b in blocks(top)) if html else ""


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page. Null html counts as empty; repeated rows and
    null ids or urls come back as they are; a page without an article has an empty text. Pages of any length and
    depth are read whole, in linear time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    narrow = pages.select("page_id", "url", "html")
    kinds = [narrow.schema[x].dataType.simpleString() for x in ("page_id", "url")]
    return narrow.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
