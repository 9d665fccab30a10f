"""Main text of web pages by composite text density.

A page becomes a tree of elements. Every node gets its composite text density: the
characters per tag of its subtree, adjusted by the share of characters and tags that stand
in links. A node's density sum adds up the densities of its children; the node with the
largest sum is the centre of the content, whatever its tag. The smallest text density (characters outside links per tag, which unlike
the composite density doesn't grow with size) on the path from the centre up to the body is
the threshold, and the blocks beside the path are judged by it one by one, in page order.
Below the threshold a block stays where the page's main heading joins it with the centre, or
as prose right beside the centre; what consists mostly of links goes. No rule compares a
block with the size of the centre. Menus, page headers, footers, sidebars, adverts, notices,
forms, scripts and reader comments are left out by tag and by the words of class and id.

Defined results: a null or empty page has an empty text; unclosed or cut-off markup is
read as far as it goes; character references are decoded (unknown ones stay); blocks are
joined by one line feed in page order. Rows are read one by one: repeated rows repeat.
"""

from __future__ import annotations

import html as entities
import math
import re

import pandas as pd
from pyspark.sql import DataFrame

# fixed values: element kinds of HTML
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
_CLOSES_P = _BLOCK - {"br", "body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "title"}
_SELF_CLOSING = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_DROPPED = frozenset(
    "head script style noscript template svg canvas object embed iframe audio video nav footer aside form button select input "
    "textarea dialog menu search map".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ad(?:s|box|slot|block|unit|container|wrap|wrapper|banner|space)?\d*|advert\w*|adsense|sponsor\w*|promo\w*|\w*banner|\w*nav|nav\w*|\w*menu|"
    r"breadcrumbs?|\w*sidebar|side|aside|rail|\w*footer|foot|masthead|topbar|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|"
    r"subscription|signup|login|share|sharing|social|related|recommend\w*|widget|\w*comments?|commentlist|disqus|replies|reply|respond|pager|pagination|toolbar|form|"
    r"\w*header|copyright|legal|disclaimer|skip|hidden|print-only|sr-only)(?=$|[\s_-])",
    re.IGNORECASE,
)
#: what makes even an article noise
_FOREIGN = re.compile(r"(?:^|[\s_-])(?:\w*comments?|replies|reply|respond|ads?|advert\w*|sponsor\w*|promo\w*|related|recommend\w*|teaser)(?=$|[\s_-])", re.IGNORECASE)
#: classes in which a word of _NOISE tells of the layout or of a heading
_HARMLESS = re.compile(
    r"(?:^|(?<=\s))(?:(?:\w+-)*(?:has|with|without|no)[_-][\w-]+|(?:post|entry|article|story|content|title|section|text)[_-]+header|side[_-]by[_-]side)(?=$|\s)",
    re.IGNORECASE,
)
#: words that are noise alone or beside another word of surroundings, but not in a name such as long-form or social-science
_WEAK = re.compile(r"side|rail|form|social|legal|alert|skip|respond|foot", re.IGNORECASE)
_BESIDE = re.compile(
    r"bar|box|block|wrap\w*|container|section|area|inner|outer|left|right|top|bottom|main|site|page|global|links?|list|items?|icons?|buttons?|btn|media|contact|"
    r"search|mail|email|content|col|column|row|field|group|info|text|message|\d*",
    re.IGNORECASE,
)
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_PROSE = frozenset("p blockquote pre ul ol dl figure table hgroup section".split()) | frozenset(_HEADINGS)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "parent", "parts", "noise", "chars", "tags", "link_chars", "link_tags", "head_links", "density", "sum")

    def __init__(self, tag, parent=None, noise=False):
        self.tag, self.parent, self.noise = tag, parent, noise
        self.parts: list = []  # nodes and texts in page order
        self.chars = self.tags = self.link_chars = self.link_tags = self.head_links = 0
        self.density = self.sum = 0.0

    def children(self):
        return [x for x in self.parts if x.__class__ is Node]


def _named_noise(value: str, words: re.Pattern) -> bool:
    """Whether a class or id names surroundings; a weak word counts alone or if each other part of its name is one too."""
    for name in _HARMLESS.sub(" ", _CAMEL.sub("-", value)).split():
        if words.search(name):
            parts = [x for x in re.split("[_-]+", name) if x]
            others = [x for x in parts if not _WEAK.fullmatch(x)]
            if len(others) in (0, len(parts)) or all(_BESIDE.fullmatch(x) or words.search(x) for x in others) or words.search("-".join(others)):
                return True
    return False


def _is_noise(tag: str, attributes: str) -> bool:
    if tag in _DROPPED:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    words = _FOREIGN if tag in ("article", "main") else _NOISE
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id") and _named_noise(value, words):
            return True
        if name == "role" and value.strip().lower() in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and _HIDDEN.search(value):
            return True
    return False


def parse(page: str) -> Node:
    """The body of a page as a tree. Scripts and comments are not kept; unclosed elements end with their parents."""
    body = Node("body")
    open_nodes, at, n = [body], 0, len(page)

    def close(tags, stop):
        for k in range(len(open_nodes) - 1, 0, -1):
            tag = open_nodes[k].tag
            if tag in tags:
                del open_nodes[k:]
                return
            if tag in stop:
                return

    while at < n:
        m = _TOKEN.search(page, at)
        start = m.start() if m else n
        if start > at:
            open_nodes[-1].parts.append(page[at:start])
        if not m:
            break
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            if tag == "p" or tag in _BLOCK or len(open_nodes) > 1:
                close({tag}, {"body"} if tag in _BLOCK else _BLOCK - {"p", "li"} if tag not in ("a",) else _BLOCK)
            continue
        if tag in ("html", "body"):
            continue
        if tag in _CLOSES_P:
            close({"p"}, {"article", "section", "div", "td", "th", "blockquote", "li", "body", "button", "table", "main", "aside", "footer", "header", "nav"})
        if tag in _SELF_CLOSING:
            close(*_SELF_CLOSING[tag])
        node = Node(tag, open_nodes[-1], _is_noise(tag, m[3]))
        open_nodes[-1].parts.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            if tag == "textarea":
                node.parts.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in _VOID and not m[3].rstrip().endswith("/") or tag not in _VOID and tag in _BLOCK:
            open_nodes.append(node)
    return body


def _walk(root: Node) -> list[Node]:
    """Nodes before their children, without those that are left out and what is below them."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in reversed(node.parts) if x.__class__ is Node and not _left_out(x)]
    return order


def _left_out(node: Node) -> bool:
    if node.tag == "header" and not node.noise:
        return not _inside(node, "article") and not _inside(node, "main")
    return node.noise


def _inside(node: Node, tag: str) -> bool:
    while node := node.parent:
        if node.tag == tag:
            return True
    return False


#: elements that are never a page's wrapper
_NEVER = _DROPPED - {"form"}


def keep_wrappers(body: Node) -> None:
    """Forms and named surroundings that hold most of a page's running text and its main heading are wrappers, not surroundings.

    Running text is what stands outside of links, and outside of elements that no name or place can make content.
    """
    order, todo = [], [body]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.parts if x.__class__ is Node and x.tag not in _NEVER]
    held: dict[int, int] = {}
    headed: set[int] = set()
    rank = min((x.tag for x in order if x.tag in _HEADINGS), default=None)
    for node in reversed(order):
        own = 0
        if node.tag == rank or any(x.__class__ is Node and id(x) in headed for x in node.parts):
            headed.add(id(node))
        for x in node.parts:
            if x.__class__ is Node:
                # what lies in further surroundings doesn't make the outer ones a wrapper
                own += 0 if x.tag in _NEVER or x.tag == "a" else held[id(x)]
            else:
                own += len("".join(x.split()))
        held[id(node)] = own
    most = held[id(body)] / 2
    for node in order:
        if node.noise and node.tag not in _NEVER and held[id(node)] > most and (node.tag == "form" or id(node) in headed):
            inside = sum(held[id(x)] for x in node.parts if x.__class__ is Node and x.tag in ("p", "article", "main", "div", "section", "table", "ul", "ol", *_HEADINGS))
            if inside > most:
                node.noise = False


def densities(body: Node) -> list[Node]:
    """Fill the densities and density sums of all nodes that aren't left out."""
    order = _walk(body)
    kept = {id(x) for x in order}
    for node in reversed(order):
        for x in node.parts:
            if x.__class__ is not Node:
                node.chars += len("".join(x.split())) if "&" not in x else len("".join(entities.unescape(x).split()))
            elif id(x) in kept:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
                node.head_links += x.head_links
        if node.tag == "a":
            node.link_chars = node.chars
        if node.tag in _HEADINGS:
            node.head_links = node.link_chars
    linked, total = max(body.link_chars, 0), max(body.chars, 1)
    for node in reversed(order):
        c, t = node.chars, max(node.tags, 1)
        lc, lt = max(node.link_chars, 1), max(node.link_tags, 1)
        if c:
            free = max(c - node.link_chars, 1)
            base = math.log(c / free * node.link_chars + linked / total * c + math.e)
            node.density = c / t * max(math.log(max(c / lc * t / lt, 1.0)), 0.0) / base
        node.sum = sum(x.density for x in node.parts if x.__class__ is Node and id(x) in kept)
    return order


def _text_density(node: Node) -> float:
    return (node.chars - node.link_chars) / max(node.tags, 1)


def _pieces(node: Node, below: Node):
    """(indexes, stand-in) of the blocks beside ``below`` in its parent; texts and inline elements in a row are one block."""
    run: list[int] = []

    def loose():
        whole = Node("", node)
        for k in run:
            x = node.parts[k]
            if x.__class__ is Node:
                whole.chars += x.chars
                whole.tags += x.tags + 1
                whole.link_chars += x.link_chars
            else:
                whole.chars += len("".join(entities.unescape(x).split()))
        return list(run), whole

    for k, x in enumerate(node.parts):
        if x.__class__ is Node and (x is below or x.tag in _BLOCK or _left_out(x)):
            if run:
                yield loose()
                run.clear()
            if x is not below and not _left_out(x):
                yield [k], x
        else:
            run.append(k)
    if run:
        yield loose()


def content(body: Node) -> tuple[Node, dict[int, set[int]]]:
    """A subtree around the largest density sum, and by node (its ``id``) the numbers of the parts that are no content."""
    order = densities(body)
    best = max(order, key=lambda x: x.sum)
    if best.sum <= 0:  # text without elements
        return best, {}
    path, node = [], best
    while node is not body:
        path.append(node)
        node = node.parent
    path.append(body)
    threshold = min(map(_text_density, path))
    # the main heading is one of the highest rank; what it joins with the centre is one article
    rank = min((x.tag for x in order if x.tag in _HEADINGS and x.chars), default=None)
    titled = set()
    for x in order:
        if rank and x.tag == rank and x.chars:
            while x is not None and id(x) not in titled:
                titled.add(id(x))
                x = x.parent
    top = next((k for k, x in enumerate(path) if id(x) in titled), 0)

    def stays(level: int, x: Node) -> bool:
        title = level <= top and id(x) in titled
        linked, chars = (x.link_chars - x.head_links, x.chars - x.head_links) if title else (x.link_chars, x.chars)
        if 2 * linked >= chars and not (title and not linked):
            return False
        if title or _text_density(x) >= threshold:
            return True
        if level <= top and path[level] is not body:
            return True
        return level <= max(top, 1) and x.tag in _PROSE

    lost: dict[int, set[int]] = {}
    for level, node in enumerate(path[1:], 1):
        out = {k for numbers, x in _pieces(node, path[level - 1]) if x.chars and not stays(level, x) for k in numbers}
        if out:
            lost[id(node)] = out
    return body, lost


def blocks(root: Node, lost: dict[int, set[int]] | None = None) -> list[str]:
    """The texts of the blocks below ``root`` in page order, white space folded, without the parts in ``lost``."""
    out, now, lost = [], [], lost or {}

    def flush():
        if now:
            text = " ".join(entities.unescape("".join(now)).split())
            if text:
                out.append(text)
            now.clear()

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif x.__class__ is not Node:
            now.append(x)
        elif x is root or not _left_out(x):
            if x.tag in _BLOCK:
                flush()
                todo.append(None)
            gone = lost.get(id(x))
            todo += reversed(x.parts) if not gone else [p for k, p in reversed([*enumerate(x.parts)]) if k not in gone]
    flush()
    return out


def main_text(page: str | None) -> str:
    """The main text of a page, whole; empty if there is none."""
    if not isinstance(page, str) or not page:
        return ""
    body = parse(page)
    keep_wrappers(body)
    return "\n".join(blocks(*content(body)))


def extract(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Replace the column ``html`` by ``text`` and ``n_chars``; one pass over the rows, no shuffle."""
    keep = [c for c in pages.columns if c not in (html, text, n_chars)]
    kinds = "".join(f"`{c}` {t}, " for c, t in pages.select(keep).dtypes)

    def run(batches):
        for pdf in batches:
            texts = [main_text(x) for x in pdf[html]]
            out = pdf[keep].reset_index(drop=True)
            out[text] = pd.Series(texts, index=out.index, dtype=object)
            out[n_chars] = pd.Series([len(x) for x in texts], index=out.index, dtype="int64")
            yield out

    return pages.select(*keep, html).mapInPandas(run, f"{kinds}`{text}` string, `{n_chars}` long")
