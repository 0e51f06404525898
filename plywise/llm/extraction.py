"""Main text of HTML by composite text density.

A page is read into a tree (tags that end others implicitly, and void tags, as browsers do; elements below ``_DEPTH``
others stand beside each other, with all their text). What is never text (scripts, styles, controls and the like), and
what says of itself that it is a menu, header, footer, sidebar, notice, advert or reader comment, by its tag, role or
class, is left out; by class, and forms, only if it holds no more than half of the page's text outside links, and if all
words of a class or id agree. For every other node the characters per tag are computed, adjusted for
links:

    density = C / T * log_b((C / max(LC, 1)) * (T / max(LT, 1)))    with  b = e + C * LC / max(C - LC, 1) + LCb / Cb * C

of C characters and T tags below it, LC and LT of them in links, and the body's Cb and LCb. A node's sum is that of its
children's densities. The subtree with the largest sum is the core of the text; an article or main element around it is
taken whole. The least density on the path from the core to the body is the threshold: other subtrees off that path
belong to the text if they reach it and have no links to speak of; inside the chosen subtrees nothing is dropped.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plywise.llm import common
from plywise.llm.common import pieces, strings

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*?)(/?)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(/?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCKS - frozenset("caption body head html li dd dt option tbody td tfoot th thead tr legend summary".split())
_ENDED_BY = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
             "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
_SCOPES = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",),
           "tbody": ("table",), "tfoot": ("table",)}

# What is not main text: by tag, by role, by words of class and id.
_DROPPED = frozenset(
    "script style noscript template iframe svg canvas object embed audio video map nav footer aside button select option input textarea "
    "dialog head title noembed noframes xmp".split())
# What is not main text unless it holds most of the page's.
_DOUBTED = frozenset(("form", "menu"))
_ROLES = frozenset("navigation banner complementary contentinfo search form menu menubar dialog alert alertdialog toolbar".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner sidebar aside nav navbar navigation menu "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login comment comments commentlist disqus respond reply replies related recommended share sharing social widget pagination pager toolbar "
    "skip copyright legal disclaimer paywall".split())
# What a name of class or id may hold besides: parts of the layout. A name with any other word (no-sidebar, has-comments,
# case-notice) says something else.
_BESIDE = frozenset(
    "wrapper wrap container holder box block bar area zone section region panel pane inner outer content list item items row col column group unit slot "
    "main primary secondary site page global top bottom left right header head title link links button buttons icons icon form text image img "
    "mobile desktop fixed sticky default small large x posts articles stories media policy message rail".split())
# Listed words that with "text" or "content" beside them name what they hold, not what they are.
_PLAIN = frozenset("text content title section articles stories".split())
_SUBJECTS = frozenset("legal copyright notice notices alert disclaimer respond skip".split())
_HEADINGS = frozenset(("header",))
# Elements that are never a whole text.
_PARTS = frozenset("p li ul ol b i em strong span blockquote table tbody tr td".split())


#: Elements nested more deeply than this stand beside each other, as in browsers.
_DEPTH = 256


class _Node:
    __slots__ = ("tag", "depth", "parent", "children", "dropped", "doubted", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: _Node | None, dropped: bool):
        self.tag, self.parent, self.children, self.dropped = tag, parent, [], dropped
        self.doubted = False
        self.depth = 0 if parent is None else parent.depth + 1
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0


def _drops(tag: str, attributes: str, parent: _Node) -> bool:
    if tag in _DROPPED:
        return True
    if tag in _HEADINGS and not _inside(parent, ("article", "main")):
        return True
    for name, value in _pairs(attributes):
        if tag not in ("html", "body", "article", "main"):
            value = value.lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _ROLES:
                return True
    return False


def _pairs(attributes: str) -> Iterator[tuple[str, str]]:
    """Names, in lower case, and values of attributes, one after another."""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        yield name.lower(), a or b or c


def _doubted(tag: str, attributes: str) -> bool:
    """Whether the tag, a class or an id says that the element is no main text."""
    if tag in ("html", "body", "article", "main"):
        return False
    if tag in _DOUBTED:
        return True
    return any(_says(x) for name, value in _pairs(attributes) if name in ("class", "id") for x in value.split())


def _says(name: str) -> bool:
    """Whether a name is a listed word, or a compound of listed words and parts of the layout."""
    for words in ([w.lower() for w in _WORD.findall(name)], [w.lower() for w in _WORD.findall(name.lower())]):
        listed = [w for w in words if w in _WORDS]
        if listed and all(w in _WORDS or w in _BESIDE for w in words):
            return not (_SUBJECTS.issuperset(listed) and not _PLAIN.isdisjoint(words))
    return False


def _inside(node: _Node | None, tags: tuple[str, ...]) -> bool:
    while node is not None:
        if node.tag in tags:
            return True
        node = node.parent
    return False


def tree(page: str) -> _Node:
    """The page's elements, and strings for its text; dropped elements stay as nodes without children."""
    root = node = _Node("#root", None, False)
    at, size = 0, len(page)
    unended: set[str] = set()
    while at < size:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else size
        if stop > at and not node.dropped:
            node.children.append(entities.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        tag = m.group(2) or m.group(6)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1) or m.group(5):
            if tag == "br":
                node.children.append("\n")
            elif tag == "p" and not _inside(node, ("p",)):
                node.children.append(_Node("p", node, node.dropped))
            else:
                node = _closed(node, tag)
            continue
        attributes = m.group(3) or m.group(7) or ""
        node = _opened(node, tag)
        new = _Node(tag, node, node.dropped or _drops(tag, attributes, node))
        new.doubted = not new.dropped and _doubted(tag, attributes)
        node.children.append(new)
        if tag in _RAW:
            end = None if tag in unended else re.compile(rf"</{tag}\s*/?>|</{tag}\Z", re.I).search(page, at)
            if end is None:
                unended.add(tag)
            if end is None and tag in ("script", "style", "textarea", "title"):
                at = size
            elif end is not None:
                at = end.end()
        elif tag not in _VOID and new.depth < _DEPTH:
            node = new
    return root


def _opened(node: _Node, tag: str) -> _Node:
    """Where a new element goes: elements that its start tag ends are closed."""
    if tag in _ENDS_P:
        up: _Node | None = node
        while up is not None and up.tag not in ("table", "td", "th", "button", "#root"):
            if up.tag == "p":
                return up.parent
            up = up.parent
    if tag in _ENDED_BY:
        up, found = node, None
        while up is not None and up.tag not in _SCOPES[tag]:
            if up.tag in _ENDED_BY[tag]:
                found = up
            up = up.parent
        if found is not None:
            return found.parent
    return node


def _closed(node: _Node, tag: str) -> _Node:
    """The element that is open once the nearest one of this tag has ended; an end tag without a start ends nothing."""
    up: _Node | None = node
    while up is not None:
        if up.tag == tag:
            return up.parent or up
        if tag not in _BLOCKS and up.tag in _BLOCKS:
            return node
        up = up.parent
    return node


def _measure(root: _Node) -> list[_Node]:
    """Characters, tags, and those in links, of all nodes; the nodes in page order."""
    order, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        order.append(node)
        waiting.extend(c for c in reversed(node.children) if isinstance(c, _Node) and not c.dropped)
    for node in reversed(order):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                node.chars += sum(map(len, c.split()))
            elif not c.dropped:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    return order


def _settle(order: list[_Node]) -> bool:
    """Drops what class or id speak against, unless it holds most of the page's text outside links."""
    most = (order[0].chars - order[0].link_chars) / 2
    found = False
    for node in order:
        if node.doubted and node.chars - node.link_chars <= most:
            node.dropped = found = True
    return found


def _main(root: _Node) -> list[_Node]:
    """The chosen subtrees, in page order."""
    order = _measure(root)
    if _settle(order):
        order = _measure(root)
    body = next((n for n in order if n.tag == "body"), root)
    if not body.chars:
        body = root
    ratio = body.link_chars / max(body.chars, 1)
    for node in order:
        c, t, lc, lt = node.chars, max(node.tags, 1), node.link_chars, node.link_tags
        if c:
            base = math.e + c * lc / max(c - lc, 1) + ratio * c
            node.density = c / t * max(math.log(c / max(lc, 1) * t / max(lt, 1)) / math.log(base), 0.0)
    for node in order:
        node.sum = sum(n.density for n in node.children if isinstance(n, _Node) and not n.dropped)
    inside, waiting = [], [body]
    while waiting:
        inside.append(waiting.pop())
        waiting.extend(c for c in inside[-1].children if isinstance(c, _Node) and not c.dropped)
    core = max(inside, key=lambda n: (n.sum or (n.density if not any(isinstance(c, _Node) for c in n.children) else 0.0), n.chars))
    whole, up = core, core
    while up is not None and up is not body:
        if up.tag in ("article", "main"):
            whole = up
        elif up.tag in _PARTS:
            whole = up.parent
        up = up.parent
    path, up = [], whole
    while up is not None and up is not body:
        path.append(up)
        up = up.parent
    threshold = min((n.density for n in [*path, body]), default=0.0)
    on_path = {id(n) for n in path}
    chosen = [whole]
    if whole is not body and not _inside(whole, ("article", "main")):
        for n in [body, *path[1:]]:
            for c in n.children:
                if isinstance(c, _Node) and not c.dropped and id(c) not in on_path and c.chars and c.density >= threshold and 3 * c.link_chars < c.chars:
                    chosen.append(c)
    ids = {id(n) for n in chosen}
    return [n for n in order if id(n) in ids]


def _blocks(node: _Node) -> Iterator[str]:
    """The texts of a subtree's blocks: block elements part them, white space inside is one space."""
    parts: list[str] = []
    waiting: list = [node]
    while waiting:
        x = waiting.pop()
        if x is None:
            if text := " ".join("".join(parts).split()):
                yield text
            parts = []
        elif isinstance(x, str):
            parts.append(x)
        elif not x.dropped:
            if x.tag == "br":
                parts.append("\n")
            block = x.tag in _BLOCKS
            waiting += [None] * block
            waiting.extend(reversed(x.children))
            waiting += [None] * block
    if text := " ".join("".join(parts).split()):
        yield text


def extracted(page: str) -> str:
    """Main text of one page: its blocks, each on a line; empty if there is none."""
    return "\n".join(t for n in _main(tree(page)) for t in _blocks(n))


def texts(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row.

    Null or empty html has an empty text; repeated rows each get a row; further columns are ignored; an empty table gives
    an empty result. Rows never leave their task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            found = [extracted(h.decode("utf-8", "replace")) for h in strings(piece.column("html"))]
            yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(found, pa.string()),
                                              pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", common.text_or_empty("html").alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op3_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return texts(common.table(spark, folder, "pages", "page_id", "url", "html"))


common.shipped(__name__)
