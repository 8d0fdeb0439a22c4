"""Main text of web pages by tree scoring.

The page is read into a tree; elements that never hold an article (menus, forms, scripts, ...)
and elements named as such by class, id or role are left out. Every paragraph gives points for its
length and its commas to its ancestors, halved at each step; an element's score is its points
times one minus its link density. The best element and those of its siblings that score well or
hold plain prose are the article. Inside it, a block of which nearly all is links to other places is
left out too. Every step is linear in the page: points and lengths go up in one pass from the leaves.

Defined results: a null or empty page has an empty text; a page without any paragraph gives all the
text that is left of its body; broken markup is closed as browsers do; nothing is cut off. Of elements
that score alike the first of the page is the best.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
SKIP = frozenset("head script style noscript template nav footer aside form button select option textarea iframe object svg math canvas audio video dialog menu title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p pre blockquote td dd li div section article main h1 h2 h3 h4 h5 h6".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: An opening tag of the value's keys closes an open element of the key.
CLOSES = {
    "p": BLOCK,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "td": frozenset(["table"]), "th": frozenset(["table"]), "tr": frozenset(["table"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])}
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads\w*|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notices?|notification|alert|popup|modal|toast|disclaimer|paywall|newsletter|subscribe|signup|login|comment\w*|disqus|respond|responses|replies|reply|"
    r"sidebar|side-bar|widget\w*|related\w*|recommend\w*|share|sharing|social\w*|breadcrumbs?|menu\w*|nav|navbar|navigation|masthead|site-header|page-header|global-header|footer|foot|pagination|pager|toolbar|skip|tags|rating|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
_HEADER = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
_OWN_HEADER = re.compile(r"(?:article|entry|post|story|content)[_-]?header", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())


class Node:
    __slots__ = ("chars", "children", "link_chars", "links", "named", "noise", "paragraphs", "parent", "points", "tag", "titled")

    def __init__(self, tag: str, parent: Node | None, noise: str = ""):
        self.tag, self.parent, self.noise, self.children = tag, parent, bool(noise), []
        self.named = noise == "name"
        self.points = 0.0
        self.chars = self.link_chars = self.links = self.paragraphs = 0
        self.titled = False


def _noise(tag: str, attrs: str, in_article: bool) -> str:
    """Why an element is no part of the article: "tag", or "name" where only its names or the tag form say so."""
    if tag in SKIP:
        return "name" if tag == "form" else "tag"
    if not attrs.strip(" /") or tag in ("html", "body", "article", "main"):
        return "tag" if "hidden" in attrs and re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs) and tag not in ("html", "body") else ""
    names = []
    for k, a, b, c in _ATTR.findall(attrs):
        k, v = k.lower(), a or b or c
        if k in ("class", "id"):
            names.append(v)
        elif k == "role" and v.lower() in _ROLES or k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*:\s*none", v):
            return "tag"
    said = " ".join(names)
    return "name" if said and (_NOISE.search(said) or _HEADER.search(said) and not in_article and not _OWN_HEADER.search(said)) else ""


#: An end tag of an inline element does not reach beyond these.
_WALLS = frozenset("article main table td section div body".split())


class _Open:
    """The open elements. Counts tell whether a tag closes anything, so nothing is climbed in vain."""

    def __init__(self, root: Node):
        self.path = [root]
        self.of: Counter = Counter()  # open elements by tag
        self.walled = [Counter()]  # those since the last wall, itself included
        self.blocked = [Counter()]  # those that an opening tag may close, since the last block that it may not

    def push(self, node: Node) -> None:
        self.path.append(node)
        self.of[node.tag] += 1
        if node.tag in _WALLS:
            self.walled.append(Counter())
        self.walled[-1][node.tag] += 1
        if node.tag in BLOCK and node.tag not in CLOSES:
            self.blocked.append(Counter())
        elif node.tag in CLOSES:
            self.blocked[-1][node.tag] += 1

    def pop(self) -> Node:
        node = self.path.pop()
        self.of[node.tag] -= 1
        self.walled[-1][node.tag] -= 1
        if node.tag in _WALLS:
            self.walled.pop()
        if node.tag in BLOCK and node.tag not in CLOSES:
            self.blocked.pop()
        elif node.tag in CLOSES:
            self.blocked[-1][node.tag] -= 1
        return node

    def end(self, tag: str) -> None:
        """An end tag closes the innermost open element of its name; that of an inline element inside the last wall only."""
        if self.of[tag] if tag in BLOCK else self.walled[-1][tag]:
            while self.pop().tag != tag:
                pass

    def make_room(self, tag: str) -> None:
        """Closes what the opening tag closes without an end tag: up to the last paragraph or element of its own name."""
        here = self.blocked[-1]
        while any(n and tag in CLOSES[t] for t, n in here.items()):
            node = self.pop()
            if tag in CLOSES.get(node.tag, ()) and (node.tag == "p" or node.tag == tag):
                return


def parse(page: str) -> Node:
    """A tree of nodes and strings; strings are decoded, comments and declarations are gone."""
    root = Node("#root", None)
    now = _Open(root)
    at, n = 0, len(page)
    while at < n:
        i = page.find("<", at)
        m = _TOKEN.match(page, i) if i >= 0 else None
        while i >= 0 and m is None:  # a lone < is text
            i = page.find("<", i + 1)
            m = _TOKEN.match(page, i) if i >= 0 else None
        end = i if i >= 0 else n
        top = now.path[-1]
        if end > at:
            top.children.append(html.unescape(page[at:end]))
        if m is None:
            break
        at = m.end()
        if m["cdata"]:
            top.children.append(m["cdata"])
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            now.end(tag)
            continue
        if tag in BLOCK or tag in CLOSES:
            now.make_room(tag)
            top = now.path[-1]
        in_article = bool(now.of["article"] or now.of["main"])
        new = Node(tag, top, _noise(tag, m["attrs"], in_article))
        if tag == "header" and not new.noise:
            new.noise = not in_article
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if tag != "noscript" and not new.noise:
                new.children.append(html.unescape(page[at : close.start() if close else n]))
            at = close.end() if close else n
            continue
        top.children.append(new)
        if tag not in VOID and not m["attrs"].endswith("/") or tag in BLOCK and tag != "hr":
            now.push(new)
    return root


def _nodes(root: Node, named: bool = False) -> list[Node]:
    """The elements that are no noise in page order, parents first; with ``named`` also those that only their names rule out."""
    seen, stack = [], [root]
    while stack:
        x = stack.pop()
        seen.append(x)
        stack.extend(c for c in reversed(x.children) if not isinstance(c, str) and (not c.noise or named and c.named))
    return seen


def _keep_the_bulk(root: Node) -> None:
    """An element that only its names rule out is a container of the article if it holds over half of the page's text

    and a title, an article or three paragraphs of it.
    """
    order = _nodes(root, named=True)
    if not any(x.named for x in order):
        return
    size: dict[int, int] = {}
    for x in reversed(order):
        inner = [c for c in x.children if not isinstance(c, str) and id(c) in size]
        size[id(x)] = sum(len(c.strip()) for c in x.children if isinstance(c, str)) + sum(size[id(c)] for c in inner)
        x.paragraphs = (x.tag == "p") + sum(c.paragraphs for c in inner)
        x.titled = x.tag in ("h1", "article", "main") or any(c.titled for c in inner)
    for x in order:
        if x.named and 2 * size[id(x)] > size[id(root)] and (x.titled or x.paragraphs >= 3):
            x.noise = False


#: Elements whose own text counts for the element around them.
_LEAVES = frozenset(["p", "pre", "td", "li", "dd"]) | HEADING


def _score(root: Node) -> list[Node]:
    """Gives points and lengths to all elements; returns the candidates in page order."""
    order = _nodes(root)
    own: dict[int, list[int]] = {}  # characters, characters in links and commas of the text that belongs to a block
    block: dict[int, Node] = {id(root): root}
    linked = {id(root): False}
    for x in order:
        if x is not root:
            block[id(x)] = x if x.tag in BLOCK else block[id(x.parent)]
            linked[id(x)] = x.tag == "a" or linked[id(x.parent)]
            x.links = int(x.tag == "a")
        mine = own.setdefault(id(block[id(x)]), [0, 0, 0])
        for c in x.children:
            if isinstance(c, str):
                k = len(c.strip())
                mine[0] += k
                mine[1] += k * linked[id(x)]
                mine[2] += c.count(",") + c.count("、") + c.count("，")
    for x in reversed(order):
        if block[id(x)] is x:
            chars, links, commas = own[id(x)]
            x.chars += chars
            x.link_chars += links
            points = (1 + commas + min(chars / 100, 3.0)) * (1 - links / chars) if x.tag in PROSE and chars >= 25 else 0.0
            if points and x.tag in _LEAVES and x.parent is not None:
                x.parent.points += points
            else:
                x.points += points
        if x.parent is not None:
            x.parent.points += x.points / 2
            x.parent.chars += x.chars
            x.parent.link_chars += x.link_chars
            x.parent.links += x.links
    return [x for x in order if block[id(x)] is x]


#: What stands between the links of a bar of links; other characters make it prose.
_BAR = frozenset(" \t\n\r\f\v\u00a0|/\u00b7\u2022\u203a\u00bb>-\u2013")


def _is_bar(x: Node) -> bool:
    """Whether nothing but separators stands outside the links."""
    stack: list = [x]
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            if not _BAR.issuperset(c):
                return False
        elif c.tag != "a":
            stack.extend(c.children)
    return True


def _drop_link_lists(article: Node) -> None:
    """Blocks inside the article that are nearly all links: lists of any length, other blocks of three links or more, paragraphs and the like only if they are bars."""
    stack = [c for c in article.children if not isinstance(c, str)]
    while stack:
        x = stack.pop()
        if x.noise:
            continue
        few = 1 if x.tag in ("ul", "ol") else 3
        if x.tag in BLOCK and x.tag not in HEADING and x.links >= few and x.link_chars >= 0.8 * x.chars and (x.tag not in _LEAVES or _is_bar(x)):
            x.noise = True
        else:
            stack.extend(c for c in x.children if not isinstance(c, str))


def _value(x: Node) -> float:
    return x.points * (1 - x.link_chars / x.chars) if x.chars else 0.0


def _render(node: Node, lines: list[str], now: list[str]) -> None:
    def flush():
        line = _SPACE.sub(" ", "".join(now)).strip()
        if line:
            lines.append(line)
        now.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        elif not x.noise:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(x.children))
    flush()


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _keep_the_bulk(root)
    seen = _score(root)
    best, value = None, 0.0
    for x in seen:
        if (v := _value(x)) > value and x.tag not in ("html", "#root"):
            best, value = x, v
    lines: list[str] = []
    if best is None:
        _render(root, lines, [])
        return "\n".join(lines)
    article = best  # an enclosing article holds its own parts, whichever of them scored best
    while article is not None and article.tag not in ("article", "main"):
        article = article.parent
    best = article or best
    _drop_link_lists(best)
    bar = max(10.0, value * 0.2)
    for x in best.parent.children if best.parent is not None else [best]:
        if isinstance(x, str) or x.noise:
            continue
        density = x.link_chars / x.chars if x.chars else 1.0
        prose = x.tag == "p" and (x.chars > 80 and density < 0.25 or 0 < x.chars <= 80 and not x.link_chars and re.search(r"[.!?](?:\s|$)", _flat(x)))
        if x is best or _value(x) >= bar or prose or x.tag in HEADING and best.tag not in ("article", "main") and x.chars and density < 0.25:
            _render(x, lines, [])
    return "\n".join(lines)


def _flat(node: Node) -> str:
    out: list[str] = []
    _render(node, out, [])
    return " ".join(out)


def extract_text(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The key columns, text and n_chars (code points) of every page."""
    d = pages.select(*keys, F.coalesce(F.col(html_col), F.lit("")).alias("__html"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields[:-1]) + ", text string, n_chars long"

    def run(batches):
        for b in batches:
            out = [main_text(x) for x in b.column("__html").to_pylist()]
            cols = [b.column(k) for k in keys] + [pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "text", "n_chars"])

    return d.mapInArrow(run, schema)
