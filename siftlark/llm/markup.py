"""Reading a page: text blocks in order, each with the node of the site's tree that holds it."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead title tr ul caption".split()
)
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option optgroup legend title head body html".split())
#: An opening tag ends these open elements, looked for up to the nearest of the bounds.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "body": (("head",), ("html",)),
}

# Elements that a browser does not show as text, and what marks a branch as likely no part of the article.
UNSEEN_TAGS = frozenset(
    "head script style noscript template select textarea iframe object embed applet svg canvas math audio video map noembed noframes datalist option optgroup title input".split()
)
DROPPED_TAGS = frozenset("nav footer aside form dialog menu search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion "
    "banner banners cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "sidebar sidebars aside nav navbar navigation menu menus breadcrumb breadcrumbs footer footers header headers masthead topbar "
    "comment comments disqus respond replies share sharing social related recommended recommendations widget widgets pagination pager".split()
)
COMMENT_NAMES = frozenset("comment comments disqus respond replies".split())
HEADER_NAMES = frozenset("header headers".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|</[^a-zA-Z][^>]*>?",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: What mark-up says of a block: nothing, in an article, in a branch that its name marks as no part of it.
PLAIN, ARTICLE, NAMED = 0, 1, 2
#: Ends of labels in a branch: a branch named whole, one of whose compound names a part is listed, an article.
WHOLE, PART, IS_ARTICLE = "\x01", "\x02", "\x03"
#: Priors of nodes in branches named whole and in part; a node that is an article has ``IN_ARTICLE`` in place of one.
NAMED_PRIOR, PART_PRIOR, IN_ARTICLE = 0.2, 0.5, -1.0
TEXT = "#text"


class Block(NamedTuple):
    """``node`` holds the text (None: outside all elements); ``mark`` is what the nearest telling element above says."""

    text: str
    node: int | None
    mark: int


class Node:
    """A node of the tree with text at or below it: the node above it, its depth, its prior, what stands in it in order, and whether text does."""

    __slots__ = ("parent", "depth", "prior", "content", "holds")

    def __init__(self, parent: int | None, depth: int, prior: float):
        self.parent, self.depth, self.prior, self.content, self.holds = parent, depth, prior, [], False


class _Open:
    """An open element. ``holder`` is the block element that its text belongs to, ``line`` the named inline element that its text is in."""

    __slots__ = ("tag", "label", "unseen", "article", "mark", "barred", "node", "depth", "inherited", "prior", "holder", "above", "line", "told")

    def __init__(self, tag: str, above: _Open | None):
        self.tag, self.above, self.told = tag, above, False


def _number(parent: int, label: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(label.encode(), seed=parent & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def _unseen(tag: str, attributes: dict[str, str]) -> bool:
    if tag in UNSEEN_TAGS or "hidden" in attributes:
        return True
    return bool(re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I))


def _named(tag: str, attributes: dict[str, str], article: bool) -> str:
    """Whether tag, role, class or id name a menu, header, advert and so on: wholly, in a part of a compound name, or not."""
    if tag in DROPPED_TAGS or (tag == "header" and not article) or attributes.get("role", "").lower() in DROPPED_ROLES:
        return WHOLE
    if not attributes or tag in ("html", "body", "main"):
        return ""
    listed = COMMENT_NAMES if tag == "article" else DROPPED_NAMES - HEADER_NAMES if article else DROPPED_NAMES
    found = ""
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = {w.lower() for w in WORDS.findall(name)}
        if parts and parts <= listed:
            return WHOLE
        if parts & listed:
            found = PART
    return found


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def read_blocks(page: str, host: int = 0) -> tuple[list[Block], dict[int, Node]]:
    """The page's blocks in order, but for what a browser does not show, and the nodes on the way to them.

    A node's number is a hash of its parent's and its own label, so that an element costs the same at any depth. An inline
    element marks no text of its block; only if all the text of a block stands in named inline elements (or buttons) is it
    held by a node of its own below the block, for the tree to judge.
    """
    blocks: list[Block] = []
    nodes: dict[int, Node] = {}
    stack: list[_Open] = []
    where: dict[str, list[int]] = {}
    parts: list[str] = []
    lines: list[_Open | None] = []  # of the parts that are not blank
    at = 0

    def tell(block: _Open) -> None:
        """Every element with text at or below it stands once in the content of the element above it."""
        while not block.told:
            block.told = True
            above = block.above.holder if block.above else None
            if block.node not in nodes:
                nodes[block.node] = Node(above.node if above else None, block.depth, block.prior)
            if above is None:
                return
            if above.node not in nodes:
                outer = above.above.holder if above.above else None
                nodes[above.node] = Node(outer.node if outer else None, above.depth, above.prior)
            nodes[above.node].content.append(block.label)
            block = above

    def hold(number: int, content: str) -> None:
        nodes[number].content.append(content)
        nodes[number].holds = True

    def flush() -> None:
        if not parts:
            return
        text = " ".join("".join(parts).split())
        parts.clear()
        aside = lines[0] if lines and all(line is not None for line in lines) else None
        lines.clear()
        if not text:
            return
        block = stack[-1].holder if stack else None
        if block is None:
            blocks.append(Block(text, None, PLAIN))
            return
        tell(block)
        if aside is None:
            hold(block.node, TEXT)
            blocks.append(Block(text, block.node, block.mark))
        else:
            number = _number(block.node, aside.label)
            nodes[block.node].content.append(aside.label)
            if number not in nodes:
                nodes[number] = Node(block.node, block.depth + 1, min(block.inherited, NAMED_PRIOR))
            hold(number, TEXT)
            blocks.append(Block(text, number, NAMED))

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            where[stack.pop().tag].pop()

    def last(tags: tuple[str, ...]) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=-1)

    def find(tags: tuple[str, ...], bounds: tuple[str, ...]) -> int:
        depth = last(tags)
        return depth if depth > last(bounds) else -1

    def text(upto: int) -> None:
        if upto > at and not (stack and stack[-1].unseen):
            parts.append(html.unescape(page[at:upto]))
            if not parts[-1].isspace():
                lines.append(stack[-1].line if stack else None)

    position = 0
    while found := TOKEN.search(page, position):
        text(found.start())
        at = position = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if not found[0].endswith(">"):
            break  # the page ends inside a tag
        if tag == "br":
            if not (stack and stack[-1].unseen):
                parts.append(" ")
            continue
        if found[1]:
            depth = find((tag,), ())
            if depth >= 0:
                if tag in BLOCK or any(o.tag in BLOCK for o in stack[depth:]):
                    flush()
                pop_to(depth)
            continue
        if tag in BLOCK:
            flush()
        if tag in CLOSES_P and (depth := find(("p",), ("table", "button", "td", "th"))) >= 0:
            pop_to(depth)
        if tag in ENDS and (depth := find(*ENDS[tag])) >= 0:
            pop_to(depth)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, position)
            at = position = end.end() if end else len(page)
            continue
        attributes = _attributes(found[3]) if found[3].strip("/ \t\r\n\f") else {}
        above = stack[-1] if stack else None
        entry = _Open(tag, above)
        inside = bool(above and above.article)
        named = _named(tag, attributes, inside)
        entry.unseen = bool(above and above.unseen) or _unseen(tag, attributes)
        entry.barred = bool(above and above.barred) or tag in DROPPED_TAGS
        entry.article = inside or tag == "article"
        # An inline element passes its name on to blocks inside it, and to a line that stands in it whole.
        entry.mark = NAMED if named == WHOLE else above.mark if above else PLAIN
        if tag == "article" and named != WHOLE and not entry.barred:
            entry.mark = ARTICLE
        end = named or (IS_ARTICLE if entry.mark == ARTICLE and tag == "article" else "")
        entry.label = ".".join([tag, *sorted(attributes.get("class", "").lower().split())]) + end
        inherited = above.inherited if above else 1.0
        entry.inherited = NAMED_PRIOR if end == WHOLE else 1.0 if end == IS_ARTICLE else inherited
        entry.prior = IN_ARTICLE if end == IS_ARTICLE else min(entry.inherited, PART_PRIOR if end == PART else 1.0)
        if tag in BLOCK:
            entry.holder, entry.line = entry, None
            outer = above.holder if above else None
            # A named inline element between them sets its blocks apart from others of the same label.
            path = f"{above.line.label}/{entry.label}" if above and above.line else entry.label
            entry.node, entry.depth = _number(outer.node if outer else host, path), outer.depth + 1 if outer else 1
        else:
            entry.holder = above.holder if above else None
            entry.line = entry if named == WHOLE or tag == "button" else above.line if above else None
        stack.append(entry)
        where.setdefault(tag, []).append(len(stack) - 1)
    else:
        text(len(page))
    flush()
    return blocks, nodes
