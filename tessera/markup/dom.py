"""A small HTML tree from the standard library's tokenizer, with implied end tags, and a selector matcher."""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element, as HTML allows to leave its end tag out.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "thead": frozenset(["tbody", "tfoot"]),
    "tbody": frozenset(["tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
#: Elements that an implied end doesn't reach out of.
SCOPES = frozenset("table ul ol dl td th body html blockquote div article section main button select template".split())
#: Levels of open elements; what is nested deeper stands side by side at the last level, as in browsers.
MOST_DEPTH = 512
_HEAD_ONLY = frozenset("base link meta noscript script style template title head html".split())


class Node:
    """An element: tag, attributes, and children that are nodes or strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def walk(self):
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                stack += reversed(c.children)
        return "".join(out)

    def after_children(self):
        """All elements below and this one, each after those that it holds."""
        found, stack = [], [self]
        while stack:
            node = stack.pop()
            found.append(node)
            stack += [c for c in node.children if isinstance(c, Node)]
        return reversed(found)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def _ends(self, tag: str) -> None:
        """Close what the start of ``tag`` ends, within the nearest scope."""
        k = len(self.open) - 1
        while k > 0:
            name = self.open[k].tag
            if tag in CLOSED_BY.get(name, ()):
                del self.open[k:]
                k = len(self.open)
            elif name in SCOPES:
                return
            k -= 1

    def handle_starttag(self, tag, attrs):
        self._ends(tag)
        node = Node(tag, {k: v if v is not None else "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) <= MOST_DEPTH:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and tag in ("svg", "path", "g", "use", "circle", "rect"):
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        own = self.open[-1].children
        if own and isinstance(own[-1], str):
            own[-1] += data
        else:
            own.append(data)


def parse(html: str) -> Node:
    """The document; always with html and body, as a browser makes it."""
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    root = builder.root
    page = next((c for c in root.children if isinstance(c, Node) and c.tag == "html"), None)
    if page is None:
        page = Node("html", parent=root)
        page.children, root.children = root.children, [page]
    else:
        page.children += [c for c in root.children if c is not page and (isinstance(c, Node) or c.strip())]
        root.children = [page]
    for c in page.children:
        if isinstance(c, Node):
            c.parent = page
    if not any(isinstance(c, Node) and c.tag in ("body", "frameset") for c in page.children):
        body = Node("body", parent=page)
        stay = [c for c in page.children if isinstance(c, Node) and c.tag in _HEAD_ONLY]
        known = set(map(id, stay))
        body.children = [c for c in page.children if id(c) not in known]
        for c in body.children:
            if isinstance(c, Node):
                c.parent = body
        page.children = [*stay, body]
    return root


_SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?((?:\.[\w-]+|#[\w-]+|\[[^\]]+\]|:not\([^)]*\))*)")
_EXTRA = re.compile(r"\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*[\"']?([^\"'\]]*)[\"']?)?\s*\]|:not\(([^)]*)\)")


@lru_cache(maxsize=500)
def _compiled(selector: str) -> tuple:
    """Alternatives; each is a tuple of compound tests, all but the last of parents."""
    out = []
    for one in selector.split(","):
        compounds = []
        for part in one.split(">"):
            m = _SIMPLE.fullmatch(part.strip())
            if m is None:
                raise ValueError(f"unsupported selector: {part.strip()}")
            compounds.append((m[1].lower() if m[1] else None, tuple(_EXTRA.findall(m[2]))))
        out.append(tuple(compounds))
    return tuple(out)


def _fits(node: Node, compound: tuple) -> bool:
    tag, extras = compound
    if tag is not None and node.tag != tag:
        return False
    for name, ident, attr, value, inner in extras:
        if name and name not in node.classes():
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if attr and (attr not in node.attrs or (value and node.attrs[attr] != value)):
            return False
        if inner and matches(node, inner):
            return False
    return True


def matches(node: Node, selector: str) -> bool:
    for compounds in _compiled(selector):
        own: Node | None = node
        for compound in reversed(compounds):
            if own is None or not _fits(own, compound):
                break
            own = own.parent
        else:
            return True
    return False


def select(node: Node, selector: str) -> list[Node]:
    return [n for n in node.walk() if matches(n, selector)]


def remove(node: Node, selector: str) -> None:
    remove_all(select(node, selector))


def remove_all(nodes: list[Node]) -> None:
    """Take elements out of their parents, whose children are gone through once."""
    gone, parents = set(map(id, nodes)), {id(n.parent): n.parent for n in nodes if n.parent is not None}
    for p in parents.values():
        p.children = [c for c in p.children if id(c) not in gone]
    for n in nodes:
        n.parent = None
