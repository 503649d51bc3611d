"""Element tree to markdown for chunking, and the structure of a markdown text."""

from __future__ import annotations

import re

from .dom import Node
from .jsstrings import RUN, SPACE, pieces, size, trim

#: Elements without a place in the markdown; those that stand on lines of their own.
DROPPED = frozenset("script style nav aside footer header head noscript template".split())
BLOCKS = frozenset("address article body center dd details dialog div dl dt fieldset figcaption figure form html main section summary tbody td tfoot th thead tr".split())
#: Elements that mark each line of what they hold; so deep at most, since the marks add up with every level.
INDENTING, MOST_NESTED = frozenset(["li", "blockquote"]), 32
_CLASS = re.compile(r"(?:language-|lang-|highlight-)([a-zA-Z0-9]+)")
#: Marks of a language in code, first that fits.
MARKS = (("javascript", ("function ", "=>")), ("python", ("def ", "import ")), ("sql", ("SELECT ", "FROM ")), ("php", ("<?php",)))
_ESCAPED = re.compile(r"([\\*_\[\]`])")


def code_language(node: Node) -> str:
    inner = next((n for n in node.walk() if n.tag == "code"), None)
    name = node.attrs.get("class") or (inner.attrs.get("class") if inner is not None else "") or ""
    if m := _CLASS.search(name):
        return m[1]
    text = node.text()
    return next((lang for lang, marks in MARKS if any(k in text for k in marks)), "")


def _inline(mark: str, inner: str) -> str:
    bare = inner.strip()
    if not bare:
        return inner
    lead, trail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
    return f"{lead}{mark}{bare}{mark}{trail}"


def _item(node: Node, inner: str, places: dict[int, int]) -> str:
    """A list's item; ``places`` has those of all items of the ordered lists met so far."""
    mark = "-   "
    if node.parent is not None and node.parent.tag == "ol":
        if id(node) not in places:
            places |= {id(c): k for k, c in enumerate(c for c in node.parent.children if isinstance(c, Node) and c.tag == "li")}
        start = node.parent.attrs.get("start", "")
        mark = f"{(int(start) if start.isdecimal() else 1) + places.get(id(node), 0)}.  "
    return mark + inner.strip().replace("\n", "\n    ") + "\n"


def _leaf(node: Node) -> str:
    if node.tag == "pre":
        return f"\n\n```{code_language(node)}\n{node.text()}\n```\n\n"
    return f"`{node.text()}`" if node.text() else ""


def _rendered(node: Node, top=lambda text: RUN.sub(" ", text)) -> str:
    """The markdown of a node's children; ``top`` treats the text among them. One pass with a stack of open elements."""
    places: dict[int, int] = {}
    open_ = [(node, iter(node.children), [], 0)]
    while True:
        own, rest, parts, nested = open_[-1]
        for c in rest:
            if isinstance(c, str):
                parts.append(top(c) if len(open_) == 1 else _ESCAPED.sub(r"\\\1", RUN.sub(" ", c)))
            elif c.tag in ("pre", "code"):
                parts.append(_leaf(c))
            elif c.tag not in DROPPED:
                open_.append((c, iter(c.children), [], nested + (c.tag in INDENTING)))
                break
        else:
            open_.pop()
            inner = "".join(parts)
            if not open_:
                return inner
            open_[-1][2].append(_marked(own, inner, places) if nested <= MOST_NESTED or own.tag not in INDENTING else f"\n\n{trim(inner)}\n\n")


def _marked(node: Node, inner: str, places: dict[int, int]) -> str:
    """An element's markdown around that of its children."""
    tag = node.tag
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return f"\n\n{'#' * int(tag[1])} {trim(inner)}\n\n" if trim(inner) else ""
    if tag in ("p", "ul", "ol"):
        return f"\n\n{trim(inner)}\n\n"
    if tag == "li":
        return _item(node, inner, places)
    if tag == "blockquote":
        return "\n\n> " + trim(inner).replace("\n", "\n> ") + "\n\n"
    if tag == "table":
        return f"\n\n<!-- Table content -->\n{inner}\n\n"
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag in ("em", "i"):
        return _inline("*", inner)
    if tag in ("strong", "b"):
        return _inline("**", inner)
    if tag == "a" and node.attrs.get("href"):
        return f"[{inner.strip()}]({node.attrs['href']})"
    if tag == "img":
        return f"![{node.attrs.get('alt', '')}]({node.attrs['src']})" if node.attrs.get("src") else ""
    return f"\n\n{inner}\n\n" if tag in BLOCKS else inner


def tidy(markdown: str) -> str:
    markdown = re.sub("\n{4,}", "\n\n\n", markdown)
    markdown = re.sub("([^\n])\n(#{1,6} )", r"\1\n\n\2", markdown)
    return trim(re.sub("([^\n])\n([*-] )", r"\1\n\n\2", markdown))


def to_markdown(node: Node) -> str:
    """Markdown of what is inside a node."""
    out = _rendered(node)
    fenced = re.split("(\n```.*?\n```\n)", out, flags=re.DOTALL)
    for i in range(0, len(fenced), 2):  # outside of code: no space at the ends of lines, one blank line at most
        fenced[i] = re.sub("\n{3,}", "\n\n", re.sub("(?m)^ +| +$", "", re.sub("(?m)  $", "\0", fenced[i])).replace("\0", "  "))
    return tidy(trim("".join(fenced)))


_HEADING = re.compile(f"^(#{{1,6}}){SPACE}+(.+)$", re.MULTILINE)
_FENCED = re.compile(r"```([A-Za-z0-9_]+)?\n([\s\S]*?)```")
_LIST = re.compile(r"^([*-] .+(?:\n[*-] .+)*)", re.MULTILINE)


def _places(pattern: re.Pattern, text: str):
    """(match, its place in UTF-16 units), in order."""
    at = end = 0
    for m in pattern.finditer(text):
        at, end = at + size(text[end : m.start()]), m.start()
        yield m, at


def structure(markdown: str) -> dict:
    """Headings, code blocks and lists with their places, and counts; an empty text has one (empty) word."""
    return {
        "headings": [{"level": len(m[1]), "text": trim(m[2]), "position": at} for m, at in _places(_HEADING, markdown)],
        "code_blocks": [{"language": m[1] or "text", "content": trim(m[2]), "position": at, "length": size(m[0])} for m, at in _places(_FENCED, markdown)],
        "lists": [{"content": trim(m[1]), "position": at, "item_count": len(re.findall(r"(?m)^[*-] ", m[1]))} for m, at in _places(_LIST, markdown)],
        "word_count": len(pieces(markdown)),
        "character_count": size(markdown),
    }
