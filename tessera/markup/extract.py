"""Extraction of the main text of a page: density, selectors, rendered pages, raw; first that is good enough."""

from __future__ import annotations

import re
from typing import NamedTuple

from . import dom
from .dom import Node
from .jsstrings import RUN, pieces, size, trim
from .markdown import structure, to_markdown

#: Selectors of headings, of content in order of preference, and of what is left out.
HEADINGS = 'h1, h2, h3, h4, h5, h6, .heading, .title, [role="heading"]'
CONTENT = ["main", '[role="main"]', "article", ".post-content", ".entry-content", ".content", "#content"]
RENDERED_CONTENT = [*CONTENT, "#app", "#root", "[data-reactroot]", ".app"]
NOISE = "nav, aside, footer, dialog, .modal, .nav, .menu, .breadcrumb, .sidebar, .footer, .header, .promo, .subscribe, .cookie, .gdpr, .ad, .advertisement"
PAGE_HEADER = "body > header, .site-header, .page-header, .masthead"
NOT_TEXT = ", ".join([
    "img, video, audio, embed, object, iframe, svg, canvas, picture, source, track, map, area",
    'style, link[rel="stylesheet"]',
    "script, noscript",
    "input, select, option, optgroup, datalist, output, progress, meter, button, textarea, fieldset, legend, form",
    'head, meta, base, link:not([rel="stylesheet"])',
    "template, slot",
    "marquee, frame, frameset, noframes, blink, font[color], font[size], center",
])
#: Least characters of a density, a selector and a rendered extraction; excerpt lengths.
LEAST_DENSE, LEAST_SELECTED, LEAST_RENDERED = 500, 100, 500
EXCERPT, LONG_EXCERPT = 200, 300
_CAMEL = re.compile("([α-ωa-z0-9])([Α-ΩA-Z])")
_UNLIKELY = re.compile(r"comment|community|disqus|extra|foot|menu|modal|pager|popup|promo|related|share|sidebar|sponsor|social|widget|cookie", re.IGNORECASE)
_LIKELY = re.compile(r"article|body|content|entry|main|page|post|story|text", re.IGNORECASE)
_SCORED = frozenset("p pre td blockquote section div article li h2 h3".split())


def _squeezed(text: str) -> str:
    return trim(RUN.sub(" ", text))


def _excerpt(text: str, most: int) -> str | None:
    start = trim(text[:most])
    return (start + ("..." if len(text) > most else "")) if start else None


def _headings(node: Node) -> list[str]:
    return [t for t in (trim(h.text()) for h in dom.select(node, HEADINGS)) if t]


def _page(html: str) -> tuple[Node, str | None]:
    root = dom.parse(html)
    page = next((n for n in root.walk() if n.tag == "html"), None)
    return root, (page.attrs.get("lang") or None) if page is not None else None


def _result(node: Node, text: str, method: str, **more) -> dict:
    markdown = to_markdown(node)
    return {"title": None, "text": text, "markdown": markdown, "excerpt": None, "section_paths": [], "structure": structure(markdown), "byline": None, "lang": None, "method": method, "note": None} | more


class _Told(NamedTuple):
    """Of an element's text: length, commas, blanks at its ends, length within links; and whether a scored element is below."""

    length: int = 0
    commas: int = 0
    lead: int = 0
    trail: int = 0
    linked: int = 0
    holds_scored: bool = False

    @property
    def solid(self) -> int:
        """Length without blanks at the ends."""
        return max(0, self.length - self.lead - self.trail)

    def then(self, other: _Told) -> _Told:
        lead = self.lead + other.lead if self.lead == self.length else self.lead
        trail = self.trail + other.trail if other.trail == other.length else other.trail
        return _Told(self.length + other.length, self.commas + other.commas, lead, trail, self.linked + other.linked, self.holds_scored or other.holds_scored)


def _told(root: Node) -> dict[int, _Told]:
    """For each element, by its id, from what its children tell: no text is gone through twice."""
    out: dict[int, _Told] = {}
    for n in root.after_children():
        own = _Told()
        for c in n.children:
            if isinstance(c, str):
                own = own.then(_Told(len(c), c.count(","), len(c) - len(c.lstrip()), len(c) - len(c.rstrip())))
            else:
                said = out[id(c)]
                own = own.then(said._replace(linked=said.linked + (said.length if c.tag == "a" else 0), holds_scored=said.holds_scored or c.tag in _SCORED))
        out[id(n)] = own
    return out


def by_density(html: str) -> dict | None:
    """The element whose paragraphs say most, with its good siblings; None below 500 characters.

    Paragraphs score by commas and length; parents get the whole, grandparents half; link density and
    telling class names weigh in.
    """
    root, lang = _page(html)
    title = next((trim(n.text()) for n in root.walk() if n.tag == "title"), "") or None
    headings = _headings(root) or ([title] if title else [])
    dom.remove(root, NOT_TEXT)
    dom.remove(root, "nav, aside, footer, dialog")
    named = lambda n: f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"
    dom.remove_all([n for n in root.walk() if n.tag not in ("html", "body", "article", "main") and _UNLIKELY.search(named(n)) and not _LIKELY.search(named(n))])
    told = _told(root)
    score: dict[int, list] = {}
    for n in root.walk():
        said = told[id(n)]
        if n.tag not in _SCORED or said.solid < 25 or (n.tag in ("div", "section", "article") and said.holds_scored):
            continue
        own = 1 + said.commas + min(said.length // 100, 3)
        up, share = n.parent, 1.0
        for _ in range(2):
            if up is None or up.tag in ("#root", "html"):
                break
            kept = score.setdefault(id(up), [up, 5.0 if up.tag in ("div", "article", "main") else 0.0])
            kept[1] += own * share
            up, share = up.parent, share / 2
    if not score:
        return None

    def linked(n: Node) -> float:
        return told[id(n)].linked / max(told[id(n)].length, 1)

    best, top = max(((n, s * (1 - linked(n))) for n, s in score.values()), key=lambda x: x[1])
    article = Node("div")
    for c in best.parent.children if best.parent is not None and best.tag != "body" else [best]:
        if c is best or (isinstance(c, Node) and (score.get(id(c), [0, 0.0])[1] >= max(10, top * 0.2) or (c.tag == "p" and told[id(c)].length > 80 and linked(c) < 0.25))):
            article.children.append(c)
    text = _squeezed(article.text())
    if size(text) < LEAST_DENSE:
        return None
    return _result(article, text, "density", title=title, excerpt=_excerpt(text, EXCERPT), section_paths=headings, lang=lang)


def by_selectors(html: str, content: list[str] | None = None, method: str = "selectors") -> dict:
    """The first content element, else the body. The title is read after the head went, so mostly none."""
    root, lang = _page(html)
    for selector in (NOT_TEXT, NOISE, PAGE_HEADER):
        dom.remove(root, selector)
    found = next((n for s in content or CONTENT for n in dom.select(root, s)[:1]), None)
    node = found or next((n for n in root.walk() if n.tag == "body"), root)
    text = _squeezed(_CAMEL.sub(r"\1 \2", node.text()))
    title = trim("".join(n.text() for n in root.walk() if n.tag == "title")) or None
    return _result(node, text, method, title=title, excerpt=_excerpt(text, EXCERPT), section_paths=_headings(node) or _headings(root), lang=lang)


def by_rendered(html: str) -> dict | None:
    """Selectors of application roots over a page that a browser has rendered already; None below 500 characters."""
    out = by_selectors(html, RENDERED_CONTENT, "rendered")
    out["excerpt"] = _excerpt(out["text"], LONG_EXCERPT)
    return out if size(out["text"]) >= LEAST_RENDERED else None


def raw(text: str, title: str | None) -> dict:
    """From text that the native cleaning made. Without structure; its words are counted without empty ones."""
    info = {"headings": [], "code_blocks": [], "lists": [], "word_count": len([w for w in pieces(text) if w]), "character_count": size(text)}
    return {"title": title, "text": text, "markdown": text, "excerpt": _excerpt(text, LONG_EXCERPT), "section_paths": [], "structure": info, "byline": None, "lang": None, "method": "raw", "note": "Content was extracted without structure"}


def extract(html: str | None, clean: str | None = None, title: str | None = None, rendered: str | None = None) -> dict:
    """The first strategy that is good enough; ``clean`` and ``title`` are the native cleaning's, for the last."""
    html = html or ""
    out = by_density(html)
    if out is None:
        selected = by_selectors(html)
        if selected is not None and size(selected["text"]) > LEAST_SELECTED:
            out = selected | {"note": "Content was extracted by selectors"}
    if out is None and rendered:
        out = by_rendered(rendered)
    return out if out is not None else raw(clean or "", title)
