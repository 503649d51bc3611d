"""Markdown to blocks to heading-aware, overlapping chunks of bounded size.

``compat`` keeps two quirks that ids and texts of an existing store depend on: a sentence cut drops
its terminator, and sentences of a long paragraph are put together again without a space.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from ..functions.hashing import chunk_id_of
from ..functions.text import DEFAULT_RATIO, TOKEN_RATIOS
from .jsstrings import SPACE, pieces, size, trim

DEFAULT_TOKENS, DEFAULT_OVERLAP = 512, 15
LEAST_BUDGET, NEW_SECTION_SHARE = 0.7, 0.1
SENTENCE_SLACK, WORD_SLACK = 1.3, 1.2

_HEADING = re.compile(f"(#{{1,6}}){SPACE}+(.+)")
_FENCE = re.compile(r"```([A-Za-z0-9_]+)?")
_ITEM = re.compile(f"(?:[-*]|[0-9]+\\.){SPACE}+")
#: Abbreviations whose dot ends no sentence.
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "Sr", "Jr", "Ph.D", "M.D", "B.A", "M.A", "U.S", "U.K", "etc", "vs", "i.e", "e.g", "cf", "al"]
_SHORT = re.compile("(?:" + "|".join(map(re.escape, ABBREVIATIONS)) + r")\.", re.IGNORECASE)
_STOP = re.compile(f"[.!?]+(?={SPACE}+[A-Z])")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    kind: str
    position: int
    splits: bool


@dataclass
class Chunk:
    text: str
    path: tuple[str, ...]
    overlap: int = 0
    tokens: int = 0
    id: str = ""
    blocks: list[Block] = field(default_factory=list)


def tokens(text: str, kind: str | None = None) -> int:
    return math.ceil(size(text) / TOKEN_RATIOS.get(kind, DEFAULT_RATIO))


def budget(most_tokens: int, overlap: float) -> int:
    """Tokens of a chunk before the overlap is put in front of it."""
    return max(most_tokens - math.ceil(most_tokens * (overlap / 100)), math.ceil(most_tokens * LEAST_BUDGET))


def sentences(text: str, compat: bool = True) -> list[str]:
    """Cut before white space and a capital, but not after an abbreviation."""
    safe = [m.span() for m in _SHORT.finditer(text)]
    out, begin, s = [], 0, 0
    for m in _STOP.finditer(_masked(text, safe)):
        cut = m.start() if compat else m.end()
        out.append(text[begin:cut])
        begin = m.end()
        s += 1
    out.append(text[begin:])
    return [t for t in map(trim, out) if t]


def _masked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with other signs in place of the abbreviations, so that no cut falls in one."""
    parts, at = [], 0
    for a, b in spans:
        parts += [text[at:a], "<" * (b - a)]
        at = b
    return "".join([*parts, text[at:]])


def blocks(markdown: str, structured: bool = True) -> list[Block]:
    """Typed blocks with the headings above them. Without structure the text is one block."""
    if not structured:
        return [Block(markdown, (), "other", 0, True)]
    lines = markdown.split("\n")
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += size(line) + 1
    out: list[Block] = []
    path: tuple[str, ...] = ()

    def gather(i: int, belongs, over_blank: bool) -> tuple[list[str], int]:
        """Lines from i on that belong, and the first line after them."""
        got, j = [lines[i]], i + 1
        while j < len(lines):
            if belongs(lines[j]):
                got.append(lines[j])
            elif trim(lines[j]):
                break
            elif not over_blank:
                return got, j + 1
            j += 1
        return got, j

    i = 0
    while i < len(lines):
        line = lines[i]
        bare = trim(line)
        if not bare:
            i += 1
        elif m := _HEADING.fullmatch(line):
            path = (*path[: len(m[1]) - 1], trim(m[2]))
            i += 1
        elif _FENCE.fullmatch(line):
            end = next((j for j in range(i + 1, len(lines)) if lines[j].startswith("```")), None)
            closed = end is not None
            out.append(Block("\n".join(lines[i : end + 1 if closed else None]), path, "code" if closed else "paragraph", starts[i], not closed))
            i = end + 1 if closed else len(lines)
        elif _ITEM.match(line):
            got, j = gather(i, _ITEM.match, True)
            out.append(Block("\n".join(got), path, "list", starts[i], False))
            i = j
        elif bare.startswith("|") and bare.endswith("|"):
            got, j = gather(i, lambda t: "|" in t, False)
            out.append(Block("\n".join(got), path, "table", starts[i], False))
            i = j
        elif bare.startswith(">"):
            got, j = gather(i, lambda t: trim(t).startswith(">"), True)
            out.append(Block("\n".join(got), path, "blockquote", starts[i], False))
            i = j
        else:
            out.append(Block(line, path, "paragraph", starts[i], True))
            i += 1
    return out


def split_block(block: Block, most: int, compat: bool = True) -> list[Block]:
    """A long block as packs of whole sentences."""
    packs, room = [[]], 0
    for s in sentences(block.text, compat):
        n = tokens(s, block.kind)
        if packs[-1] and room + n > most:
            packs.append([])
            room = 0
        packs[-1].append(s)
        room += n
    joined = [trim(("" if compat else " ").join(p)) for p in packs]
    out = [Block(t, block.path, block.kind, block.position, block.splits) for t in joined if t]
    return out or [block]


def group(found: list[Block], most: int, compat: bool = True) -> list[Chunk]:
    """Greedy packing of blocks that keeps top-level sections apart."""
    out: list[Chunk] = []
    held: list[Block] = []
    room, path = 0, ()

    def close(next_path):
        nonlocal held, room, path
        if held:
            head = f"# {' > '.join(path)}\n\n" if path else ""
            out.append(Chunk(head + trim("\n\n".join(b.text for b in held)), path))
        held, room, path = [], 0, next_path

    for block in found:
        n = tokens(block.text, block.kind)
        apart = bool(path and block.path) and (path[0] != block.path[0] or (path != block.path and room >= most * NEW_SECTION_SHARE))
        if not held or room + n > most or apart:
            close(block.path)
        if n > most and block.splits:
            for part in split_block(block, most, compat):
                m = tokens(part.text, part.kind)
                if held and room + m > most:
                    close(part.path)
                held.append(part)
                room += m
        else:
            held.append(block)
            room += n
    close(())
    return out


def tail(text: str, target: int, compat: bool = True) -> str:
    """About ``target`` tokens from the end of a text: whole sentences, else whole words."""
    if target == 0:
        return ""
    goal = target * DEFAULT_RATIO
    for parts, glue, slack in ((sentences(text, compat), ". " if compat else " ", SENTENCE_SLACK), ([w for w in pieces(text) if w], " ", WORD_SLACK)):
        taken, length = [], 0
        for part in reversed(parts):
            more = length + size(part) + (size(glue) if taken else 0)
            if more > goal * slack:
                break
            taken.append(part)
            length = more
            if math.ceil(length / DEFAULT_RATIO) >= target:
                break
        got = trim(glue.join(reversed(taken)))
        if got:
            return got
    return ""


def chunk(markdown: str, url: str, most_tokens: int = DEFAULT_TOKENS, overlap: float = DEFAULT_OVERLAP, structured: bool = True, compat: bool = True) -> list[Chunk]:
    """All chunks of a document in order, with ids; none for a blank document."""
    if not markdown or not trim(markdown):
        return []
    found = group(blocks(markdown, structured), budget(most_tokens, overlap), compat)
    out = []
    for i, c in enumerate(found):
        text, taken = c.text, ""
        if i and overlap and c.path and found[i - 1].path and c.path[0] == found[i - 1].path[0]:
            taken = tail(found[i - 1].text, math.ceil(tokens(text) * (overlap / 100)), compat)
            text = f"{taken}\n\n{text}" if taken else text
        out.append(Chunk(trim(text), c.path, tokens(taken), tokens(text), chunk_id_of(url, list(c.path), text)))
    return out
