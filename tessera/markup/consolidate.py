"""Merging of retrieved chunks of one section that overlap or complete each other."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import lru_cache

from ..functions.text import STRUCTURE_PATTERNS, STRUCTURE_SHARE
from .jsstrings import pieces, size, trim

#: Least overlap in characters; least share of the shorter text; score difference that
#: decides which text is the base; shares of common words for normal and for short texts.
LEAST_OVERLAP, LEAST_SHARE, SCORE_STEP = 30, 0.1, 0.01
COMMON_SHARE, SHORT_COMMON_SHARE, SHORT_WORDS = 0.6, 0.4, 5
EDGE_WORDS, EDGE_LETTERS, JOIN_WORDS, JOIN_LEAST = 3, 3, 10, 2
_STRUCTURE = [re.compile(re.sub(r"\\x\{([0-9A-F]{4})\}", r"\\u\1", p)) for p in STRUCTURE_PATTERNS]
_MARKS = str.maketrans("", "", ".,!?;:")


@dataclass(frozen=True)
class Scored:
    id: str
    text: str
    score: float
    section: str | None = None
    sources: tuple[str, ...] = ()


@lru_cache(maxsize=256)
def is_structural(text: str) -> bool:
    whole = rest = trim(text)
    for pattern in _STRUCTURE:
        rest = trim(pattern.sub("", rest))
    return size(rest) < size(whole) * STRUCTURE_SHARE


def border(left: str, right: str, least: int = 1) -> str:
    """The longest end of ``left`` that ``right`` begins with, if it has ``least`` characters, else ''.

    Only places where the first ``least`` characters of ``right`` occur can begin it.
    """
    most = min(len(left), len(right))
    head, at = right[:least], len(left) - most
    while most >= least and (at := left.find(head, at)) >= 0:
        if right.startswith(left[at:]):
            return left[at:]
        at += 1
    return ""


def common_words(a, b) -> list[str]:
    """The words of a, repeats included, that b has."""
    have = set(b)
    return [w for w in a if w in have]


_pieces = lru_cache(maxsize=256)(pieces)


@lru_cache(maxsize=256)
def _long_words(text: str) -> tuple[str, ...]:
    return tuple(w for w in pieces(text.lower()) if len(w) > 2 or size(w) > 2)


def _candidates(a: str, b: str):
    """Texts that the two may share, in the order in which ties are settled."""
    for own, other in ((a, b), (b, a)):
        if size(own) >= LEAST_OVERLAP and other.startswith(own):
            yield own
            break
    for left, right in ((a, b), (b, a)):
        shared = border(left, right, LEAST_OVERLAP // 2)
        if size(shared) >= LEAST_OVERLAP:
            yield shared
    words = _long_words(a), _long_words(b)
    common = common_words(*words)
    share = SHORT_COMMON_SHARE if max(map(len, words)) <= SHORT_WORDS else COMMON_SHARE
    if len(common) >= 2 and len(common) / min(map(len, words)) > share:
        yield " ".join(common)
    last, first = _pieces(trim(a)), _pieces(trim(b))
    for n in range(1, min(EDGE_WORDS, len(last), len(first)) + 1):
        ends = " ".join(last[-n:]), " ".join(first[:n])
        bare = [e.lower().translate(_MARKS) for e in ends]
        if bare[0] == bare[1] and size(bare[0]) >= EDGE_LETTERS:
            yield ends[0] if size(ends[0]) >= size(ends[1]) else ends[1]


def overlap(a: str, b: str) -> tuple[str, float]:
    """The longest shared text that counts as overlap (empty if none), and its share of the shorter text."""
    best = ""
    for text in _candidates(a, b):
        if size(text) > size(best):
            best = text
    shorter = min(size(a), size(b))
    if size(best) < LEAST_OVERLAP or not shorter:
        return "", 0.0
    return best, size(best) / shorter


def join_words(a: str, b: str) -> str:
    """Two texts joined where the last words of one meet the first words of the other."""
    left, right = pieces(a), pieces(b)
    low_l, low_r = [w.lower() for w in left], [w.lower() for w in right]
    best, place = 0, -1
    for i in range(max(0, len(left) - JOIN_WORDS), len(left)):
        for j in range(min(JOIN_WORDS, len(right))):
            n = 0
            while i + n < len(left) and j + n < len(right) and low_l[i + n] == low_r[j + n]:
                n += 1
            if n >= JOIN_LEAST and n > best:
                best, place = n, i
    if not best:
        return f"{a} {b}"
    rest = " ".join(right[best:])
    return " ".join(left[: place + best]) + (f" {rest}" if rest else "")


def _mean_score(a: Scored, b: Scored) -> float:
    n, m = size(a.text), size(b.text)
    return (a.score * n + b.score * m) / (n + m)


def merge_overlapping(a: Scored, b: Scored) -> Scored:
    apart = a.score - b.score
    swap = apart < 0 if abs(apart) > SCORE_STEP else size(b.text) > size(a.text)
    base, other = (b, a) if swap else (a, b)
    shared, _ = overlap(base.text, other.text)
    text, ids = base.text, [base.id, other.id]
    if not shared:
        ids = [base.id]
    elif text == shared:
        text = other.text
    elif other.text == shared:
        pass
    elif text.endswith(shared) and other.text.startswith(shared):
        rest = trim(other.text[len(shared) :])
        text, ids = (f"{text} {rest}", ids) if rest else (text, [base.id])
    elif text.startswith(shared) and other.text.endswith(shared):
        rest = trim(other.text[: -len(shared)])
        text, ids = (f"{rest} {text}", ids) if rest else (text, [base.id])
    else:
        text = join_words(text, other.text)
    return Scored("consolidated-" + "+".join(ids), trim(text), _mean_score(a, b), base.section, a.sources + b.sources)


def merge_complementary(a: Scored, b: Scored) -> Scored:
    """Structure first, then prose."""
    first, second = (a, b) if is_structural(a.text) else (b, a)
    return Scored(f"consolidated-{first.id}+{second.id}", trim(f"{first.text}\n\n{second.text}"), _mean_score(a, b), first.section, a.sources + b.sources)


def _partner(own: Scored, rest: list[Scored]):
    """(place, merge) of the chunk to merge with, or None."""
    best, share = None, 0.0
    for k, other in enumerate(rest):
        got = overlap(own.text, other.text)[1]
        if got > share:
            best, share = k, got
    if share > LEAST_SHARE:
        return best, merge_overlapping
    mine = is_structural(own.text)
    for k, other in enumerate(rest):
        if other.section == own.section and is_structural(other.text) != mine:
            return k, merge_complementary
    return None


def merge_section(chunks: list[Scored]) -> list[Scored]:
    """Passes over the chunks of a section until nothing merges."""
    while len(chunks) > 1:
        left, out = list(chunks), []
        while left:
            own = left.pop(0)
            found = _partner(own, left)
            out.append(found[1](own, left.pop(found[0])) if found else own)
        if len(out) == len(chunks):
            break
        chunks = out
    return chunks


def consolidate(chunks: list[Scored]) -> list[Scored]:
    """All sections merged, by falling score; sections in order of appearance settle ties."""
    sections: dict[str, list[Scored]] = {}
    for c in chunks:
        sections.setdefault(c.section or "root", []).append(replace(c, sources=c.sources or (c.id,)))
    return sorted((m for part in sections.values() for m in merge_section(part)), key=lambda c: -c.score)
