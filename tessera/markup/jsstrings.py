"""String rules of ECMAScript that sizes and ids depend on."""

from __future__ import annotations

import re

SPACES = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = f"[{SPACES}]"
RUN = re.compile(f"{SPACE}+")


def size(text: str) -> int:
    """Length in UTF-16 units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le", "surrogatepass")) // 2


def trim(text: str) -> str:
    return text.strip(SPACES)


def pieces(text: str) -> list[str]:
    """Split at runs of white space; ends can be empty."""
    return RUN.split(text)
