"""The binary Golay code (23, 12): fuzzy keys for 23-bit words.

The code is perfect: every word is within 3 bits of one codeword. The keys of a word are the indices
of all codewords within 4 bits: one if the nearest is within 2 bits, else six (the nearest, and the
five of weight 7 around the three wrong bits). Two words that differ in at most 2 bits share a key:
if one is within 2 of its codeword, the other is within 4 of it; if both are 3 away, two of the five
neighbours are shared, since any four points lie in exactly one weight-7 codeword.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the code.
GENERATOR = 0b110001110101
LENGTH, DATA, CHECK = 23, 12, 11


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Check bits of every data word; error patterns to a near codeword by syndrome (6 a row); how many of them count."""
    check = np.array([_remainder(d << CHECK) for d in range(1 << DATA)], dtype=np.int64)
    unit = [_remainder(1 << b) for b in range(LENGTH)]
    patterns: dict[int, list[int]] = {}
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            syndrome = error = 0
            for b in bits:
                syndrome ^= unit[b]
                error |= 1 << b
            patterns.setdefault(syndrome, []).append(error)
    errors = np.zeros((1 << CHECK, 6), dtype=np.int64)
    count = np.zeros(1 << CHECK, dtype=np.int64)
    for syndrome, found in patterns.items():
        count[syndrome] = len(found)
        errors[syndrome, : len(found)] = found
    return check, errors, count


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``words``, 12-bit codeword index) for each key of each 23-bit word."""
    check, errors, count = tables()
    syndrome = check[words >> CHECK] ^ (words & ((1 << CHECK) - 1))
    n = count[syndrome]
    at = np.repeat(np.arange(len(words)), n)
    which = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at, (words[at] ^ errors[syndrome[at], which]) >> CHECK
