"""The perfect binary Golay code [23, 12, 7] as a fuzzy hash.

Every 23-bit word lies within distance 3 of exactly one codeword.  ``fuzzy_keys(word)`` lists the 12-bit indices of all
codewords within distance 4.  If two words differ in at most two bits, some word w lies within one bit of both; the
codeword nearest to w is within 3 of w, hence within 4 of both, so the two lists share a key.  A word at distance 3 from
its codeword has six keys, any nearer one a single key.
"""

from __future__ import annotations

from functools import cache

import numpy as np

GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _remainders() -> np.ndarray:
    """Of x^i modulo the generator, for i in 0..22."""
    out, r = [], 1
    for _ in range(23):
        out.append(r)
        r <<= 1
        if r & 0x800:
            r ^= GENERATOR
    return np.array(out, dtype=np.int64)


def syndrome(words: np.ndarray) -> np.ndarray:
    s = np.zeros(len(words), dtype=np.int64)
    for i, r in enumerate(_remainders()):
        s ^= ((words >> i) & 1) * r
    return s


@cache
def patterns() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: up to six error patterns of weight at most 4, and how many of them there are."""
    rem = _remainders()
    table, count = np.zeros((2048, 6), dtype=np.int64), np.zeros(2048, dtype=np.int64)

    def grow(start: int, left: int, pattern: int, syn: int) -> None:
        table[syn, count[syn]] = pattern
        count[syn] += 1
        if left:
            for i in range(start, 23):
                grow(i + 1, left - 1, pattern | 1 << i, syn ^ int(rem[i]))

    grow(0, 4, 0, 0)
    return table, count


def fuzzy_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word: an array (n, 6) of 12-bit codeword indices, and which of the six are in use."""
    table, count = patterns()
    s = syndrome(words)
    return (words[:, None] ^ table[s]) >> 11, np.arange(6)[None, :] < count[s][:, None]
