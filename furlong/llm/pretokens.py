"""Pre-tokens of whole batches by numpy: the split of ``public_tokenizers.PATTERN`` on code points."""

from __future__ import annotations

from functools import cache

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
APOSTROPHE, BLANK = 39, 32


@cache
def classes() -> np.ndarray:
    """The class of every code point, from the Unicode tables of the ``regex`` module."""
    import regex

    table = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "\0" for i in range(0x110000))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    return table


def spans(c: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the code points ``c`` of texts that start at ``starts``; each ends where the next starts.

    A run of letters, numbers or other marks takes a blank before it; a run of white space
    leaves its last character to what follows; 's 't 're 've 'm 'll 'd stand alone where a
    match can start at the apostrophe.
    """
    n = len(c)
    if not n:
        return np.empty(0, dtype=np.int64)
    kind = classes()[c]
    edge = np.zeros(n + 1, dtype=bool)  # first of a text
    edge[starts] = True
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:])
    first |= edge[:n]
    after = np.flatnonzero(first & (kind != SPACE))
    after = after[after > 0]
    after = after[~edge[after] & (kind[after - 1] == SPACE)]
    first[after - 1] = True
    first[after[c[after - 1] == BLANK]] = False
    at = np.flatnonzero((c == APOSTROPHE) & first)
    if len(at):
        text_end = starts[np.searchsorted(starts, at, side="right")]
        at, text_end = at[at + 1 < text_end], text_end[at + 1 < text_end]
        one, two = c[at + 1], c[np.minimum(at + 2, n - 1)]
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = np.zeros(len(at), dtype=bool)
        for x, y in ("re", "ve", "ll"):
            long |= (one == ord(x)) & (two == ord(y))
        long &= at + 2 < text_end
        first[at[short | long] + 1] = False
        for hit, k in ((short, 2), (long, 3)):
            rest = at[hit] + k
            first[rest[rest < text_end[hit]]] = True
    return np.flatnonzero(first)
