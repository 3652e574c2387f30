"""Whole batches of texts as code point arrays: words, pre-tokens and their hashes in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa

ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}

#: Code points of text that are worked on at once; one longer text is a batch of its own.
BATCH_CHARS = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def batches(texts: Iterable[str | None] | pa.Array, limit: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) of runs of texts with about ``limit`` code points; null is empty.

    An Arrow array is turned into strings a few rows at a time, so that no second copy of it is held.
    """
    if isinstance(texts, pa.Array):
        whole = texts
        texts = (t for k in range(0, len(whole), 64) for t in whole.slice(k, 64).to_pylist())
    start, held, n = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and n + len(t) > limit:
            yield start, held
            start, held, n = i, [], 0
        held.append(t)
        n += len(t)
    if held:
        yield start, held


def codes(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined text, its code points and where each text starts (with the end)."""
    whole = "".join(texts)
    c = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return whole, c, starts


def lower_ascii(c: np.ndarray) -> np.ndarray:
    return np.where((c >= 65) & (c <= 90), c + np.uint32(32), c)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 2 * BATCH_CHARS)
        for name, base in (("up", ODD), ("down", _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


@cache
def _mixed() -> np.ndarray:
    """``mix`` of every code point (9 MB), so that a text takes one look-up for each."""
    return mix(np.arange(0x110000, dtype=np.uint64) + ODD)


def prefix_sums(c: np.ndarray) -> np.ndarray:
    """Running polynomial sums (modulo 2**64) of the code points, for ``span_hash``."""
    up, _ = _powers(len(c) + 1)
    sums = np.zeros(len(c) + 1, dtype=np.uint64)
    np.cumsum(_mixed()[c] * up[: len(c)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's code points; equal spans hash equal wherever they stand."""
    _, down = _powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hash(h: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive numbers of ``h``; equal windows hash equal wherever they stand."""
    up, down = _powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(mix(h + ODD) * up[: len(h)], out=sums[1:])
    n = max(0, len(h) - size + 1)
    return mix((sums[size : size + n] - sums[:n]) * down[:n])


def words(c: np.ndarray, starts: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the maximal runs without ``blank`` inside each text."""
    inside = np.zeros(len(c) + 1, dtype=bool)
    inside[: len(c)] = ~blank
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = starts[1:-1]
    first[cuts] = inside[cuts]
    begin = np.flatnonzero(first)
    stop = ~inside
    stop[1:] &= inside[:-1]
    ends = np.zeros(len(c) + 1, dtype=bool)
    ends |= stop
    ends[0] = False
    inner = cuts[(cuts > 0)]
    ends[inner] |= inside[inner - 1]
    end = np.flatnonzero(ends)
    return begin, end, np.searchsorted(starts, begin, side="right") - 1


def white(c: np.ndarray) -> np.ndarray:
    """The blank and the code points 9 to 13."""
    return (c == 32) | ((c >= 9) & (c <= 13))
