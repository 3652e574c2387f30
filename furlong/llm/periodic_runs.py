"""Periodic runs by block matching: aligned power-of-two blocks, an Aho-Corasick search, exact extension.

A run is a maximal stretch of words with smallest period q and at least ``max(LEAST, COPIES * q)`` words. Periods
from L to 2L - 1 are sought with blocks of L words, L a power of two. Words q apart are equal over at least
(COPIES - 1) * q words of a run, so whole aligned blocks stand there, and each stands again q words on. An
automaton, whose keys are sequences of integers, finds every place of every block; a place counts if it lies L
to 2L - 1 words behind its block, which leaves one block for each place. Neighbouring blocks of one distance form
a chain; chains too short for a run are left, the others are extended word by word to both sides.

A block of 2L words is the sequence of the numbers of its two halves, and the text to search is the numbers of the
blocks of L words found at each place, L places apart. So keys stay short, and one size costs time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from fractions import Fraction
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from furlong.llm import textcodes as X
from furlong.llm.common import named

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run holds so many copies of its period and so many words at least.
COPIES, LEAST = 4, 6
Run = tuple[int, int, int]  # start, length, period


def numbered(words: list[str]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _next_same(ids: np.ndarray) -> np.ndarray:
    """Per word the distance to its next occurrence, or more than any distance in the text."""
    order = np.argsort(ids, kind="stable")
    gap = np.full(len(ids), 2 * len(ids), dtype=np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][same]] = np.diff(order)[same]
    return gap


def _stretches(true: np.ndarray, least: int) -> list[tuple[int, int]]:
    """[start, end) of the maximal stretches of ``least`` true values or more."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], true, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def _matched(distance: np.ndarray | int) -> np.ndarray | int:
    """Words of a run of this period that equal the word one period on, at least."""
    return np.maximum(LEAST, COPIES * distance) - distance


def _doubled(at: np.ndarray, size: int) -> np.ndarray:
    """Per place the number of the aligned block of 2 * ``size`` words that stands there, or 0, from the same for ``size``."""
    blocks, width = len(at) // (2 * size), -(-len(at) // size) + 1
    # Numbers are given to the automaton by bytes, since it searches the branches of a node one after the other.
    n_bytes = (int(at.max()).bit_length() + 7) // 8
    spelt = lambda x: x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - n_bytes :]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for j, key in enumerate(map(tuple, spelt(at[: 2 * size * blocks : size].copy()).reshape(blocks, 2 * n_bytes).tolist())):
        if key not in automaton:
            automaton.add_word(key, j + 1)
    automaton.make_automaton()
    # A row for each remainder of places by ``size``; the zeros at its end are in no key.
    rows = np.zeros((width, size), dtype=np.int64)
    rows.ravel()[: len(at)] = at
    text = tuple(spelt(rows.T.ravel()).ravel().tolist())
    found = np.fromiter(chain.from_iterable(automaton.iter(text)), np.int64).reshape(-1, 2)
    found = found[found[:, 0] % n_bytes == n_bytes - 1]  # the others begin inside a number
    last = found[:, 0] // n_bytes
    out = np.zeros(len(at), dtype=np.int64)
    out[last // width + (last % width - 1) * size] = found[:, 1]
    return out


def _chains(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and distance of the chains of aligned blocks of ``size`` words that stand again ``distance`` words on."""
    kind = at[: len(at) // size * size : size]
    place = np.flatnonzero(at)
    place = place[place >= size]
    block = place // size - 1
    good = kind[block] == at[place]
    block, distance = block[good], place[good] - block[good] * size
    order = np.lexsort((block, distance))
    block, distance = block[order], distance[order]
    cut = np.flatnonzero((np.diff(distance) != 0) | (np.diff(block) != 1)) + 1
    first = np.concatenate(([0], cut))[: len(block)]
    last = np.concatenate((cut, [len(block)]))[: len(first)]
    enough = last - first >= (_matched(distance[first]) - size + 1) // size
    first, last = first[enough], last[enough]
    return block[first] * size, (block[last - 1] + 1) * size, distance[first]


def _extended(ids: np.ndarray, start: int, end: int, distance: int, size: int) -> tuple[int, int]:
    """The maximal stretch around [start, end) whose words equal those ``distance`` on.

    A whole further block would be part of the chain, so either side grows by less than two blocks.
    """
    low, high = max(0, start - 2 * size), min(len(ids) - distance, end + 2 * size)
    left = ids[low:start] != ids[low + distance : start + distance]
    right = ids[end:high] != ids[end + distance : high + distance]
    if left.any():
        low = start - int(np.argmax(left[::-1]))
    if right.any():
        high = end + int(np.argmax(right))
    return low, high


def _pieces(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, largest block) of disjoint pieces of a text outside of which there is no run.

    Over the matched words of a run each word comes again within its period.
    """
    gap, size, held = _next_same(ids), 1, []
    while len(ids) >= max(LEAST, COPIES * size):
        held += [(a, min(len(ids), b + 2 * size - 1), size) for a, b in _stretches(gap < 2 * size, int(_matched(size)))]
        size *= 2
    pieces: list[tuple[int, int, int]] = []
    for a, b, size in sorted(held):
        if pieces and a < pieces[-1][1]:
            a, b, size = pieces[-1][0], max(b, pieces[-1][1]), max(size, pieces[-1][2])
            pieces.pop()
        pieces.append((a, b, size))
    return pieces


def _runs_of(ids: np.ndarray, largest: int) -> set[Run]:
    """The runs of periods below twice ``largest``."""
    at, found, size = ids + 1, set(), 1
    while True:
        start, end, distance = _chains(at, size)
        for s, m, q in [r for r in found if r[1] >= 2 * size]:
            new = (start < s) | (end + distance > s + m) | (distance % q != 0)  # else inside a run of a period that divides it
            start, end, distance = start[new], end[new], distance[new]
        for x, y, d in zip(start.tolist(), end.tolist(), distance.tolist(), strict=True):
            low, high = _extended(ids, x, y, d, size)
            if high - low >= _matched(d):
                found.add((low, high + d - low, d))
        if size == largest:
            return found
        at = _doubled(at, size)
        size *= 2


def runs(ids: np.ndarray) -> list[Run]:
    """(start, length, period) of every run of a text of word numbers, by start, then period."""
    return sorted((a + s, m, q) for a, b, largest in _pieces(ids) for s, m, q in _runs_of(ids[a:b], largest))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


SCHEMA = (
    "n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string,"
    " runs array<struct<start:long,length:long,period:long>>, collapsed string"
)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def text_runs(text: str | None) -> dict:
    """The columns of ``SCHEMA`` for one text."""
    words = WORD.findall(text or "")
    held = runs(numbered(words))
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in held:
        keep[start + period : start + length] = False
    best = min(held, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    return {
        "n_words": len(words), "n_runs": len(held), "start": best[0], "length": best[1], "period": best[2],
        "exponent_milli": 1000 * best[1] // best[2] if held else None,
        "runs_sha256": _digest("".join(f"{s},{m},{q}\n" for s, m, q in held)),
        "runs": [{"start": s, "length": m, "period": q} for s, m, q in held],
        "collapsed": " ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k),
    }


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {c: pa.int64() for c in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")}
    kinds |= {"runs_sha256": pa.string(), "runs": pa.list_(_RUN), "collapsed": pa.string()}
    for batch in batches:
        for at, held in X.batches(batch.column(1), 1 << 20):
            rows = [text_runs(t) for t in held]
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), *columns], ["doc_id", *kinds])


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, its number of words and runs, the run of the greatest exponent (start, length,
    period, exponent_milli: floor of 1000 * length / period), runs_sha256, all ``runs``, and ``collapsed``, the text's words without
    those that a run holds after its first period, joined by one blank.

    A text is judged alone, whole and within one task; nothing is shuffled. Of runs of equal exponent the first, then the one of the
    smaller period is named. Time grows with n log n in the words of a text.

    Null and empty texts have no words and no runs: nulls for the run, an empty ``collapsed``. Repeated rows and null
    ids are judged one by one. Extra columns are ignored. An empty table gives an empty result.
    """
    rows = df.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    return rows.mapInArrow(_run, f"doc_id {dict(rows.dtypes)['doc_id']}, {SCHEMA}")
