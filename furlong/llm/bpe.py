"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm import textcodes as X
from furlong.llm.pretokens import spans

#: Distinct pre-tokens whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 400_000


class PerfectHash:
    """Minimal perfect hash of 64-bit keys: a displacement for each bucket sends its keys to free places.

    Keys of other pre-tokens also land somewhere, so the key stored at a place decides.
    """

    def __init__(self, keys: np.ndarray) -> None:
        n = len(keys)
        self.n, self.n_buckets = n, max(1, n // 4)
        self.shift = np.zeros(self.n_buckets, dtype=np.uint64)
        self.keys = np.zeros(n, dtype=np.uint64)
        self.value = np.zeros(n, dtype=np.int64)
        taken = np.zeros(n, dtype=bool)
        bucket = (keys % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        tries = np.arange(1, 33, dtype=np.uint64)
        for b in np.argsort(-np.diff(cuts), kind="stable"):
            own = order[cuts[b] : cuts[b + 1]]
            if not len(own):
                break
            base = np.uint64(0)
            while True:
                places = (X.mix(keys[own][None, :] ^ ((tries + base) * X.ODD)[:, None]) % np.uint64(n)).astype(np.int64)
                free = ~taken[places].any(axis=1)
                if len(own) > 1:
                    s = np.sort(places, axis=1)
                    free &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if free.any():
                    k = int(free.argmax())
                    break
                base += np.uint64(len(tries))
            self.shift[b] = tries[k] + base
            taken[places[k]] = True
            self.keys[places[k]], self.value[places[k]] = keys[own], own

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key as it was given, or -1."""
        d = self.shift[(keys % np.uint64(self.n_buckets)).astype(np.int64)]
        place = (X.mix(keys ^ (d * X.ODD)) % np.uint64(self.n)).astype(np.int64)
        return np.where(self.keys[place] == keys, self.value[place], -1)


class KeyNumbers:
    """Numbers 0, 1, ... for 64-bit keys as they are added: a hash table in two arrays, 20 to 40 bytes a key."""

    def __init__(self) -> None:
        self.n = 0
        self._clear(1 << 12)

    def _clear(self, size: int) -> None:
        self.keys, self.number = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int32)

    def _first_place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Where each key is sought first, by what step it goes on, and the mask of places."""
        mask = len(self.keys) - 1
        return (keys & np.uint64(mask)).astype(np.int64), (keys >> np.uint64(40)).astype(np.int64) | 1, mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        at, step, mask = self._first_place(keys)
        left = np.arange(len(keys))
        while len(left):
            number = self.number[at]
            same = (self.keys[at] == keys) & (number >= 0)
            out[left[same]] = number[same]
            on = np.flatnonzero((number >= 0) & ~same)
            keys, left, step = keys[on], left[on], step[on]
            at = (at[on] + step) & mask
        return out

    def add(self, keys: np.ndarray) -> None:
        """Number distinct keys that have none."""
        size, n = len(self.keys), self.n + len(keys)
        numbers = np.arange(self.n, n, dtype=np.int32)
        if 5 * n > 3 * size:
            while 5 * n > 3 * size:
                size *= 2
            held = self.number >= 0
            keys, numbers = np.concatenate([self.keys[held], keys]), np.concatenate([self.number[held], numbers])
            self._clear(size)
        self.n = n
        at, step, mask = self._first_place(keys)
        while len(keys):
            free = self.number[at] < 0
            self.number[at[free]] = numbers[free]
            got = self.number[at] == numbers  # of several keys for a free place one gets it
            self.keys[at[got]] = keys[got]
            keys, numbers, step = keys[~got], numbers[~got], step[~got]
            at = (at[~got] + step) & mask


def _append(held: np.ndarray, n: int, new: np.ndarray) -> np.ndarray:
    """``held`` with ``new`` behind its first n values, in a longer copy where it is full."""
    if n + len(new) > len(held):
        held = np.concatenate([held[:n], np.empty(n // 2 + len(new), dtype=held.dtype)])
    held[n : n + len(new)] = new
    return held


def _places(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of the counts, joined."""
    ends = np.cumsum(counts)
    return np.repeat(first - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


class Seen:
    """Ids of pre-tokens that a worker has met, at most about ``limit`` of them."""

    def __init__(self, limit: int) -> None:
        self.limit, self.whole_rank = limit, getattr(self, "whole_rank", np.empty(0, dtype=np.uint32))
        self._forget()

    def _forget(self) -> None:
        self.seen = KeyNumbers()
        #: Where the ids of each number start, and behind the last one the end.
        self.first, self.ids = np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.uint32)

    def _remember(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        n, end = self.seen.n, int(self.first[self.seen.n])
        self.seen.add(keys)
        self.first = _append(self.first, n + 1, end + np.cumsum(counts))
        self.ids = _append(self.ids, end, ids)

    def encode(self, texts: list[str], miss: Callable, find: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, joined, and where each text's ids start (with the end).

        ``find`` gives numbers in ``whole_rank`` of hashed pre-tokens, or -1; ``miss`` turns a list of other
        pre-tokens into lists of ids, once each as long as they are remembered.
        """
        whole, c, starts = X.codes(texts)
        begin = spans(c, starts)
        end = np.append(begin[1:], len(c)).astype(np.int64)
        keys = X.span_hash(X.prefix_sums(c), begin, end)
        distinct, which = np.unique(keys, return_inverse=True)
        sample = np.empty(len(distinct), dtype=np.int64)
        sample[which] = np.arange(len(which))  # any of the equal ones
        known = find(distinct) if find else np.full(len(distinct), -1)
        if self.seen.n > self.limit:
            self._forget()
        missed, hits = np.flatnonzero(known < 0), np.flatnonzero(known >= 0)
        slot = self.seen.find(distinct[missed])
        lost = np.flatnonzero(slot < 0)
        if len(lost):
            at = sample[missed[lost]]
            found = miss([whole[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
            slot[lost] = np.arange(self.seen.n, self.seen.n + len(lost))
            counts = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum()))
            self._remember(distinct[missed[lost]], ids, counts)
        # Ids of distinct pre-tokens: those of the perfect hash first, then what is remembered.
        n_own = np.ones(len(distinct), dtype=np.int64)
        n_own[missed] = self.first[slot + 1] - self.first[slot]
        base = np.zeros(len(distinct), dtype=np.int64)
        base[hits] = np.arange(len(hits))
        base[missed] = len(hits) + np.cumsum(n_own[missed]) - n_own[missed]
        own = np.concatenate([self.whole_rank[known[hits]], self.ids[_places(self.first[slot], n_own[missed])]])
        counts = n_own[which]
        token_of = np.searchsorted(begin, starts)
        bounds = np.concatenate([[0], np.cumsum(counts)])[token_of]
        return own[_places(base[which], counts)], bounds


class Vocabulary(Seen):
    """Ranks of byte strings, with the perfect hash over those that are UTF-8 texts."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = [b""] * (max(self.rank.values()) + 1)
        for b, r in self.rank.items():
            self.bytes[r] = b
        self.byte = [self.rank[bytes([i])] for i in range(256)]
        #: Neighbouring ranks (left << 20 | right) that make a token, and its rank.
        self.joined = {
            self.rank[b[:i]] << 20 | self.rank[b[i:]]: r
            for b, r in self.rank.items()
            for i in range(1, len(b))
            if b[:i] in self.rank and b[i:] in self.rank
        }
        whole = []
        for b, r in self.rank.items():
            try:
                whole.append((b.decode("utf-8"), r))
            except UnicodeDecodeError:
                pass
        _, c, starts = X.codes([t for t, _ in whole])
        self.hash = PerfectHash(X.span_hash(X.prefix_sums(c), starts[:-1], starts[1:]))
        self.whole_rank = np.array([r for _, r in whole], dtype=np.uint32)
        super().__init__(REMEMBERED)

    def merge(self, token: bytes) -> list[int]:
        """Ids of a pre-token: the lowest-ranked neighbours merge first, leftmost among equals."""
        part = [self.byte[b] for b in token]
        n = len(part)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        joined = self.joined.get
        heap = []
        for i in range(n - 1):
            if (r := joined(part[i] << 20 | part[i + 1])) is not None:
                heap.append(r << 32 | i)
        heapify(heap)
        while heap:
            x = heappop(heap)
            r, i = x >> 32, x & 0xFFFFFFFF
            j = right[i]
            if j >= n or joined(part[i] << 20 | part[j]) != r:
                continue  # one of the two has merged since
            part[i], part[j] = r, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (s := joined(r << 20 | part[k])) is not None:
                    heappush(heap, s << 32 | i)
            h = left[i]
            if h >= 0 and (s := joined(part[h] << 20 | r)) is not None:
                heappush(heap, s << 32 | h)
        return [p for p in part if p >= 0]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, joined, and where each text's ids start (with the end)."""
        return self.encode(texts, lambda tokens: [self.merge(t.encode("utf-8", "surrogatepass")) for t in tokens], self.hash.find)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def decode(ids: np.ndarray, path: str) -> bytes:
    names = vocabulary(path).bytes
    return b"".join([names[i] for i in ids.tolist()])


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ``ids`` (little-endian unsigned 32-bit numbers, binary).

    The text is split by the public pattern, each pre-token is encoded by itself, no special
    tokens. Null and empty texts give no ids. ``path`` names the rank file on every machine.
    Repeated rows are encoded one by one; extra columns are ignored; an empty table gives an
    empty result.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in rows:
            for at, held in X.batches(batch.column(1)):
                ids, bounds = v.encode_batch(held)
                ids = ids.astype("<u4")
                out = [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(held)), pa.array(out, pa.binary())], ["doc_id", "ids"]
                )

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids binary")


def decode_ids(df: DataFrame, path: str, out_col: str = "bytes") -> DataFrame:
    """``df`` (doc_id, ids) with the decoded bytes as ``out_col``. Null ids decode to null."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = [None if x is None else decode(np.frombuffer(x, "<u4"), path) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], ["doc_id", "ids", out_col])

    return df.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, ids binary, {out_col} binary")
