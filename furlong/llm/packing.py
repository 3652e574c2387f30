"""Best-fit packing with certificates: bounds by dual-feasible functions, exchange, repacking."""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm import textcodes as X
from furlong.llm.bpe import Seen
from furlong.llm.common import cut

CAPACITY = 2048
#: Distinct pre-tokens whose ids a worker remembers, about 45 MB; beyond that it starts anew.
REMEMBERED = 600_000
#: Ends every document.
END_ID = 0


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    # A task has one core; threads of the library would only take turns on it.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


@cache
def _seen(path: str) -> Seen:
    """What this worker has looked up with the tokenizer of ``path``."""
    return Seen(REMEMBERED)


@cache
def _added(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """What splits a text at the file's added tokens (they stay as every second part), and their ids."""
    ids = {t.content: i for i, t in _tokenizer(path).get_added_tokens_decoder().items()}
    longest_first = sorted(ids, key=len, reverse=True)
    return (re.compile(f"({'|'.join(map(re.escape, longest_first))})") if ids else None), ids


def _split_encode(texts: list[str], path: str, encode: Callable) -> tuple[np.ndarray, np.ndarray]:
    """``encode`` on the texts between added tokens: ids of all texts, joined, and where each text's start (with the end)."""
    pattern, added = _added(path)
    if pattern is None or not any(t in x for x in texts for t in added):
        return encode(texts)
    parts = [pattern.split(x) for x in texts]
    ids, bounds = encode([x for own in parts for x in own[::2]])
    out, ends, k = [], [0], 0
    for own in parts:
        n = 0
        for j, x in enumerate(own):
            if j % 2:
                out.append(np.array([added[x]], dtype=ids.dtype))
            else:
                out.append(ids[bounds[k] : bounds[k + 1]])
                k += 1
            n += len(out[-1])
        ends.append(ends[-1] + n)
    return np.concatenate(out), np.array(ends, dtype=np.int64)


def tokenised_pieces(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> DataFrame:
    """Pieces of every text: doc_id, piece, start, length, ids (little-endian unsigned 32-bit, binary).

    A document is its token ids and then END_ID; only longer ones are cut, so that all pieces
    but the first hold ``capacity`` tokens. The tokenizer's added tokens, such as <|endoftext|>, keep
    their own ids where a text holds them. Pre-tokens are looked up once each; the library
    encodes those not seen before by the worker. Null texts count as empty: one piece with END_ID.
    Repeated rows are cut one by one, other columns are ignored, an empty table gives an empty result.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, seen = _tokenizer(tokenizer_path), _seen(tokenizer_path)
        miss = lambda tokens: [e.ids for e in library.encode_batch_fast(tokens, add_special_tokens=False)]
        for batch in rows:
            for at, held in X.batches(batch.column(1)):
                ids, bounds = _split_encode(held, tokenizer_path, lambda x: seen.encode(x, miss))
                index, piece, start, length, out = [], [], [], [], []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    own = np.append(ids[a:b], END_ID).astype("<u4")
                    n = -(-len(own) // capacity)
                    edges = [0, *range(len(own) - (n - 1) * capacity, len(own) + 1, capacity)]
                    for k in range(n):
                        index.append(at + i)
                        piece.append(k)
                        start.append(edges[k])
                        length.append(edges[k + 1] - edges[k])
                        out.append(own[edges[k] : edges[k + 1]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(index, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(out, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids binary")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of each size, and the bins' loads; each goes where the least room is left."""
    where, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    loads: list[int] = []
    rooms: list[tuple[int, int]] = []  # (room, bin), sorted
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = bisect_left(rooms, (size, -1))
        if k < len(rooms):
            room, b = rooms.pop(k)
        else:
            room, b = capacity, len(loads)
            loads.append(0)
        where[i], offset[i] = b, loads[b]
        loads[b] += size
        if room > size:
            insort(rooms, (room - size, b))
    return where, offset, loads


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing has fewer bins: the best of two families of dual-feasible functions.

    A function u with sum(u(x)) <= 1 for all x that fit one bin bounds the bins by the sum of
    u over all sizes. Used are x itself, x with small sizes dropped and large ones raised to a
    whole bin, and the staircases floor((k + 1) x) / k, exact where (k + 1) x is whole.
    """
    if not len(sizes):
        return 0
    sizes = np.sort(sizes.astype(np.int64))
    sums = np.concatenate([[0], np.cumsum(sizes)])
    best = -(-int(sums[-1]) // capacity)
    low = np.unique(sizes[2 * sizes <= capacity])
    big = len(sizes) - np.searchsorted(sizes, capacity - low, side="right")
    middle = sums[len(sizes) - big] - sums[np.searchsorted(sizes, low)]
    if len(low):
        best = max(best, int((big + -(-middle // capacity)).max()))
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        # In units of 1 / (k * capacity), so that nothing is rounded.
        value = np.where(scaled % capacity == 0, k * sizes, scaled // capacity * capacity)
        best = max(best, -(-int(value.sum()) // (k * capacity)))
    return best


def pack(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY, per_partition: int = 8000, full_percent: float = 99.8) -> DataFrame:
    """``pieces`` (``keys`` and ``length``) with sequence_id, offset, and the certificate of their partition.

    Pieces are dealt to partitions of about ``per_partition`` by a hash; each is packed by
    best-fit decreasing and its bin count compared with its lower bound. Partitions whose
    count equals the bound are certified: their bins are final, but for the emptiest if it is
    under ``full_percent``. These, and all bins under ``full_percent`` of the other partitions, are
    exchanged: their pieces are dealt anew to fewer partitions and packed again, as long as that
    takes fewer bins, so that the gap to the bound falls; else they stay as they were.

    ``part`` numbers the partition that made the sequence, ``bins`` and ``bound`` are its count and
    lower bound when it was packed, exchanged bins included. Pieces of ``capacity`` are sequences and
    partitions of their own from the start, with negative numbers.
    Keys need not be unique: a row number tells repeated rows apart. An empty table gives an empty
    result. Only ``keys`` and ``length`` are read, so other columns cannot clash.
    """
    rows = cut(pieces.select(*keys, "length", F.monotonically_increasing_id().alias("row")))
    named = [*keys, "length", "sequence_id", "offset", "part", "bins", "bound"]
    own, one = (-1 - F.col("row")), F.lit(1).cast("long")
    done = [
        rows.where(F.col("length") >= capacity)
        .withColumns({"sequence_id": own, "offset": F.lit(0).cast("long"), "part": own, "bins": one, "bound": one})
        .select(*named)
    ]
    open_ = rows.where(F.col("length") < capacity)
    schema = f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, part int, bin long, offset long, bins long, bound long, closed boolean"

    def bins(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True])
        sizes = pdf["length"].to_numpy()
        where, offset, loads = best_fit_decreasing(sizes, capacity)
        loads, bound = np.array(loads, dtype=np.int64), lower_bound(sizes, capacity)
        closed = 100 * loads >= full_percent * capacity
        if len(loads) == bound:
            emptiest = int(loads.argmin())
            closed = closed | (np.arange(bound) != emptiest)
        return pdf.assign(bin=where, offset=offset, bins=len(loads), bound=bound, closed=closed[where])

    def finished(packed: DataFrame, r: int) -> DataFrame:
        part = F.lit(r).cast("long") * (1 << 31) + F.col("part")
        return packed.select(*keys, "length", (part * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset", part.alias("part"), "bins", "bound")

    first = (F.col("offset") == 0) & (F.col("length") > 0)  # one piece of each bin
    waiting, waiting_bins, parts = None, None, 1 << 31
    n, r = open_.count(), 0
    while n:
        # Later rounds pack what is left in fewer, larger partitions, of a size that one task holds.
        parts = min(parts, -(-n // (per_partition << min(r, 4))))
        dealt = open_.withColumn("part", F.pmod(F.xxhash64("row", F.lit(r)), F.lit(parts)).cast("int"))
        packed = cut(dealt.groupBy("part").applyInPandas(bins, schema))
        total, left, n = packed.agg(F.count_if(first), F.count_if(first & ~F.col("closed")), F.count_if(~F.col("closed"))).first()
        if waiting is not None and total >= waiting_bins:
            break
        done.append(finished(packed.where("closed"), r))
        waiting, waiting_bins = finished(packed.where("not closed"), r), left
        open_ = packed.where("not closed").select(*keys, "length", "row")
        n, r = (n if left > 1 else 0), r + 1
    if waiting is not None:
        done.append(waiting)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
