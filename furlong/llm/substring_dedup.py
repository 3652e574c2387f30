"""Substring dedup over suffix trees that are partitioned by variable-length prefixes.

The suffixes of all texts, by words, form one tree. It is cut into subtrees by prefixes: all prefixes of two words are counted, a
prefix with more suffixes than a group may hold is made longer by a word, and neighbouring prefixes fill up groups. A
task builds the subtrees of one group. Windows of ``window`` words are judged, so the tree is truncated at that depth (longer repeats are chains of
windows), a suffix carries one hash of its truncated rest, and the nodes at that depth that two documents or more reach are the repeats.

Suffixes of one batch of texts are merged before they are sent: of those that end in one node only the smallest document's
needs an answer from the other batches, whatever the node's share of all suffixes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm import textcodes as X
from furlong.llm.common import free_name, named, small_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Suffixes of a group and words of a batch of texts, both by what a task's memory holds.
GROUP, BATCH = 1 << 21, 1 << 20
#: Stands for a null id: behind every other.
NO_ID = np.iinfo(np.int64).max


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and the number of words of each text."""
    _, c, starts = X.codes(texts)
    begin, end, text_no = X.words(c, starts, X.white(c))
    return X.span_hash(X.prefix_sums(c), begin, end), np.bincount(text_no, minlength=len(texts))


class Prefixes:
    """Which group a suffix belongs to, by a prefix as long as it has to be. A word counts by the highest byte of its hash.

    tables[0] has an entry for every two bytes, each further table for one more byte: the number of a group, or -1 - k where table k goes on.
    """

    def __init__(self) -> None:
        self.first, self.more, self.depth = np.full(1 << 16, -1, dtype=np.int64), np.empty((0, 256), dtype=np.int64), 2
        self.open = 1

    def groups(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry or group, next byte's place) of the suffixes of ``h`` that start at ``at``."""
        byte = (h >> np.uint64(56)).astype(np.int64)
        entry, place = self.first[(byte[at] << 8) | byte[at + 1]], at + 2
        while len(self.more):
            rows = np.flatnonzero((entry < 0) & (entry >= -len(self.more)))
            if not len(rows):
                break
            entry[rows] = self.more[-1 - entry[rows], byte[place[rows]]]
            place[rows] += 1
        return entry, place


def _suffixes(batches: Iterator[pa.RecordBatch], window: int, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, word hashes, words per row, starts of suffixes of ``window`` words or more) of about ``most`` words at a time; the text is column 2."""
    held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

    def joined():
        rows = pa.Table.from_batches([x[0] for x in held]).combine_chunks().to_batches()[0]
        h, n = (np.concatenate([x[i] for x in held]) for i in (1, 2))
        ends = np.repeat(np.cumsum(n), n)
        return rows, h, n, np.flatnonzero(np.arange(len(h)) + window <= ends)

    words = 0
    for batch in batches:
        for at, texts in X.batches(batch.column(2)):
            h, n = _word_hashes(texts)
            held.append((batch.slice(at, len(texts)).select([0, 1]), h, n))
            words += len(h)
            if words >= most:
                yield joined()
                held, words = [], 0
    if held:
        yield joined()


def _counted(prefixes: Prefixes | None, window: int, batch: int) -> Callable:
    """Counts of suffixes by cell: the first two bytes or, once there are ``prefixes``, open entries and their next byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16 if prefixes is None else 256 * prefixes.open, dtype=np.int64)
        for _, h, _, at in _suffixes(batches, window, batch):
            byte = (h >> np.uint64(56)).astype(np.int64)
            if prefixes is None:
                cell = (byte[at] << 8) | byte[at + 1]
            else:
                entry, place = prefixes.groups(h, at)
                still = entry < 0
                cell = ((-1 - entry[still] - len(prefixes.more)) << 8) | byte[place[still]]
            total += np.bincount(cell, minlength=len(total))
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[cell])], ["cell", "n"])

    return run


def choose_prefixes(rows: DataFrame, window: int, least_groups: int, group: int = GROUP, batch: int = BATCH) -> tuple[Prefixes, int]:
    """Prefixes that split the suffixes of ``rows`` into groups of about equal size, at most about ``group``, and the number of groups.

    The driver holds one entry for each prefix that is counted: some hundreds for each group at most.
    """

    def count(prefixes: Prefixes | None) -> np.ndarray:
        size = 1 << 16 if prefixes is None else 256 * prefixes.open
        found = rows.mapInArrow(_counted(prefixes, window, batch), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        n = np.zeros(size, dtype=np.int64)
        n[[r.cell for r in found]] = [r.n for r in found]
        return n

    prefixes, counts = Prefixes(), count(None)
    most = max(1, min(group, -(-int(counts.sum()) // least_groups)))
    sizes = [counts]  # of each table's entries
    large = np.flatnonzero(counts > most)[: None if window > 2 else 0]
    prefixes.first[:] = 0
    prefixes.first[large] = -1 - np.arange(len(large))
    while len(large) and prefixes.depth < window:
        prefixes.open = len(large)
        counts = count(prefixes)
        large = np.flatnonzero(counts > most) if prefixes.depth + 1 < window else large[:0]
        new = np.zeros(len(counts), dtype=np.int64)
        new[large] = -1 - (len(prefixes.more) + prefixes.open) - np.arange(len(large))
        prefixes.more = np.concatenate((prefixes.more, new.reshape(-1, 256)))
        sizes.append(counts)
        prefixes.depth += 1
    prefixes.open = 0
    # Neighbouring entries share a group until it is full.
    entries, sizes = np.concatenate((prefixes.first, prefixes.more.ravel())), np.concatenate(sizes)
    leaf = entries >= 0
    entries[leaf] = (np.cumsum(sizes[leaf]) - sizes[leaf]) // most
    prefixes.first, prefixes.more = entries[: 1 << 16], entries[1 << 16 :].reshape(-1, 256)
    return prefixes, int(entries.max()) + 1


def _planes(x: np.ndarray, width: int = 4) -> bytes:
    """Numbers of ``width`` bytes, the low bytes of all before the higher ones: runs of zeros for the shuffle's compression."""
    return x.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _from_planes(raw: bytes, width: int = 4) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.copy().view(f"<i{width}").ravel().astype(np.int64)


#: Bytes of a node's hash that are sent.
NODE = 7
PARTS = ["part", "batch", "ids", "keys", "counts", "places", "nodes"]


def _part(rows: np.ndarray, words: np.ndarray, place: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> tuple:
    """Suffixes by ascending row and place in the row: the rows' ids, keys, numbers of suffixes and of words, and the suffixes' places."""
    held, counts = np.unique(rows, return_counts=True)
    words = words[held]
    ahead = np.repeat(np.cumsum(words) - words, counts)  # rows one behind the other, so that places ascend
    return _planes(ids[held], 8), _planes(keys[held]), _planes(np.concatenate((counts, words))), _planes(np.diff(place + ahead, prepend=0))


def _read_part(ids: bytes, keys: bytes, counts: bytes, places: bytes) -> tuple[np.ndarray, ...]:
    """Id, key and words of each row; row and place of each suffix."""
    ids, keys = _from_planes(ids, 8), _from_planes(keys)
    n, words = _from_planes(counts).reshape(2, -1)
    return ids, keys, words, np.repeat(np.arange(len(n)), n), np.cumsum(_from_planes(places)) - np.repeat(np.cumsum(words) - words, n)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], PARTS)


def _sent(prefixes: Prefixes, n_groups: int, window: int, batch: int) -> Callable:
    """Per batch of texts and group a row with the suffixes whose node no smaller document of the batch reaches, and one row without nodes for the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, (rows, h, n, at) in enumerate(_suffixes(batches, window, batch)):
            if not len(at):
                continue
            number += TaskContext.get().partitionId() << 32
            ids, keys = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            of = np.repeat(np.arange(len(n)), n)[at]
            place = at - (np.cumsum(n) - n)[of]
            end = X.window_hash(h, window)[at]
            # By node, then document, row and place; of a row that reaches a node more than once the first suffix stands for all.
            order = np.lexsort((ids[of], end))
            node, row = end[order], of[order]
            new_node = np.concatenate(([True], node[1:] != node[:-1]))
            first = new_node | np.concatenate(([True], row[1:] != row[:-1]))
            order, row, new_node = order[first], row[first], new_node[first]
            least = ids[row[np.flatnonzero(new_node)]][np.cumsum(new_node) - 1]
            known = ids[row] > least
            if known.any():
                chosen = np.sort(order[known])
                yield _table([(number % n_groups, number, *_part(of[chosen], n, place[chosen], ids, keys), b"")])
            asked = np.sort(order[~known])
            group, _ = prefixes.groups(h, at[asked])
            asked, group = asked[np.argsort(group, kind="stable")], np.sort(group)
            cuts = np.flatnonzero(np.diff(group)) + 1
            sent = np.ascontiguousarray(end.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NODE])
            for chosen, g in zip(np.split(asked, cuts), group[np.concatenate(([0], cuts))].tolist(), strict=True):
                yield _table([(g, number, *_part(of[chosen], n, place[chosen], ids, keys), sent[chosen].tobytes())])

    return run


def _repeats(table: pa.Table) -> pa.Table:
    """Of one group's rows, per batch of texts the suffixes whose node a document with a smaller id reaches."""
    out, asked = [], []
    for row in zip(*(table.column(c).to_pylist() for c in PARTS), strict=True):
        (asked if row[-1] else out).append(row)
    if asked:
        read = [_read_part(*row[2:6]) for row in asked]
        ids = np.concatenate([x[0][x[3]] for x in read])
        nodes = np.zeros((len(ids), 8), dtype=np.uint8)
        nodes[:, :NODE] = np.frombuffer(b"".join(row[-1] for row in asked), np.uint8).reshape(-1, NODE)
        nodes = nodes.view("<u8").ravel()
        order = np.argsort(nodes)
        nodes, by_node = nodes[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], nodes[1:] != nodes[:-1])))
        least = np.repeat(np.minimum.reduceat(by_node, first), np.diff(np.append(first, len(nodes))))
        later = np.zeros(len(ids), dtype=bool)
        later[order[by_node > least]] = True
        ends = np.cumsum([len(x[3]) for x in read])
        for row, (own_ids, keys, words, of, place), found in zip(asked, read, np.split(later, ends[:-1]), strict=True):
            if found.any():
                out.append((row[0], row[1], *_part(of[found], words, place[found], own_ids, keys), b""))
    return pa.Table.from_batches([_table(out)]) if out else table.slice(0, 0)


def _by_document(table: pa.Table) -> pa.Table:
    """All groups' answers for one batch of texts, by document."""
    read = [_read_part(*row) for row in zip(*(table.column(c).to_pylist() for c in PARTS[2:6]), strict=True)]
    ids, keys = (np.concatenate([x[i][x[3]] for x in read]) for i in (0, 1))
    places = np.concatenate([x[4] for x in read])
    order = np.lexsort((places, keys, ids))
    ids, keys, places = ids[order], keys[order], places[order]
    first = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)), pa.int32()), pa.array(places.astype(np.int32)))
    return pa.Table.from_arrays([pa.array(ids[first]), pa.array(keys[first].astype(np.int32)), lists], ["id", "key", "places"])


def _kept(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at, texts in X.batches(batch.column(1)):
                places = batch.column(2).slice(at, len(texts)).to_pylist()
                h, n = _word_hashes(texts) if any(places) else (None, np.zeros(len(texts), dtype=np.int64))
                first, out = np.concatenate(([0], np.cumsum(n))), []
                for j, (text, held) in enumerate(zip(texts, places, strict=True)):
                    words, spans, kept = WORD.findall(text), [], None
                    if held:
                        nodes = X.window_hash(h[first[j] : first[j + 1]], window)
                        inside = np.zeros(len(words) + 1, dtype=np.int64)
                        starts = np.flatnonzero(np.isin(nodes, nodes[held]))
                        inside[starts] += 1
                        np.subtract.at(inside, starts + window, 1)
                        gone = np.cumsum(inside)[:-1] > 0
                        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8))).tolist()
                        spans = [{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    kept = words if kept is None else kept
                    out.append((len(words), len(words) - len(kept), spans, " ".join(kept)))
                columns = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int64(), kind, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    ["doc_id", "n_words", "n_removed", "removed", "kept_text"],
                )

    return run


def drop_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, group: int = GROUP, batch: int = BATCH
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, ``removed`` (spans of words, end exclusive) and kept_text, the other
    words joined by one blank.

    Removed is every word inside a window of ``window`` words (two at least) that also starts in a row with a smaller id; windows are judged on
    the input. Whole texts count. Two windows are equal if 56 bits of their hashes and the group of their prefixes are.

    One scan or more counts prefixes, one sends 7 bytes and a place for each suffix to its group; what the groups find goes back by batch and
    meets the texts by id and text hash.
    A batch of texts sends one suffix a node and row at most, so very common passages are no hot keys.

    Ids are numbers; null ids come behind all others, and no null id behind another. Null texts have no words. Repeated rows, and
    rows with one id, remove nothing from each other. Extra columns are ignored. An empty table gives an empty result.
    """
    spark = df.sparkSession
    small_batches(spark)
    text = F.coalesce(named(text_col), F.lit(""))
    rows = df.select(F.coalesce(named(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), F.hash(text).alias("key"), text.alias("text"))
    prefixes, n_groups = choose_prefixes(rows, window, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), group, batch)
    kinds = "part int, batch long, " + ", ".join(f"{c} binary" for c in PARTS[2:])
    sent = rows.mapInArrow(_sent(prefixes, n_groups, window, batch), kinds)
    found = sent.groupBy("part").applyInArrow(_repeats, kinds).groupBy("batch").applyInArrow(_by_document, "id long, key int, places array<int>")
    found = found.groupBy("id", "key").agg(F.first("places").alias("places"))  # repeated rows have equal places
    doc = free_name(df, "doc")
    docs = df.select(F.struct(named(id_col).alias("doc_id"), text.alias("text")).alias(doc))
    own = (F.coalesce(F.col(doc)["doc_id"].cast("long"), F.lit(int(NO_ID))) == F.col("id")) & (F.hash(F.col(doc)["text"]) == F.col("key"))
    met = docs.join(found, own, "left").select(F.col(doc)["doc_id"].alias("doc_id"), F.col(doc)["text"].alias("text"), "places")
    kind = dict(met.dtypes)["doc_id"]
    return met.mapInArrow(_kept(window), f"doc_id {kind}, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string")
