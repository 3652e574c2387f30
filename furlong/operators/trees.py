"""Gradient-boosted trees for a binary label, grown leaf by leaf over binned features.

Rows stay in tasks: a pass adds up gradients and their weights by leaf, feature and bin in each task, Spark adds up the tasks, and the driver, which sees
histograms of the model's size only, chooses splits. The leaf with the largest gain is split first. A pass looks one split ahead in every leaf, so a tree
takes about as many passes as it is deep, not as it has leaves; of two children one is counted, the other is the rest of its parent. Rows that are equal in all bins
and in the label have one score: a task that prepares them puts them into one record, which holds their numbers, by which a bag is drawn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.scratch import Scratch

#: The boosting's own settings.
RATE, LEAVES, LEAST_ROWS, LEAST_WEIGHT, FEATURE_SHARE, ROW_SHARE, PATIENCE = 0.03, 31, 200, 1e-3, 0.8, 0.8, 50
BINS = 64
#: Trees after which scores are written, and losses on the held-out rows are looked at.
REFRESH, LOOK = 16, 8


@dataclass
class Tree:
    """Nodes by number, 0 the root: feature (-1 for a leaf), the last bin that goes left, children, value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    last: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, last: int) -> tuple[int, int]:
        self.feature[node], self.last[node] = feature, last
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            self.feature.append(-1)
            self.last.append(0)
            self.left.append(-1)
            self.right.append(-1)
            self.value.append(0.0)
        return self.left[node], self.right[node]

    def copy(self) -> Tree:
        return Tree(*(list(x) for x in (self.feature, self.last, self.left, self.right, self.value)))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, last, left, right = (np.array(x) for x in (self.feature, self.last, self.left, self.right))
        node = np.zeros(len(bins), dtype=np.int64)
        while len(rows := np.flatnonzero(feature[node] >= 0)):
            at = node[rows]
            node[rows] = np.where(bins[rows, feature[at]] <= last[at], left[at], right[at])
        return node

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaves(bins)]


@dataclass
class Split:
    gain: float
    feature: int
    last: int
    sums: np.ndarray  # gradient, weight and rows of the left child


def best_split(histogram: np.ndarray, features: np.ndarray, least_rows: int, least_weight: float = LEAST_WEIGHT) -> Split | None:
    """The split with the largest gain of a node; histogram: (features, bins, [gradient, weight, rows]). Ties: the first feature, then bin."""
    left = np.cumsum(histogram, axis=1)[:, :-1]
    total = histogram[features[0]].sum(axis=0)
    right = total - left
    allowed = (left[..., 2] >= least_rows) & (right[..., 2] >= least_rows) & (left[..., 1] >= least_weight) & (right[..., 1] >= least_weight)
    allowed[np.setdiff1d(np.arange(len(histogram)), features)] = False
    gain = np.full(allowed.shape, -np.inf)
    part = lambda x: x[allowed][:, 0] ** 2 / x[allowed][:, 1]
    gain[allowed] = part(left) + part(right) - total[0] ** 2 / total[1] if total[1] > 0 else -np.inf
    f, b = np.unravel_index(int(gain.argmax()), gain.shape) if gain.size else (0, 0)
    if not gain.size or gain[f, b] <= 1e-10:
        return None
    return Split(float(gain[f, b]), int(f), int(b), left[f, b].copy())


def in_bag(rows: np.ndarray, number: int, share: float, seed: int) -> np.ndarray:
    """Whether tree ``number`` sees each row, by a hash of the row's number."""
    x = rows.astype(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (number + 1) + seed) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(share, 1.0) * float(2**64 - 2048))


def gradients(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-score))
    return p - y, p * (1 - p)


def histograms(bins: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, slot: np.ndarray, n_slots: int, n_bins: int) -> np.ndarray:
    """(slots, features, bins, [gradient, weight, rows]) of the records whose slot is not below 0; g, h: of all n rows of a record."""
    held = slot >= 0
    bins, g, h, n, slot = bins[held], g[held], h[held], n[held], slot[held]
    k = bins.shape[1]
    cell = ((slot[:, None] * k + np.arange(k)) * n_bins + bins).ravel()
    size = n_slots * k * n_bins
    sums = [np.bincount(cell, np.repeat(w, k), size) for w in (g, h, n)]
    return np.stack(sums, axis=-1).reshape(n_slots, k, n_bins, 3)


#: Records: a score, and the numbers of the rows that are equal in their bins and label.
ROWS = "bins binary, y double, score double, rows array<long>"
#: Rows that a task groups at once, and the most of a record, so that a batch of records stays small.
CHUNK, SHARED = 1 << 19, 256


def _records(bins: np.ndarray, y: np.ndarray, numbers: np.ndarray, start: float) -> pa.RecordBatch:
    """Rows as records. Equal rows stand together after a sort by a hash; only rows that are really equal share a record."""
    mixed = y.view(np.uint64).copy()
    for i in range(bins.shape[1]):
        mixed = (mixed ^ bins[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    bins, y, numbers = bins[order], y[order], numbers[order]
    new = np.append(True, (y[1:] != y[:-1]) | (bins[1:] != bins[:-1]).any(axis=1))
    first = np.flatnonzero(new)
    at = np.arange(len(y)) - np.repeat(first, np.diff(np.append(first, len(y))))
    first = np.flatnonzero(at % SHARED == 0)
    n, k = len(first), bins.shape[1]
    held = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(k)), pa.py_buffer(bins[first].tobytes())])
    rows = pa.ListArray.from_arrays(pa.array(np.append(first, len(y)).astype(np.int32)), pa.array(numbers))
    return pa.RecordBatch.from_arrays([held, pa.array(y[first]), pa.array(np.full(n, start)), rows], ["bins", "y", "score", "rows"])


def _columns(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
    """Bins, labels, scores, the number of rows and all rows' numbers of a batch of records."""
    held, rows = batch.column(0).cast(pa.binary()), batch.column(3)
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
    bins = np.frombuffer(held.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, k)
    return bins, batch.column(1).to_numpy(), batch.column(2).to_numpy(), rows.value_lengths().to_numpy(), rows.flatten().to_numpy()


@dataclass
class Boosted:
    """Trees over features that are binned at ``edges``; ``start`` is the score of the first."""

    edges: list[np.ndarray]
    start: float
    trees: list[Tree] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        """Bins of (rows, features): the number of edges below; nulls and nan are in the first."""
        x = np.where(np.isnan(x), -np.inf, x)
        return np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def probability(self, columns: list[str]) -> Column:
        """The probability of label 1 by the columns, in the order of the fit."""

        @F.pandas_udf("double")
        def of(rows: pd.DataFrame) -> pd.Series:
            bins = self.binned(rows.to_numpy(dtype=np.float64))
            return pd.Series(1 / (1 + np.exp(-sum((t.scores(bins) for t in self.trees), np.full(len(bins), self.start)))))

        return of(F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]))


class _Fit:
    def __init__(self, core: DataFrame, held_out: DataFrame, model: Boosted, n_bins: int, scratch: Scratch, seed: int, row_share: float) -> None:
        self.core, self.held_out, self.model, self.n_bins, self.scratch, self.seed, self.row_share = core, held_out, model, n_bins, scratch, seed, row_share
        self.written = 0  # trees whose scores the records have

    def counted(self, tree: Tree, wanted: list[int]) -> dict[int, np.ndarray]:
        """The histograms of the ``wanted`` leaves of ``tree``, over the rows of this tree's bag."""
        k, n_bins, number, seed, share = len(self.model.edges), self.n_bins, len(self.model.trees), self.seed, self.row_share
        newer = self.model.trees[self.written :]
        slots = np.full(len(tree.feature), -1)
        slots[wanted] = np.arange(len(wanted))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(wanted), k, n_bins, 3))
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, y, score, n, rows = _columns(batch, k)
                n = np.add.reduceat(in_bag(rows, number, share, seed).astype(np.float64), np.cumsum(n) - n)
                score = sum((t.scores(bins) for t in newer), score)
                g, h = gradients(score, y)
                total += histograms(bins, g * n, h * n, n, slots[tree.leaves(bins)], len(wanted), n_bins)
            flat = total.reshape(-1, 3)
            cell = np.flatnonzero(flat[:, 2])
            yield pa.RecordBatch.from_arrays([pa.array(cell), *(pa.array(flat[cell, i]) for i in range(3))], ["cell", "g", "h", "n"])

        found = self.core.mapInArrow(run, "cell long, g double, h double, n double").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
        flat = np.zeros((len(wanted) * k * n_bins, 3))
        flat[found["cell"].to_numpy()] = np.stack([found[c].to_numpy() for c in "ghn"], axis=1)
        return dict(zip(wanted, flat.reshape(len(wanted), k, n_bins, 3), strict=True))

    def losses(self, first: int) -> list[float]:
        """Mean log loss on the held-out rows after each tree from number ``first`` on; nan without such rows."""
        k, written, trees, n = len(self.model.edges), self.written, self.model.trees, len(self.model.trees) - first

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(n + 1)
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, y, score, rows, _ = _columns(batch, k)
                score = sum((t.scores(bins) for t in trees[written:first]), score)
                for i, t in enumerate(trees[first:]):
                    score = score + t.scores(bins)
                    sums[i] += (rows * np.logaddexp(0, np.where(y == 1, -score, score))).sum()
                sums[n] += rows.sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1)), pa.array(sums)], ["i", "x"])

        sums = {r.i: r.x for r in self.held_out.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()}
        return [sums[i] / sums[n] if sums.get(n) else float("nan") for i in range(n)]

    def refresh(self) -> None:
        """Write the records with the scores of all trees so far."""
        k, newer = len(self.model.edges), self.model.trees[self.written :]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    bins, _, score, _, _ = _columns(batch, k)
                    yield batch.set_column(2, "score", pa.array(sum((t.scores(bins) for t in newer), score)))

        before = self.core, self.held_out
        self.core, self.held_out = (self.scratch.write(x.mapInArrow(run, ROWS)) for x in before)
        self.scratch.drop(*before)
        self.written = len(self.model.trees)

    def grown(self, features: np.ndarray, leaves: int, least_rows: int, rate: float) -> Tree | None:
        """One tree, the leaf of the largest gain first; None where nothing can be split."""
        tree = Tree()
        histogram = self.counted(tree, [0])
        sums = {0: histogram[0][features[0]].sum(axis=0)}
        splits = {0: best_split(histogram[0], features, least_rows)}
        children: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n_leaves in range(1, leaves):
            node = max((k for k, s in splits.items() if s), key=lambda k: (splits[k].gain, -k), default=None)
            if node is None:
                break
            split, last = splits.pop(node), n_leaves == leaves - 1
            if node not in children and not last:
                splits[node] = split
                ahead, open_ = tree.copy(), [k for k, s in splits.items() if s and k not in children]
                left = {ahead.split(k, splits[k].feature, splits[k].last)[0]: k for k in open_}
                for child, found in self.counted(ahead, list(left)).items():
                    children[left[child]] = (found, histogram[left[child]] - found)
                splits.pop(node)
            pair = tree.split(node, split.feature, split.last)
            for child, child_sums in zip(pair, (split.sums, sums[node] - split.sums), strict=True):
                sums[child] = child_sums
            if not last:
                for child, found in zip(pair, children.pop(node), strict=True):
                    histogram[child], splits[child] = found, best_split(found, features, least_rows)
            histogram.pop(node)
        if len(tree.feature) == 1:
            return None
        for node, total in sums.items():
            tree.value[node] = -rate * total[0] / total[1] if tree.feature[node] < 0 else 0.0
        return tree


def fit(
    core: DataFrame, held_out: DataFrame, columns: list[str], y: str = "y", rounds: int = 2000, leaves: int = LEAVES, least_rows: int = LEAST_ROWS,
    rate: float = RATE, feature_share: float = FEATURE_SHARE, row_share: float = ROW_SHARE, patience: int = PATIENCE, n_bins: int = BINS,
    row: Column | None = None, seed: int = 0,
) -> Boosted:
    """Trees on the rows of ``core``, as many as do best on ``held_out``.

    Each tree sees ``feature_share`` of the columns and ``row_share`` of the rows, drawn by the seed and by ``row``, a column of numbers (by
    default a hash of the columns). Growing ends after ``patience`` trees without a better loss on the held-out rows, or ``rounds``; without held-out rows all count.
    Bins are at approximate quantiles, at most ``n_bins``, 256 or fewer. Nulls are below every value. Without rows of both labels no tree is grown.
    """
    values = [F.col(c).cast("double") for c in columns]
    number = F.xxhash64(*values) if row is None else row
    shares = F.array(*[F.lit(i / n_bins) for i in range(1, n_bins)])
    known = lambda v: F.when(~F.isnan(v), v)
    stats = core.agg(
        F.avg(F.col(y).cast("double")).alias("y"), *[F.percentile_approx(known(v), shares, F.lit(10_000)).alias(f"e{i}") for i, v in enumerate(values)]
    ).first()
    edges = [np.unique(np.array(stats[f"e{i}"] or [], dtype=np.float64)) for i in range(len(columns))]
    if not columns or stats["y"] is None or not 0 < stats["y"] < 1:
        share = min(max(stats["y"] or 0.0, 1e-12), 1 - 1e-12)
        return Boosted(edges, float(np.log(share / (1 - share))))
    start = float(np.log(stats["y"] / (1 - stats["y"])))
    model = Boosted(edges, start)

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(columns))], axis=1)
            parts.append((model.binned(x), *(batch.column(len(columns) + i).to_numpy(zero_copy_only=False) for i in range(2))))
            waiting += len(x)
            if waiting >= CHUNK:
                yield _records(*map(np.concatenate, zip(*parts, strict=True)), start)
                parts, waiting = [], 0
        if waiting:
            yield _records(*map(np.concatenate, zip(*parts, strict=True)), start)

    parts = [
        df.select(*[v.alias(f"x{i}") for i, v in enumerate(values)], F.col(y).cast("double").alias("y"), number.cast("long").alias("row")).mapInArrow(prepared, ROWS)
        for df in (core, held_out)
    ]
    with Scratch(core.sparkSession) as scratch:
        job = _Fit(*(scratch.write(x) for x in parts), model, n_bins, scratch, seed, row_share)
        losses: list[float] = []
        for number in range(rounds):
            rng = np.random.default_rng([seed, number])
            chosen = np.sort(rng.permutation(len(columns))[: max(1, round(feature_share * len(columns)))])
            tree = job.grown(chosen, leaves, least_rows, rate)
            if tree is None:
                break
            model.trees.append(tree)
            if len(model.trees) - len(losses) == LOOK:
                losses += job.losses(len(losses))
                if len(losses) - 1 - int(np.argmin(losses)) >= patience:
                    break
            if len(model.trees) - job.written == REFRESH:
                losses += job.losses(len(losses)) if len(losses) < len(model.trees) else []
                job.refresh()
        if len(losses) < len(model.trees):
            losses += job.losses(len(losses))
    if losses and not np.isnan(losses).any():
        del model.trees[int(np.argmin(losses)) + 1 :]
    return model
