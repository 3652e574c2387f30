"""Supervised subword embeddings: averaged hashed vectors, softmax output, trained by numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm import textcodes as X
from furlong.llm.common import named

BUCKET_BITS = 18
DIM = 16
NGRAMS = (3, 4, 5)
#: The feature that every text has, so that empty texts score by the share of labels.
ALWAYS = 0


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, joined by text, and where each text's begin (with the end).

    Features are the words (runs without white space) and their character 3- to 5-grams with
    the word's edges, hashed to 2**BUCKET_BITS numbers, and ALWAYS. Repeats count.
    """
    _, c, starts = X.codes([f" {t} " for t in texts])
    blank = X.white(c)
    c = np.where(blank, np.uint32(32), c).astype(np.uint64)
    begin, end, _ = X.words(c, starts, blank)
    shift = np.uint64(64 - BUCKET_BITS)
    found = [X.span_hash(X.prefix_sums(c), begin, end) >> shift]
    at = [begin]
    n = len(c)
    for size in NGRAMS:
        if n < size:
            continue
        h = np.full(n - size + 1, size, dtype=np.uint64)
        inner = np.ones(n - size + 1, dtype=bool)
        for k in range(size):
            h = (h ^ c[k : n - size + 1 + k]) * X.ODD
            h ^= h >> np.uint64(29)
            if 0 < k < size - 1:
                inner &= ~blank[k : n - size + 1 + k]
        place = np.flatnonzero(inner)
        found.append(((h[place] * X.ODD) >> shift))
        at.append(place)
    # Each text has a blank of its own on either side, so that no n-gram reads two texts.
    owner = np.concatenate([np.searchsorted(starts, a, side="right") - 1 for a in at])
    every = np.concatenate([*found, np.full(len(texts), ALWAYS, dtype=np.uint64)]).astype(np.int64)
    owner = np.concatenate([owner, np.arange(len(texts))])
    order = np.argsort(owner, kind="stable")
    return every[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))


def _training_rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for at, held in X.batches(batch.column(1)):
            f, bounds = features(held)
            index, counts = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                u, n = np.unique(f[a:b], return_counts=True)
                index.append(u.astype(np.int32))
                counts.append((n / (b - a)).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, len(held)), batch.column(2).slice(at, len(held)),
                 pa.array([i.tobytes() for i in index], pa.binary()), pa.array([n.tobytes() for n in counts], pa.binary())],
                ["doc_id", "label", "features", "shares"],
            )


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 40.0, seed: int = 5) -> np.ndarray:
    """The margin that each feature adds to label 1, from stochastic gradient descent.

    rows: (label, feature numbers, shares). Word and n-gram vectors start small and random,
    the two output vectors at zero; the learning rate falls to zero linearly.
    """
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << BUCKET_BITS, DIM), dtype=np.float32) - 0.5) / DIM).astype(np.float32)
    output = np.zeros((2, DIM), dtype=np.float32)
    steps, total = 0, max(1, epochs * len(rows))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, index, share = rows[i]
            now = rate * (1 - steps / total)
            steps += 1
            hidden = share @ vectors[index]
            z = output @ hidden
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ output
            output -= min(now, 1.0) * np.outer(p, hidden)
            vectors[index] -= (now * share)[:, None] * back[None, :]
    return (vectors @ (output[1] - output[0])).astype(np.float32)


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 3000
) -> np.ndarray:
    """Train on at most ``max_rows`` labelled documents, taken by a hash of their ids.

    Rows without an id, a label or a text are left out. Without labelled rows, or with an
    empty ``docs``, the margins are zero; repeated rows count each time. Column names cannot clash.
    """
    chosen = (
        labels.select(named(id_col).alias("labelled_id"), named(label_col).cast("int").alias("label"))
        .where("label is not null and labelled_id is not null")
        .orderBy(F.xxhash64("labelled_id", F.lit(3)), "labelled_id")
        .limit(max_rows)
    )
    texts = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).where("text is not null")
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("labelled_id")).select("id", "text", "label")  # at most max_rows
    kind = dict(rows.dtypes)["id"]
    got = rows.mapInArrow(_training_rows, f"doc_id {kind}, label int, features binary, shares binary").orderBy("doc_id")
    data = [(r.label, np.frombuffer(r.features, np.int32), np.frombuffer(r.shares, np.float32)) for r in got.toLocalIterator()]
    return train(data) if data else np.zeros(1 << BUCKET_BITS, dtype=np.float32)


def score(df: DataFrame, margins: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and score, the softmax share of label 1.

    Every whole text is scored by its text alone. Null texts count as empty and get the score
    of the ALWAYS feature. Repeated rows are scored one by one, extra columns are ignored, an
    empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(margins)  # 2**BUCKET_BITS floats, whatever the input

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in rows:
            for at, held in X.batches(batch.column(1)):
                f, bounds = features(held)
                sums = np.concatenate([[0.0], np.cumsum(weight[f], dtype=np.float64)])
                mean = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(held)), pa.array(1 / (1 + np.exp(-np.clip(mean, -40, 40))))], ["doc_id", "score"]
                )

    rows = df.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")
