"""Toxicity by a classifier chain: categories one after the other, each seeing the earlier ones' probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm import textcodes as X
from furlong.llm.common import cut, named

#: The chain's order: kinds of toxic text, which are clusters of the labelled toxic rows, then the label itself, which decides.
CATEGORIES = ("toxic_kind_1", "toxic_kind_2", "toxic")
#: Lengths of the word beginnings that are features beside whole words.
STEMS = (4, 5, 6, 7)
FOLDS = 5


@cache
def _lower() -> np.ndarray:
    """The lower case of each code point below 2**16 that has one of a single code point, else itself."""
    return np.array([ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(1 << 16)], dtype=np.uint32)


def _hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all texts (words and word beginnings, in lower case) and their text numbers."""
    _, c, starts = X.codes(texts)
    c = np.where(c < 1 << 16, _lower()[np.minimum(c, (1 << 16) - 1)], c)
    ascii_word = ((c >= 97) & (c <= 122)) | ((c >= 48) & (c <= 57))
    begin, end, owner = X.words(c, starts, ~(ascii_word | (c > 127)))
    sums = X.prefix_sums(c)
    found, owners = [X.span_hash(sums, begin, end)], [owner]
    for n in STEMS:
        long = end - begin > n
        found.append(X.span_hash(sums, begin[long], begin[long] + n) ^ X.ODD)
        owners.append(owner[long])
    return np.concatenate(found), np.concatenate(owners)


def _labelled_features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per feature hash and fold: in how many texts it stands, and in how many toxic ones."""
    for batch in rows:
        labels, folds = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for at, held in X.batches(batch.column(0)):
            h, owner = _hashes(held)
            pairs = np.unique(np.stack([owner.astype(np.uint64), h]), axis=1) if len(h) else np.empty((2, 0), np.uint64)
            owner = at + pairs[0].astype(np.int64)
            u, which = np.unique(pairs[1], return_inverse=True)
            cell = which * FOLDS + folds[owner]
            n = np.bincount(cell, minlength=len(u) * FOLDS)
            toxic = np.bincount(cell, weights=labels[owner], minlength=len(u) * FOLDS).astype(np.int64)
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u.view(np.int64)[used // FOLDS]), pa.array((used % FOLDS).astype(np.int32)), pa.array(toxic[used]), pa.array(n[used])],
                ["h", "fold", "toxic", "n"],
            )


def _rows_of(hashes: np.ndarray):
    """Per text: its features among ``hashes`` (numbers)."""

    def find(texts: list[str]) -> list[np.ndarray]:
        h, owner = _hashes(texts)
        place = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
        hit = hashes[place] == h if len(hashes) else np.zeros(len(h), dtype=bool)
        pairs = np.unique(np.stack([owner[hit], place[hit]]), axis=1)
        cuts = np.searchsorted(pairs[0], np.arange(len(texts) + 1))
        return [pairs[1][a:b].astype(np.int32) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    return find


def _train_rows(hashes: np.ndarray):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _rows_of(hashes)
        for batch in rows:
            for at, held in X.batches(batch.column(0)):
                n = len(held)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(at, n), batch.column(2).slice(at, n), pa.array(find(held), pa.list_(pa.int32()))], ["label", "fold", "features"]
                )

    return run


def toxic_kinds(row: np.ndarray, col: np.ndarray, label: np.ndarray, n_features: int, n_kinds: int = 2, rounds: int = 20) -> np.ndarray:
    """(rows, kinds) of 0 and 1: which of ``n_kinds`` clusters each toxic row lies in, by cosine k-means on its features.

    The first centre is the sum of all, each next one the row least like the centres so far; rows
    that are not toxic lie in none.
    """
    out, toxic = np.zeros((len(label), n_kinds)), np.flatnonzero(label == 1)
    if len(toxic) < n_kinds:
        return out
    number = np.full(len(label), -1)
    number[toxic] = np.arange(len(toxic))
    inside = number[row] >= 0
    row, col = number[row[inside]], col[inside]
    weight = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(toxic)), 1))  # rows of length 1
    like = lambda v: weight * np.bincount(row, v[col], len(toxic))
    unit = lambda v: v / max(float(np.linalg.norm(v)), 1e-9)
    total = lambda rows: np.bincount(col, (weight * rows)[row], n_features)
    likeness = like(unit(total(np.ones(len(toxic)))))
    centres = []
    for _ in range(n_kinds):
        centres.append(total(np.arange(len(toxic)) == int(likeness.argmin())))
        likeness = np.max([like(c) for c in centres], axis=0)
    for _ in range(rounds):
        kind = np.argmax([like(c) for c in centres], axis=0)
        centres = [unit(total(kind == k)) for k in range(n_kinds)]
    out[toxic, kind] = 1
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class Link:
    """A linear model: weights of the features, of the earlier probabilities' log-odds, and a bias."""

    features: np.ndarray
    earlier: np.ndarray
    bias: float

    def predict(self, row: np.ndarray, col: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        z = np.bincount(row, weights=self.features[col], minlength=n) if len(row) else np.zeros(n)
        return _sigmoid(z + earlier @ self.earlier + self.bias)


def fit_link(row: np.ndarray, col: np.ndarray, earlier: np.ndarray, y: np.ndarray, n_features: int, steps: int = 300, l2: float = 1e-4) -> Link:
    """Logistic regression by full-batch gradient steps with momentum, each weight scaled by its feature's count."""
    n, k = len(y), earlier.shape[1]
    w, b, bias = np.zeros(n_features), np.zeros(k), 0.0
    vw, vb, vbias = np.zeros(n_features), np.zeros(k), 0.0
    scale = 1.0 / np.maximum(np.bincount(col, minlength=n_features), 5.0)
    scale_b = 1.0 / np.maximum((earlier**2).sum(axis=0), 5.0)
    for _ in range(steps):
        z = np.bincount(row, weights=w[col], minlength=n) + earlier @ b + bias
        g = _sigmoid(z) - y
        vw = 0.8 * vw - 0.6 * scale * (np.bincount(col, weights=g[row], minlength=n_features) + l2 * n * w)
        vb = 0.8 * vb - 0.2 * scale_b * (earlier.T @ g + l2 * n * b)
        vbias = 0.8 * vbias - 0.6 * g.mean()
        w, b, bias = w + vw, b + vb, bias + vbias
    return Link(w, b, float(bias))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Half-way (in log-odds) between the neighbouring out-of-fold probabilities whose cut has the best F1."""
    order = np.argsort(-p)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    i = int(f1.argmax())
    low = p[order[i + 1]] if i + 1 < len(y) else 0.0
    return float(_sigmoid(np.array((_logit(p[order[i]]) + _logit(np.array(low))) / 2)))


def fit_chain(row: np.ndarray, col: np.ndarray, targets: np.ndarray, fold: np.ndarray, allowed: np.ndarray) -> tuple[list[Link], float]:
    """One link for each column of ``targets``, in order, and the last one's threshold.

    What a link is told of earlier categories is out-of-fold: each row's probability comes from
    links that were fitted without that row, as new texts will be, on the features that were chosen
    without its fold. allowed: (FOLDS + 1, features), the features chosen without each fold, and from all.
    """
    n, n_features = len(targets), allowed.shape[1]
    earlier = np.zeros((n, 0))
    chain, out = [], np.zeros(n)
    for j in range(targets.shape[1]):
        y = targets[:, j].astype(float)
        every = allowed[FOLDS][col]
        chain.append(fit_link(row[every], col[every], earlier, y, n_features))
        out = np.zeros(n)
        for f in range(FOLDS):
            inside, chosen = fold != f, allowed[f][col]
            if inside.all():
                continue
            number = np.cumsum(inside) - 1
            use = inside[row] & chosen
            link = fit_link(number[row[use]], col[use], earlier[inside], y[inside], n_features)
            out[~inside] = link.predict(row[chosen], col[chosen], n, earlier)[~inside]
        earlier = np.column_stack([earlier, _logit(out)])
    return chain, best_threshold(out, targets[:, -1].astype(float))


@dataclass
class ToxicityModel:
    hashes: np.ndarray
    chain: list[Link]
    threshold: float = 0.5

    def probabilities(self, texts: list[str]) -> list[np.ndarray]:
        """Each category's probability for each text, in the chain's order."""
        n = len(texts)
        if not self.chain:
            return [np.zeros(n)] * len(CATEGORIES)
        index = _rows_of(self.hashes)(texts)
        row = np.repeat(np.arange(n), [len(i) for i in index])
        col = np.concatenate(index)
        earlier, out = np.zeros((n, 0)), []
        for link in self.chain:
            out.append(link.predict(row, col, n, earlier))
            earlier = np.column_stack([earlier, _logit(out[-1])])
        return out


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
    max_rows: int = 12000, max_features: int = 1024, min_toxic: int = 3,
) -> ToxicityModel:
    """Fit the chain on at most ``max_rows`` labelled documents, taken by a hash of their ids.

    The features are the ``max_features`` words and word beginnings that speak most for a toxic
    label and stand in ``min_toxic`` toxic texts at least, counted over the sample; for each fold they are
    also chosen without it. Rows without an id, label or text are left out; repeated rows count each time. Without
    any labelled rows, with an empty ``docs``, or without a toxic one nothing is toxic. Column names cannot clash.
    """
    chosen = (
        labels.select(named(id_col).alias("labelled_id"), named(label_col).cast("int").alias("label"))
        .where("label is not null and labelled_id is not null")
        .orderBy(F.xxhash64("labelled_id", F.lit(7)), "labelled_id")
        .limit(max_rows)
    )
    texts = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).where("text is not null")
    fold = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(FOLDS)).cast("int").alias("fold")
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("labelled_id")).select("text", "label", fold)  # at most max_rows
    per_fold = {r["fold"]: r for r in rows.groupBy("fold").agg(F.sum("label").alias("t"), F.count("*").alias("n")).collect()}
    nothing = ToxicityModel(np.empty(0, np.uint64), [])
    if not sum(r["t"] for r in per_fold.values()):
        return nothing
    counts = rows.mapInArrow(_labelled_features, "h long, fold int, toxic long, n long").groupBy("h")
    outside = lambda col, f: F.sum(F.when(F.col("fold") != f, F.col(col)).otherwise(0)).alias(f"{col}{f}")
    counts = cut(counts.agg(*[outside(c, f) for f in range(FOLDS + 1) for c in ("toxic", "n")]).where(f"toxic{FOLDS} >= {int(min_toxic)}"))
    picked = []
    for f in range(FOLDS + 1):
        t, n = (sum(r[c] for k, r in per_fold.items() if k != f) for c in ("t", "n"))
        share, toxic, seen = t / max(n, 1), F.col(f"toxic{f}"), F.col(f"n{f}")
        lift = (toxic - seen * share) / F.sqrt(seen * share * (1 - share) + 1)
        top = counts.where((toxic >= min_toxic) & (toxic > 2 * share * seen)).orderBy(lift.desc(), "h").limit(max_features)
        picked.append(np.array([r.h for r in top.select("h").collect()], dtype=np.int64).view(np.uint64))
    hashes = np.unique(np.concatenate(picked))
    if not len(picked[FOLDS]):
        return nothing
    allowed = np.stack([np.isin(hashes, p) for p in picked])
    got = rows.mapInArrow(_train_rows(hashes), "label int, fold int, features array<int>").toArrow()
    label, folds, index = got["label"].to_numpy(), got["fold"].to_numpy(), got["features"].to_pylist()
    # In an order that the rows' contents fix, not the partitions they came from.
    order = sorted(range(len(label)), key=lambda i: (folds[i], label[i], index[i]))
    label, folds, index = label[order], folds[order], [index[i] for i in order]
    row = np.repeat(np.arange(len(label)), [len(i) for i in index])
    col = np.array([x for i in index for x in i], dtype=np.int64)
    targets = np.column_stack([toxic_kinds(row, col, label, len(hashes), len(CATEGORIES) - 1), label])
    chain, threshold = fit_chain(row, col, targets, folds, allowed)
    used = allowed[FOLDS]
    return ToxicityModel(hashes[used], [Link(x.features[used], x.earlier, x.bias) for x in chain], threshold)


def score(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, p_<category> for each link, toxic (the last one's probability reaches the threshold), kept.

    Every whole text is scored. Null and empty texts have no features and are kept unless most
    labelled texts are toxic. Repeated rows are scored one by one, extra columns are ignored,
    an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # max_features hashes and weights

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in rows:
            for at, held in X.batches(batch.column(1)):
                n, out = len(held), m.probabilities(held)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), *map(pa.array, out), pa.array(out[-1] >= m.threshold), pa.array(out[-1] < m.threshold)],
                    ["doc_id", *[f"p_{c}" for c in CATEGORIES], "toxic", "kept"],
                )

    rows = df.select(named(id_col).alias("doc_id"), named(text_col).alias("text"))
    fields = "".join(f", p_{c} double" for c in CATEGORIES)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}{fields}, toxic boolean, kept boolean")


def drop_toxic(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``df`` without the rows whose text the chain calls toxic; all columns and other rows unchanged.

    The texts are judged where they are: the rows pass through one map and are not shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in rows:
            keep = []
            for _, held in X.batches(batch.column(at)):
                keep.extend((m.probabilities(held)[-1] < m.threshold).tolist())
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
