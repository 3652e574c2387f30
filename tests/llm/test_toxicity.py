"""The classifier chain against plain code, and on held-out rows by language."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.llm import queries, toxicity


def plain_link(x, earlier, y, steps=300, l2=1e-4):
    """The same descent over a dense matrix, row by row."""
    w, b, bias = np.zeros(x.shape[1]), np.zeros(earlier.shape[1]), 0.0
    vw, vb, vbias = w.copy(), b.copy(), 0.0
    counts, squares = np.maximum(x.sum(axis=0), 5), np.maximum((earlier**2).sum(axis=0), 5)
    for _ in range(steps):
        gw, gb, gbias = np.zeros_like(w), np.zeros_like(b), 0.0
        for xi, ei, yi in zip(x, earlier, y, strict=True):
            error = 1 / (1 + np.exp(-(xi @ w + ei @ b + bias))) - yi
            gw, gb, gbias = gw + error * xi, gb + error * ei, gbias + error
        n = len(y)
        vw, vb, vbias = 0.8 * vw - 0.6 / counts * (gw + l2 * n * w), 0.8 * vb - 0.2 / squares * (gb + l2 * n * b), 0.8 * vbias - 0.6 * gbias / n
        w, b, bias = w + vw, b + vb, bias + vbias
    return w, b, bias


def plain_chain(x, targets, fold, allowed):
    """Links on all rows, each told of earlier categories by links that did not see the row or choose features by it."""
    earlier, links = np.zeros((len(x), 0)), []
    for y in targets.T:
        links.append(plain_link(x * allowed[toxicity.FOLDS], earlier, y))
        out = np.zeros(len(x))
        for f in set(fold.tolist()):
            w, b, bias = plain_link((x * allowed[f])[fold != f], earlier[fold != f], y[fold != f])
            for i in np.flatnonzero(fold == f):
                out[i] = 1 / (1 + np.exp(-((x * allowed[f])[i] @ w + earlier[i] @ b + bias)))
        p = np.clip(out, 1e-6, 1 - 1e-6)
        earlier = np.column_stack([earlier, np.log(p / (1 - p))])
    return links, out


def test_chain_equals_plain_code():
    rng = np.random.default_rng(3)
    x = (rng.random((60, 7)) < 0.3).astype(float)
    x[x.sum(axis=1) == 0, 0] = 1
    last = ((x[:, 0] + x[:, 1] + 0.3 * rng.normal(size=60)) > 0.8).astype(float)
    targets = np.column_stack([last * (x[:, 0] > 0), last * (x[:, 1] > 0), last])
    fold = np.arange(60) % toxicity.FOLDS
    allowed = rng.random((toxicity.FOLDS + 1, 7)) < 0.8
    row, col = np.nonzero(x)
    chain, threshold = toxicity.fit_chain(row, col, targets, fold, allowed)
    links, out = plain_chain(x, targets, fold, allowed)
    for link, (w, b, bias) in zip(chain, links, strict=True):
        assert np.allclose(link.features, w, atol=1e-8) and np.allclose(link.earlier, b, atol=1e-8) and np.isclose(link.bias, bias)
    cuts = [(np.sum((out >= t) & (last == 1)) * 2 / (np.sum(out >= t) + last.sum()), t) for t in np.unique(out)]
    best = max(f1 for f1, _ in cuts)
    assert np.isclose(np.sum((out >= threshold) & (last == 1)) * 2 / (np.sum(out >= threshold) + last.sum()), best)


def test_kinds_are_clusters_of_toxic_rows():
    words = [[0, 1], [0, 1, 2], [5, 6], [5, 6, 7], [0, 5], [3]]
    row = np.repeat(np.arange(6), [len(w) for w in words])
    kinds = toxicity.toxic_kinds(row, np.concatenate(words), np.array([1, 1, 1, 1, 0, 0]), 8)
    assert (kinds[:4].sum(axis=1) == 1).all() and not kinds[4:].any()
    assert (kinds[0] == kinds[1]).all() and (kinds[2] == kinds[3]).all() and (kinds[0] != kinds[2]).any()


def test_features_ignore_case_in_all_languages():
    of = lambda text: set(toxicity._hashes([text])[0].tolist())
    assert of("RÉEUXON Straße ΑΒΓ") == of("réeuxon straße αβγ") != of("reeuxon strasse abc")


@pytest.fixture(scope="module")
def held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = F.pmod(queries.id_crc("doc_id"), F.lit(5)) == 0
    model = toxicity.fit(docs, labels.where(~out))
    judged = toxicity.score(docs, model).withColumnRenamed("toxic", "called").join(labels.where(out), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    return judged.select("lang", "toxic", "called").toPandas()


def test_recall_and_false_alarms_on_held_out_rows(held_out):
    """Of toxic texts, about one in twenty has none of the words that others share; a model that calls nothing toxic finds none."""
    toxic, clean = held_out[held_out.toxic == 1], held_out[held_out.toxic == 0]
    assert len(toxic) > 90 and toxic.called.mean() >= 0.9
    assert clean.called.mean() <= 0.02
    for lang, part in toxic.groupby("lang"):
        assert part.called.mean() >= 0.8, lang
    for lang, part in clean.groupby("lang"):
        assert part.called.mean() <= 0.06, lang
