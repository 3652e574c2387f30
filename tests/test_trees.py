"""Leaf-wise boosting against plain numpy, split by split."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.operators import trees


def plain_tree(bins, g, h, features, leaves, least_rows, rate, n_bins):
    """The same tree from all rows at once: every leaf's best split by trying all, the largest gain first."""
    nodes = {0: np.ones(len(g), dtype=bool)}
    structure, values, free = {}, {}, 1

    def best(rows):
        found = None
        total = g[rows].sum() ** 2 / h[rows].sum()
        for f in features:
            for b in range(n_bins - 1):
                left, right = rows & (bins[:, f] <= b), rows & (bins[:, f] > b)
                if min(left.sum(), right.sum()) < least_rows or min(h[left].sum(), h[right].sum()) < 1e-3:
                    continue
                gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - total
                if gain > 1e-10 and (found is None or gain > found[0] + 1e-9):
                    found = (gain, f, b)
        return found

    while len(nodes) < leaves:
        options = {k: s for k, rows in nodes.items() if (s := best(rows))}
        if not options:
            break
        node = max(options, key=lambda k: (options[k][0], -k))
        _, f, b = options[node]
        rows = nodes.pop(node)
        structure[node] = (f, b, free, free + 1)
        nodes[free], nodes[free + 1] = rows & (bins[:, f] <= b), rows & (bins[:, f] > b)
        free += 2
    for k, rows in nodes.items():
        values[k] = -rate * g[rows].sum() / h[rows].sum()
    return structure, values


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 4))
    x[:, 3] = rng.integers(0, 4, 1500)
    p = 1 / (1 + np.exp(-(1.5 * np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 3] - 1)))
    y = (rng.random(1500) < p).astype(int)
    rows = [(i, *map(float, x[i]), int(y[i])) for i in range(1500)]
    rows[3] = (3, None, float("nan"), *rows[3][3:])
    df = spark.createDataFrame(rows, "row long, a double, b double, c double, d double, y int").repartition(5)
    return df, np.array([[np.nan if v is None else v for v in r[1:5]] for r in rows]), np.array([r[5] for r in rows])


def test_trees_equal_plain_ones(data):
    df, x, y = data
    columns = ["a", "b", "c", "d"]
    model = trees.fit(df, df.limit(0), columns, rounds=3, leaves=9, least_rows=40, rate=0.3, feature_share=0.75, row_share=0.8, n_bins=16, row=F.col("row"), seed=2)
    assert len(model.trees) == 3 and all(len(e) <= 15 for e in model.edges)
    bins, number = model.binned(x), np.arange(len(y))
    score = np.full(len(y), model.start)
    assert np.isclose(model.start, np.log(y.mean() / (1 - y.mean())))
    for k, tree in enumerate(model.trees):
        bag = trees.in_bag(number, k, 0.8, 2)
        assert 0.7 < bag.mean() < 0.9
        g, h = trees.gradients(score, y)
        chosen = np.sort(np.random.default_rng([2, k]).permutation(4)[:3])
        structure, values = plain_tree(bins[bag], g[bag], h[bag], chosen, 9, 40, 0.3, 16)
        assert {n: (tree.feature[n], tree.last[n], tree.left[n], tree.right[n]) for n in range(len(tree.feature)) if tree.feature[n] >= 0} == structure
        assert {n: tree.value[n] for n in range(len(tree.feature)) if tree.feature[n] < 0} == pytest.approx(values)
        score = score + tree.scores(bins)
    got = {r.row: r.p for r in df.select("row", model.probability(columns).alias("p")).collect()}
    assert np.allclose([got[i] for i in range(len(y))], 1 / (1 + np.exp(-score)))


def test_growing_stops_early_and_scores_are_written(data):
    df, x, y = data
    columns = ["a", "b", "c", "d"]
    core, held = df.where("row % 4 > 0"), df.where("row % 4 = 0")
    model = trees.fit(core, held, columns, rounds=40, leaves=8, least_rows=20, rate=0.5, patience=6, n_bins=16, row=F.col("row"))
    out = np.arange(len(y)) % 4 == 0
    bins, score, losses = model.binned(x[out]), np.full(out.sum(), model.start), []
    for t in model.trees:
        score = score + t.scores(bins)
        losses.append(np.logaddexp(0, np.where(y[out] == 1, -score, score)).mean())
    assert 2 < len(model.trees) < 40 and int(np.argmin(losses)) == len(losses) - 1
    base = y[out].mean()
    assert losses[-1] < -(base * np.log(base) + (1 - base) * np.log(1 - base)) - 0.05


def test_nothing_to_learn(spark, data):
    df = data[0]
    for core in (df.limit(0), df.withColumn("y", F.lit(0))):
        model = trees.fit(core, df, ["a"], rounds=2)
        assert model.trees == [] and model.start < -20
    assert trees.fit(df, df, ["a"], rounds=2, least_rows=1000).trees == []


def test_folds_score_trees(spark):
    from furlong.operators import forecasts

    rng = np.random.default_rng(5)
    rows = []
    for day in range(120):
        for r in range(3):
            x = rng.normal(size=4)
            won = int(np.argmax(2 * np.abs(x) + rng.gumbel(size=4)))  # not for a linear model
            rows += [(f"{day}-{r}", i, dt.date(2024, 1, 1) + dt.timedelta(days=day), int(i == won), 0.25, float(x[i])) for i in range(4)]
    df = spark.createDataFrame(rows, "race_id string, number int, date date, y int, p_market double, x double")
    got = forecasts.walk_forward(
        df, ["x"], dt.date(2024, 4, 1), span_days=40, val_days=20, trees_rounds=12, trees_settings={"least_rows": 30, "rate": 0.3, "leaves": 6}
    )
    loss = forecasts.fold_losses(got).first()
    assert loss.loss_trees < loss.loss_logit and loss.n_races == 29 * 3


def test_equal_rows_share_a_record():
    rng = np.random.default_rng(3)
    bins, y = rng.integers(0, 3, (5000, 2)).astype(np.uint8), rng.integers(0, 2, 5000).astype(float)
    batch = trees._records(bins, y, np.arange(5000), 0.5)
    assert batch.num_rows <= 18 + 5000 // trees.SHARED  # 18 kinds of rows, and records of at most SHARED
    for part in (batch, batch.slice(7, 11)):
        held, label, score, n, rows = trees._columns(part, 2)
        assert n.sum() == len(rows) and n.max() <= trees.SHARED and (score == 0.5).all()
        assert (np.repeat(held, n, axis=0) == bins[rows]).all() and (np.repeat(label, n) == y[rows]).all()
    assert sorted(trees._columns(batch, 2)[4]) == list(range(5000))
