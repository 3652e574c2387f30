"""Blocked sums, exact quantiles and the race bootstrap: against plain Python, and by their plans."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.operators import asof, quantiles, scoring


def races(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = [
        (i, i // 6 + 1, i, rnd.choice(["trot", "monte", None]), rnd.choice([1, 2, None]), rnd.choice([None, 70.0 + rnd.randrange(90) / 8]), rnd.randrange(4))
        for i in range(1, n + 1)
    ]
    return spark.createDataFrame(rows, "race_id int, day int, seq long, sport string, track int, total double, n int").repartition(5)


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 16])
def test_sums_before_by_brute_force(spark, block):
    df = races(spark)
    wanted = {"all": ([], "total"), "by_sport": (["sport"], "total"), "by_both": (["sport", "track"], "n")}
    got = {r.race_id: r for r in asof.sums_before(df, wanted, block).collect()}
    rows = sorted(df.collect(), key=lambda r: r.seq)
    assert len(got) == len(rows)
    for k, r in enumerate(rows):
        for name, (keys, value) in wanted.items():
            held = [x[value] for x in rows[:k] if all(x[c] == r[c] for c in keys) and x[value] is not None]
            assert (got[r.race_id][name] is None) == (not held)
            assert not held or math.isclose(got[r.race_id][name], sum(held))


def test_sums_before_of_no_rows(spark):
    assert asof.sums_before(races(spark).limit(0), {"x": (["sport"], "total")}).count() == 0


def test_no_window_of_rows_has_few_keys(spark):
    """Windows run over blocks of rows or over sums by block, never over all rows of a key of few values."""
    df = races(spark)
    par = asof.par_time(df, "total", "n", [["sport", "track"], ["sport"]])
    variant = asof.day_variant(df.withColumn("dev", F.col("total") - 75), "dev", "n", "track", "day")
    seen = []

    def check(node):
        if node.nodeName() == "Window":
            below = node.child()
            while below.nodeName() in ("Project", "Window", "RepartitionByExpression", "Filter"):
                below = below.child()
            seen.append(below.nodeName())
            keys = [node.partitionSpec().apply(i).toString().split("#")[0] for i in range(node.partitionSpec().size())]
            assert below.nodeName() == "Aggregate" or "__block" in keys
        for i in range(node.children().size()):
            check(node.children().apply(i))

    for got in (par, variant):
        check(got._jdf.queryExecution().optimizedPlan())
    assert "Aggregate" in seen and "Union" in seen


VALUES = {
    "normal": [random.Random(2).gauss(0, 1) for _ in range(3000)],
    "one value": [2.5] * 1000,
    "few values": [float(i % 3) for i in range(1001)],
    "far apart": [10.0 ** random.Random(i).randrange(-30, 30) for i in range(500)],
    "one row": [7.0],
    "two rows": [1.0, 2.0],
}


@pytest.mark.parametrize("name", VALUES)
@pytest.mark.parametrize(("ranges", "most"), [(4, 3), (16, 100), (256, 1 << 16)])
def test_quantiles_are_exact(spark, name, ranges, most):
    values = VALUES[name]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "v double").repartition(6)
    shares = [0.0, 0.025, 0.1, 0.5, 0.975, 1.0]
    got = quantiles.exact_quantiles(df, "v", shares, ranges, most)
    ordered = sorted(values)
    for q, x in zip(shares, got, strict=True):
        at = Fraction(q) * (len(values) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert min(low, high) <= x <= max(low, high)
        assert math.isclose(x, low + (high - low) * float(at - math.floor(at)), rel_tol=1e-9, abs_tol=1e-12)


def test_quantiles_without_values(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([(None,)], "v double"), "v", [0.5]) is None


def test_race_bootstrap_equals_a_plain_one(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(0.1, 1.0, 700)
    df = spark.createDataFrame([(f"r{i}", float(v)) for i, v in enumerate(values)] + [("none", None)], "race_id string, diff double").repartition(7)
    blocks = {r.race_id: r.b for r in df.select("race_id", F.pmod(F.xxhash64("race_id"), F.lit(7)).cast("int").alias("b")).collect()}
    held = [sorted((k, v) for k, v in zip((f"r{i}" for i in range(700)), values, strict=True) if blocks[k] == b) for b in range(7)]
    sizes, sums = np.array([len(x) for x in held]), np.zeros(300)
    drawn = [scoring.drawn_in_block(sizes, b, 300, 5) for b in range(7)]
    assert (sum(drawn) == 700).all()
    for b, part in enumerate(held):
        sums += scoring.block_sums(np.array([v for _, v in part]), drawn[b], b, 5)
    expected = np.percentile(sums / 700, [2.5, 97.5])
    got = scoring.race_bootstrap(df, n_boot=300, seed=5, block=100)
    assert np.allclose(got, expected)
    other = scoring.race_bootstrap(df.repartition(2), n_boot=300, seed=5, block=100)
    assert got == pytest.approx(other, abs=1e-12)


def test_draws_follow_the_multinomial_law():
    sizes = np.array([10, 30, 0, 60])
    drawn = np.array([scoring.drawn_in_block(sizes, b, 20_000, 1) for b in range(4)])
    assert (drawn.sum(axis=0) == 100).all() and not drawn[2].any()
    assert np.allclose(drawn.mean(axis=1), [10, 30, 0, 60], atol=0.2)
    assert np.allclose(drawn.var(axis=1), [9, 21, 0, 24], rtol=0.05)
    assert np.isclose(np.cov(drawn[0], drawn[3])[0, 1], -6, rtol=0.15)


def test_bootstraps_without_rows(spark):
    none = spark.createDataFrame([], "race_id string, diff double, date date")
    assert all(math.isnan(x) for x in (*scoring.race_bootstrap(none), *scoring.day_bootstrap(none, "date")))


def test_written_tables_are_removed(spark):
    import os

    from furlong.scratch import Scratch, temporary

    with temporary(spark):
        held = Scratch(spark)
        table = held.write(spark.range(3))
        folder = held.top.removeprefix("file:")
        assert table.count() == 3 and os.path.isdir(folder)
    assert not os.path.exists(folder)
    with Scratch(spark) as held:
        held.write(spark.range(2))
    assert not os.path.exists(held.top.removeprefix("file:"))
