import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.functions import documents
from furlong.operators import forecasts, market

DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def frame(spark):
    """300 days of 2 races with 5 runners: x drives the winner, and the market sees half of it."""
    rng = np.random.default_rng(3)
    rows = []
    for day in range(300):
        for r in range(2):
            x = rng.normal(size=5)
            won = int(np.argmax(1.6 * x + rng.gumbel(size=5)))
            m = np.exp(0.8 * x)
            m /= m.sum()
            for i in range(5):
                rows.append((f"{day}-{r}", i, DAY + dt.timedelta(days=day), int(i == won), float(m[i]), float(x[i]) if i else None))
    df = spark.createDataFrame(rows, "race_id string, number int, date date, y int, p_market double, x double").cache()
    df.count()
    return df


def test_walk_forward_learns_from_the_past_alone(spark, frame):
    first = DAY + dt.timedelta(days=200)
    got = forecasts.walk_forward(frame, ["x"], first, span_days=60, val_days=60)
    rows = got.collect()
    assert {r.fold for r in rows} == {0, 1} and len(rows) == 100 * 2 * 5
    parts = {r.forecast: r for r in forecasts.reliability(spark.createDataFrame(rows, got.schema)).collect()}
    assert set(parts) == {c[2:] for c in got.columns if c.startswith("p_")}
    for r in parts.values():
        assert abs(r.uncertainty - 0.16) < 1e-9 and 0 <= r.reliability < 0.02 and 0 < r.resolution <= r.uncertainty
    assert parts["combination"].resolution > parts["market"].resolution
    sums = {}
    for r in rows:
        for c in ("p_market", "p_market_flb", "p_logit", "p_combination"):
            sums[r.race_id, c] = sums.get((r.race_id, c), 0) + r[c]
    assert all(abs(v - 1) < 1e-9 for v in sums.values())
    # Outcomes from the first test day on do not change the first fold's forecasts.
    changed = frame.withColumn("y", F.when(F.col("date") >= F.lit(first), (F.col("number") == 0).cast("int")).otherwise(F.col("y")))
    other = {(r.race_id, r.number): r.p_combination for r in forecasts.forecast_window(changed, ["x"], first, first + dt.timedelta(days=60))[0].collect()}
    assert all(abs(other[r.race_id, r.number] - r.p_combination) < 1e-9 for r in rows if r.fold == 0)
    by = {r.label: r for r in forecasts.comparisons(got, n_boot=200).collect()}
    assert by["market_flb vs market"].skill > 0 and by["combination vs market"].significant
    assert forecasts.walk_forward(frame.limit(0), ["x"], first) is None
    assert forecasts.fold_losses(got).agg(F.sum("n_races")).first()[0] == 200


def test_predict_append_and_score(spark, frame, tmp_path):
    day = DAY + dt.timedelta(days=299)
    got, fitted = forecasts.predict_day(frame, ["x"], day)
    assert got.count() == 10 and fitted["power"] > 1
    path = str(tmp_path / "snapshots")
    forecasts.append_snapshot(got, path)
    forecasts.append_snapshot(got, path)
    outcomes = frame.select("race_id", "number", F.col("y").alias("is_winner"))
    scored = forecasts.score_snapshots(spark.read.parquet(path), outcomes, ["race_id", "number"], n_boot=50).collect()
    assert {r.n_races for r in scored} == {2} and len(scored) == 4
    with pytest.raises(ValueError):
        forecasts.score_snapshots(spark.read.parquet(path), outcomes.withColumn("is_winner", F.lit(0)), ["race_id", "number"])
    with pytest.raises(ValueError):
        forecasts.predict_day(frame, ["x"], dt.date(2099, 1, 1))


def test_trees_share_within_races(spark, frame):
    first = DAY + dt.timedelta(days=200)
    got, _ = forecasts.forecast_window(frame, ["x"], first, first + dt.timedelta(days=60), trees_rounds=3)
    per = got.groupBy("race_id").agg(F.sum("p_trees").alias("s")).agg(F.min("s"), F.max("s")).first()
    assert abs(per[0] - 1) < 1e-9 and abs(per[1] - 1) < 1e-9


def test_share_market_takes_the_largest_pool(spark):
    runners = spark.createDataFrame([("A", 1, 1), ("A", 2, 0), ("B", 1, 1), ("B", 2, 0), ("C", 1, 0)], "race_id string, number int, y int")
    shares = spark.createDataFrame(
        [("A", 1, "g", 10, 0.5), ("A", 2, "g", 10, 0.5), ("A", 1, "h", 20, 0.3), ("A", 2, "h", 20, 0.1), ("B", 1, "g", None, 0.4), ("C", 1, "g", 1, 1.0)],
        "race_id string, number int, game_id string, pool_turnover long, share double",
    )
    assert sorted((r.race_id, r.number, round(r.p, 6), r.y) for r in market.from_shares(runners, shares).collect()) == [("A", 1, 0.75, 1), ("A", 2, 0.25, 0)]
    assert market.from_shares(runners, shares.limit(0)).isEmpty()


def test_bet_distribution(spark):
    leg = {
        "id": "r1", "pools": {"V75": {"turnover": 100000}},
        "starts": [
            {"number": 1, "horse": {"id": 7}, "pools": {"V75": {"betDistribution": 5000}, "vinnare": {"odds": 2}}},
            {"number": 2, "pools": {"V75": {"betDistribution": None}, "V86": {"betDistribution": 100}}},
            {"number": 3},
        ],
    }
    docs = spark.createDataFrame([("g", json.dumps({"races": [leg]})), ("e", "{}"), ("n", '{"races": null}')], "game_id string, json string")
    got = documents.bet_distribution(docs.withColumn("doc", F.try_parse_json("json"))).collect()
    assert sorted((r.bet_type, r.number, r.horse_id, r.share, r.pool_turnover) for r in got if r.share is not None) == [
        ("V75", 1, 7, 0.5, 100000), ("V86", 2, None, 0.01, None),
    ]
    assert len(got) == 3


def test_first_pool_of_a_start_counts(spark):
    start = lambda n, **pools: {"number": n, "pools": {k: {"betDistribution": v} for k, v in pools.items()}}
    leg = {
        "id": "r1", "pools": {"V86": {"turnover": 9}, "V75": {"turnover": 5}},
        "starts": [start(1, V86=6000, V75=5000), start(2, V75=1000, V86=4000), start(1, V75=1)],
    }
    none = {"id": "r2", "starts": [start(1, V86=None, V75=7), {"number": 2, "pools": None}, {"number": 3, "pools": {"vinnare": {"odds": 2}}}]}
    docs = spark.createDataFrame([("g", json.dumps({"races": [leg, none]})), ("e", "{}"), ("x", None)], "game_id string, json string")
    docs = docs.withColumn("doc", F.try_parse_json("json"))
    got = documents.first_shares(docs)
    assert sorted((r.race_id, r.number, r.bet_type, r.share) for r in got.collect()) == [
        ("r1", 1, "V86", 0.6), ("r1", 2, "V75", 0.1), ("r2", 1, "V86", None),
    ]
    assert got.columns == documents.bet_distribution(docs).columns
    runners = spark.createDataFrame([("r1", 1, 1), ("r1", 2, 0)], "race_id string, number int, y int")
    shares = lambda f: sorted((r.number, round(r.p, 6)) for r in market.from_shares(runners, f).collect())
    assert shares(got) == [(1, 0.857143), (2, 0.142857)] and shares(documents.bet_distribution(docs)) == []
