"""Normalised tables with their counts, sample races, report texts, splits and tests at their edges."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from furlong.operators import normalise, reports, scoring, splits
from furlong.sources import landing

RACES = [
    {"id": "2024-01-01_5_1", "date": "2024-01-01", "sport": "trot", "starts": [
        {"number": 1, "postPosition": 1, "result": {"place": 1, "finalOdds": 2.5}}, {"number": 2, "scratched": True}, {"postPosition": 3, "result": {"galloped": True}},
    ]},
    {"id": "b", "date": "never", "sport": "monte", "starts": [{"number": 1, "postPosition": 1}]},
    {"id": "c", "date": "2024-01-09", "sport": "trot", "starts": [{"number": k, "postPosition": k, "result": {"place": 1}} for k in (1, 2)]},
]
GAMES = [
    {"id": "g1", "races": [{"id": "b", "date": "2024-01-02", "starts": [{"number": 1, "pools": {"V75": {"betDistribution": 5000}, "V86": {"betDistribution": 1}}}]}]},
    {"id": "g2", "races": [{"id": "b", "starts": [{"number": 1, "pools": {"vinnare": {"odds": 2}}}]}]},
    {"id": "g3"}, {"races": None},
]


def raw(spark, docs, *bad):
    texts = [json.dumps(d) for d in docs] + list(bad)
    return spark.createDataFrame([(t, dt.datetime(2024, 2, 1)) for t in texts], "json string, fetched_at timestamp").repartition(3)


def test_tables_and_counts(spark, tmp_path):
    races = raw(spark, RACES, "{", '{"starts": []}').unionByName(raw(spark, [RACES[0] | {"sport": "old"}]).withColumn("fetched_at", F.lit("2023-01-01").cast("timestamp")))
    report = normalise.normalise(spark, races, raw(spark, GAMES, "[]", "x"), str(tmp_path))
    assert report == {
        "raw_races_read": 6, "race_parse_errors": 2, "norm_races": 3, "races_undated": 1, "date_min": dt.date(2024, 1, 1), "date_max": dt.date(2024, 1, 9),
        "norm_starts": 6, "starts_ran": 5, "scratched": 1, "galloped_or_dq": 1, "starts_with_final_odds": 1, "start_missing_number": 1,
        "start_missing_postposition": 1, "raw_games_read": 6, "game_parse_errors": 2, "game_without_betdist": 3, "norm_bet_distribution": 1,
        "races_no_winner": 1, "races_multi_winner": 1, "races_sport_trot": 2, "races_sport_monte": 1,
    }
    shares = spark.read.parquet(f"{tmp_path}/bet_distribution").first()
    assert (shares.game_id, shares.race_id, shares.date, shares.number, shares.bet_type, shares.share) == ("g1", "b", "2024-01-02", 1, "V75", 0.5)
    text = reports.normalisation_text(report)
    assert "raw races read" in text and "CHECK race parse errors" in text and "races of monte" in text and "none has a bet distribution" not in text
    assert "none has a bet distribution" in reports.normalisation_text({"raw_games_read": 2, "norm_bet_distribution": 0})


def test_no_documents(spark, tmp_path):
    none = raw(spark, RACES).limit(0)
    report = normalise.normalise(spark, none, none, str(tmp_path))
    assert {k: v for k, v in report.items() if v} == {}


def test_legs_are_races_of_a_sample(spark, tmp_path):
    for kind, docs in (("race", RACES[1:]), ("game", GAMES)):
        (tmp_path / kind).mkdir()
        for i, d in enumerate(docs):
            (tmp_path / kind / f"{d.get('id', i)}.json").write_text(json.dumps(d))
    got = {r.key: json.loads(r.json) for r in landing.sample_races(spark, str(tmp_path)).collect()}
    assert set(got) == {"b", "c"} and "sport" not in got["b"] and got["c"] == RACES[2]


def test_texts():
    result = {
        "n_races": 1200, "model_log_loss": 1.6, "market_log_loss": 1.62, "model_brier": 0.71, "market_brier": 0.72, "skill": 0.0123, "mean_diff": 0.02,
        "ci_low": 0.01, "ci_high": 0.03, "z": 3.1, "p": 0.002, "mde": 0.009, "significant": True,
    }
    text = reports.comparison_text("logit vs market", result)
    assert "1,200 races" in text and "+0.0123" in text and text.endswith(": significant")
    assert reports.forecast_text("market", {"n_races": 51, "log_loss": 1.5, "brier": 0.7, "median_overround": 1.179}).endswith("median overround 1.179")


def test_embargo_leaves_out_days_after_a_test(spark):
    days = spark.createDataFrame([(i, dt.date(2024, 1, 1) + dt.timedelta(days=i)) for i in range(40)], "race_id int, date date")
    got = splits.walk_forward(days, dt.date(2024, 1, 11), 5, n_folds=2, step_days=10, purge_days=2, embargo_days=3).collect()
    of = lambda fold, part: sorted(r.race_id for r in got if r.fold == fold and r.part == part)
    assert of(0, "train") == list(range(8)) and of(0, "test") == list(range(10, 15))
    # The second fold trains on all days more than two before its test; an embargo only matters behind its own test.
    assert of(1, "train") == list(range(18)) and of(1, "test") == list(range(20, 25))


@pytest.mark.parametrize(("values", "z"), [([0.25, 0.25], float("inf")), ([-0.25, -0.25], float("-inf")), ([0.0, 0.0], 0.0)])
def test_degenerate_standard_errors(spark, values, z):
    df = spark.createDataFrame([(dt.date(2024, 1, i + 1), v) for i, v in enumerate(values)], "date date, diff double")
    got = scoring.clustered_test(df, "date").first()
    assert got.se == 0 and got.z == z and scoring.two_sided_p(z) == (1 if z == 0 else 0)
