import datetime as dt
import json
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from furlong.functions import documents
from furlong.operators import asof, features, market, models, ratings, reports, scoring, splits
from furlong.plans import driver_queries, feature_queries

QUERIES = driver_queries.queries() | feature_queries.queries()
ORACLE_SQL = driver_queries.oracle_sql() | feature_queries.oracle_sql()

SF = "/root/testdata/sf0.001"


def _rows(columns, rows):
    clean = lambda v: round(v, 5) if isinstance(v, float) else v
    return sorted((tuple(clean(r[c]) for c in columns) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    got = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    assert _rows(columns, [r.asDict() for r in df.collect()]) == _rows(columns, [dict(zip(names, r, strict=True)) for r in got.fetchall()])


def test_losses_by_hand(spark):
    rows = [("A", 1, 0.8, 1), ("A", 2, 0.2, 0), ("B", 1, 0.4, 1), ("B", 2, 0.2, 0), ("B", 3, 0.2, 0), ("B", 4, 0.2, 0)]
    df = spark.createDataFrame(rows, "race_id string, number int, p double, y int")
    assert scoring.mean_losses(scoring.race_losses(df)).first()["log_loss"] == pytest.approx(0.569717, abs=1e-6)
    scoring.require_one_winner(df)
    with pytest.raises(ValueError):
        scoring.require_one_winner(df.withColumn("y", F.lit(1)))


def test_same_race_is_left_out(spark):
    rows = [(1, 0.0, 11, 1), (1, 0.0, 11, 0), (2, 7.0, 11, 0)]
    df = spark.createDataFrame(rows, "seq long, day double, driver int, y int")
    rate, n = asof.decayed_rate(F.col("y"), F.lit(0.1), F.col("day"), ["driver"], 365.0, 20.0)
    got = {(r.seq, r.y): (r.rate, r.n) for r in df.select("seq", "y", rate.alias("rate"), n.alias("n")).collect()}
    assert got[1, 1] == got[1, 0] == (pytest.approx(0.1), 0.0)
    assert got[2, 0][1] == pytest.approx(2 * 2 ** (-7 / 365))


def test_elo_by_hand(spark):
    df = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 2, 2), (1, 1, 3, None), (2, 2, 1, 1), (2, 2, 2, 2), (2, 2, 3, 3)], "race long, seq long, horse long, place int")
    got = {(r.race, r.horse): r.elo for r in ratings.elo_before(df, "race", "seq", "horse", "place").collect()}
    assert [got[2, h] for h in (1, 2, 3)] == [1512.0, 1500.0, 1488.0]


def test_fixed_split_purges(spark):
    days = [(dt.date(2024, 1, 1) + dt.timedelta(days=i),) for i in range(91)]
    part = splits.fixed_part(F.col("d"), dt.date(2024, 2, 29), dt.date(2024, 3, 15), 5)
    got = {r.d: r.p for r in spark.createDataFrame(days, "d date").select("d", part.alias("p")).collect()}
    assert got[dt.date(2024, 2, 24)] == "train" and got[dt.date(2024, 2, 25)] is None
    assert got[dt.date(2024, 3, 1)] == "val" and got[dt.date(2024, 3, 16)] == "test"


def test_logit_and_power_recover(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = []
    for race in range(600):
        x = rng.normal(size=6)
        won = int(np.argmax(2 * x + rng.gumbel(size=6)))
        weak = np.exp(0.6 * 2 * x)
        rows += [(race, float(v), float(w), int(i == won)) for i, (v, w) in enumerate(zip(x, weak / weak.sum(), strict=True))]
    df = spark.createDataFrame(rows, "race_id int, x double, p double, y int").cache()
    assert models.fit_conditional_logit(df, ["x"])[0] == pytest.approx(2, abs=0.3)
    assert 1.3 < models.fit_power(df) < 2


def test_document_rows(spark):
    text = (
        '{"id": "2025-06-04_23_5", "date": "2025-06-04", "sport": "trot", "starts": [{"number": 1, "horse": {"id": 101, '
        '"shoes": {"front": {"changed": true}}, "trainer": {"firstName": "Tr", "lastName": "101"}}, '
        '"result": {"place": 1, "finalOdds": 2.0, "kmTime": {"minutes": 1, "seconds": 12, "tenths": 0}}}]}'
    )
    docs = documents.parsed(spark.createDataFrame([(text,), ("[1]",), ("oops",), (None,)], "json string"))
    assert docs.where("parse_error").count() == 3
    row = documents.starts(docs).first()
    assert (row.start_id, row.trainer_name, row.shoes_changed, row.is_winner, row.km_time_s) == ("2025-06-04_23_5_1", "Tr 101", 1, 1, 72.0)
    assert documents.races(docs).first().race_no == 5


def test_cleaning_treats_nan_as_unusable(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 0, math.nan), (2, 1, 3.0), (3, 0, 1.0)], "race_id int, y int, odds double")
    got = market.cleaning_report(market.clean_groups(df, "race_id", F.col("y") == 1, F.col("odds"))).first()
    assert got.asDict() == {"n_races": 3, "excluded_winner": 1, "excluded_value": 1, "n_clean": 1}


def test_sequence_and_sums_before_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(asof, "BLOCK", 7)
    days = [None, None, *[dt.date(2024, 1, 1 + i % 9) for i in range(40)]]
    rows = [(i * 37 % 101, d, None if i % 5 == 0 else i * 1.5, i) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "race_id int, date date, total double, n int")
    seq = asof.race_sequence(df, "date", "race_id")
    order = sorted(rows, key=lambda r: (r[1] or dt.date.min, r[0]))
    assert {r.race_id: r.seq for r in seq.collect()} == {r[0]: k + 1 for k, r in enumerate(order)}
    assert {r.seq for r in asof.race_sequence(df, "race_id").collect()} == set(range(1, len(rows) + 1))
    summed = asof.with_sums_before(seq, s="total", c="n")
    for r in summed.collect():
        earlier = order[: r.seq - 1]
        total = [x[2] for x in earlier if x[2] is not None]
        assert (r.s, r.c) == (sum(total) if total else None, sum(x[3] for x in earlier) if earlier else None)


def test_only_sums_go_through_one_task(spark):
    df = spark.createDataFrame([(1, dt.date(2024, 1, 1), 1, 2)], "race_id int, date date, wins int, n int")
    seq = asof.race_sequence(df, "date", "race_id")

    def check(node):
        if node.nodeName() == "Window" and node.partitionSpec().isEmpty():
            child = node.child()
            while child.nodeName() == "Project":
                child = child.child()
            assert child.nodeName() == "Aggregate"
        for i in range(node.children().size()):
            check(node.children().apply(i))

    for got in (seq, asof.global_prior(seq, "wins", "n", 0.1), asof.par_time(seq, "wins", "n", [["date"]])):
        check(got._jdf.queryExecution().optimizedPlan())


#: A small history and what comes of it.
POINT_IN_TIME = [  # race, day, horse, post, place, km, prize, driver, trainer
    ("R0", "2024-01-01", 1, 1, 1, 75.0, 1000, 10, 20), ("R0", "2024-01-01", 2, 2, 2, 76.0, 500, 11, 21), ("R0", "2024-01-01", 3, 3, 3, 77.0, 250, 11, 21),
    ("R1", "2024-01-08", 1, 1, 1, 74.0, 1000, 10, 20), ("R1", "2024-01-08", 2, 2, 2, 78.0, 500, 11, 21), ("R1", "2024-01-08", 3, 3, None, None, 0, 11, 21),
    ("R2", "2024-01-20", 1, 1, 1, 73.0, 5000, 10, 20), ("R2", "2024-01-20", 2, 2, 2, 79.0, 500, 11, 21),
]


def _point_in_time(spark):
    kinds = {"sex": "string", "sulky_type": "string"} | dict.fromkeys(("km_time_s", "final_odds", "stat_win_pct", "stat_place_pct", "best_km_time_s"), "double")
    starts = spark.createDataFrame(
        [(f"{r}_{h}", r, h, post, h, driver, trainer, 0, place, km, prize, 5.0, int(place == 1)) for r, _, h, post, place, km, prize, driver, trainer in POINT_IN_TIME],
        "start_id string, race_id string, number int, post_position int, horse_id long, driver_id long, trainer_id long, scratched int, place int, "
        "km_time_s double, prize_money long, final_odds double, is_winner int",
    )
    missing = [c for c in (*features.CARRIED, *features.LABELS) if c not in starts.columns]
    starts = starts.withColumns({c: F.lit(None).cast(kinds.get(c, "int")) for c in missing})
    days = sorted({(r, dt.date.fromisoformat(d)) for r, d, *_ in POINT_IN_TIME}) + [("R9", None)]
    races = spark.createDataFrame(
        [(r, d, "19:00", 1, "SE", 2140, "auto", "trot", 3, 1) for r, d in days],
        "race_id string, date date, scheduled_start_time string, track_id int, country string, distance_m int, start_method string, sport string, n_starters int, race_no int",
    )
    return races, starts


@pytest.mark.parametrize("par_least", [1, 30])
def test_features_before_each_race(spark, par_least):
    races, starts = _point_in_time(spark)
    got = {r.start_id: r for r in features.build(races, starts, par_least).collect()}
    assert len(got) == 8
    a, b, c = got["R0_1"], got["R1_1"], got["R2_1"]
    assert (a.hist_starts, a.is_debut, a.days_since_last, a.form_speed, a.elo, a.elo_default, a.cum_earnings, a.field_size) == (0, 1, None, None, 1500.0, 1, 0, 3)
    assert (a.driver_win_rate, a.driver_place_rate) == (pytest.approx(0.10), pytest.approx(0.30))
    assert (b.hist_starts, b.days_since_last, b.cum_earnings, b.elo) == (1, 7.0, 1000, 1512.0) and got["R1_3"].hist_starts == 1
    assert (got["R1_2"].elo, got["R1_3"].elo) == (1500.0, 1488.0)
    assert (c.hist_starts, c.cum_earnings, c.days_since_last, c.avg_earn_per_start, c.field_size, c.form_speed, c.form_n) == (2, 2000, 12.0, 1000.0, 2, 2.0, 1)
    assert (c.driver_n, c.driver_win_rate) == (pytest.approx(1.942031, abs=1e-6), pytest.approx(0.392338, abs=1e-6))


def test_design_matrix_centres_and_scales(spark):
    races, starts = _point_in_time(spark)
    table = features.eligible(features.build(races, starts, 1))
    got = features.design_matrix(table, F.col("date") < F.lit(dt.date(2024, 1, 20)))
    assert len(got.columns) == 2 + 34 and got.count() == 8
    sums = got.groupBy("race_id").agg(*[F.sum(c).alias(c) for c in got.columns[2:]]).collect()
    assert all(abs(r[c]) < 1e-9 for r in sums for c in got.columns[2:])
    # Horse 1 of R1 has 12 more than the mean, horse 3 as much less; R0 has no spread: the deviation of 0, 0, 0, 12, 0, -12.
    assert {r.start_id: r.elo_z for r in got.collect()}["R1_1"] == pytest.approx(12 / math.sqrt(288 / 5))


def _race_document(n, rows):
    starts = []
    for number, horse, odds, place, km, extra in rows:
        s = {"id": f"2025-06-04_23_{n}_{number}", "number": number, "postPosition": number, "distance": 2140, "driver": {"id": 300 + horse, "firstName": "Dr", "lastName": str(horse)},
             "horse": {"id": horse, "name": f"H{horse}", "age": 6, "sex": "gelding", "money": 100000 + horse, "trainer": {"id": 500 + horse, "firstName": "Tr", "lastName": str(horse)}},
             "result": {"finalOdds": odds} | ({"place": place} if place else {}) | ({"kmTime": km} if km else {})}
        s["horse"] |= extra.pop("horse", {})
        s["result"] |= extra.pop("result", {})
        starts.append(s | extra)
    return json.dumps({"id": f"2025-06-04_23_{n}", "date": "2025-06-04", "number": n, "sport": "trot", "startMethod": "auto", "distance": 2140,
                       "status": "results", "track": {"id": 23, "name": "Solvalla", "countryCode": "SE"}, "starts": starts})


def test_parsed_documents(spark):
    time = lambda s: {"minutes": 1, "seconds": s, "tenths": 0}
    shoe = {"horse": {"shoes": {"front": {"changed": True, "hasShoe": False}}}}
    five = _race_document(5, [(1, 101, 2.0, 1, time(12), dict(shoe)), (2, 102, 4.0, 2, time(13), {}),
                              (3, 103, 5.0, None, {"code": "2"}, {"result": {"galloped": True, "disqualified": True}}), (4, 104, 0.0, None, None, {"scratched": True})])
    six = _race_document(6, [(1, 111, 1.5, 2, time(12), dict(shoe)), (2, 112, 3.0, 1, time(11), {"horse": {"sulky": {"type": {"text": "Amerikansk", "engText": "American"}}}}),
                             (3, 113, 6.0, 3, time(14), {"horse": {"sulky": {"type": "Standard"}}, "originalDriver": {"id": 9}})])
    odd = json.dumps({"id": "2025_x", "date": "soon", "number": "12.5", "starts": []})
    docs = documents.parsed(spark.createDataFrame([(five,), (six,), (odd,)], "json string"))
    races = {r.race_id: r for r in documents.races(docs).collect()}
    assert (len(documents.races(docs).columns), len(documents.starts(docs).columns)) == (14, 38)
    assert (races["2025-06-04_23_5"].race_no, races["2025-06-04_23_5"].n_starters, races["2025-06-04_23_6"].n_starters) == (5, 3, 3)
    assert (races["2025_x"].date, races["2025_x"].race_no, races["2025_x"].n_starters) == (None, None, 0)
    starts = documents.starts(docs)
    counts = reports.start_counts(starts).first()
    assert tuple(counts) == (7, 6, 1, 1, 6)
    assert tuple(reports.winner_counts(starts).first()) == (0, 0)
    assert tuple(reports.parse_quality(docs, starts).first()) == (3, 0, 0, 0)
    got = {r.start_id: r for r in starts.collect()}
    x = got["2025-06-04_23_5_3"]
    assert (x.trainer_name, x.galloped, x.disqualified, x.place, x.km_time_s, x.is_winner) == ("Tr 103", 1, 1, None, None, 0)
    y = got["2025-06-04_23_5_1"]
    assert (y.shoes_changed, y.shoe_front_on, y.shoe_back_on, y.career_money, y.driver_id, y.driver_changed) == (1, 0, None, 100101, 401, 0)
    assert [got[f"2025-06-04_23_6_{i}"].sulky_type for i in (1, 2, 3)] == [None, "American", "Standard"]
    assert got["2025-06-04_23_6_3"].driver_changed == 1
    ran = starts.where("scratched = 0").withColumn("y", F.col("is_winner")).withColumn("p", market.from_odds(F.col("final_odds"), "race_id"))
    losses = scoring.mean_losses(scoring.race_losses(ran)).first()
    assert (losses["log_loss"], losses["brier"]) == (pytest.approx(0.947308, abs=1e-6), pytest.approx(0.597546, abs=1e-6))
    assert reports.sample_race(documents.races(docs), starts).count() == 1


def test_race_without_known_winner_is_counted(spark):
    df = spark.createDataFrame([("A", None, 2.0), ("B", 1, 2.0)], "race_id string, y int, odds double")
    got = market.cleaning_report(market.clean_groups(df, "race_id", F.col("y") == 1, F.col("odds"))).first()
    assert tuple(got) == (2, 1, 0, 1)


def test_race_bootstrap_covers_the_mean(spark):
    df = spark.range(400).select(F.col("id").alias("race_id"), (F.rand(3) - 0.4).alias("diff"))
    low, high = scoring.race_bootstrap(df, n_boot=500)
    mean, sd = df.agg(F.avg("diff"), F.stddev("diff")).first()
    assert low < mean < high and (high - low) / (2 * 1.96 * sd / 20) == pytest.approx(1, abs=0.15)


def test_folds_go_on_to_the_last_date(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i),) for i in range(91)], "date date")
    got = {(r.fold, r.part): (r.n, r.a, r.b) for r in splits.walk_forward(df, dt.date(2024, 3, 1), 10, purge_days=3).groupBy("fold", "part").agg(
        F.count("*").alias("n"), F.min("date").alias("a"), F.max("date").alias("b")).collect()}
    assert got[0, "train"][2] == dt.date(2024, 2, 26) and got[0, "test"][1:] == (dt.date(2024, 3, 1), dt.date(2024, 3, 10))
    assert max(f for f, _ in got) == 3 and got[3, "test"][0] == 1
