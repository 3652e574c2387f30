"""The network source, pacing and retries, the store and both forms of ingest."""

import datetime as dt
import json

import pytest

from furlong.sources import landing, network, store

DAY = dt.date(2024, 1, 1)


class Clock:
    """Time that only passes when somebody sleeps, and a tenth of a second a request."""

    def __init__(self, answers):
        self.now, self.slept, self.asked, self.answers = 0.0, [], [], list(answers)

    def sleep(self, seconds):
        self.slept.append(round(seconds, 6))
        self.now += seconds

    def get(self, path):
        self.asked.append(round(self.now, 6))
        self.now += 0.1
        got = self.answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    def fetcher(self, **more):
        return network.Fetcher(self.get, clock=lambda: self.now, sleep=self.sleep, **more)


def test_requests_keep_their_distance():
    clock = Clock([(200, "{}")] * 3)
    fetcher = clock.fetcher()
    assert [fetcher.fetch("/x") for _ in range(2)] == ["{}", "{}"]
    clock.now += 5
    fetcher.fetch("/x")
    assert clock.slept == [0.4] and clock.asked == [0.0, 0.5, 5.6] and fetcher.requests == 3


@pytest.mark.parametrize("problem", [(429, ""), (500, ""), (503, "{}"), (200, "<html>"), ConnectionResetError("gone"), TimeoutError("slow")])
def test_passing_problems_are_tried_again(problem):
    clock = Clock([problem, problem, (200, '{"a": 1}')])
    assert clock.fetcher().fetch("/x") == '{"a": 1}'
    assert clock.slept == [1.0, 2.0]
    clock = Clock([problem] * 4)
    with pytest.raises(network.FetchError, match="after 4 attempts"):
        clock.fetcher().fetch("/x")
    assert clock.slept == [1.0, 2.0, 4.0] and len(clock.asked) == 4


def test_not_found_and_refused_are_not_tried_again():
    clock = Clock([(404, "")])
    assert clock.fetcher().document("race", "r") == (None, None)
    clock = Clock([(403, "")])
    assert clock.fetcher().document("race", "r") == (None, "/races/r: status 403")
    assert clock.slept == [] and len(clock.asked) == 1


def test_short_waits_are_filled_up_to_the_delay():
    clock = Clock([(500, ""), (200, "[]")])
    assert clock.fetcher(delay=3.0).fetch("/x") == "[]"
    assert clock.slept == [1.0, 2.0]


def refusing(root="", **_):
    """A folder whose second of January cannot be read."""
    get = network.folder(root)
    return lambda path: (403, "") if path.endswith("2024-01-02") else get(path)


def race(i, status="results"):
    return {"id": i, "status": status}


@pytest.fixture
def land(tmp_path):
    for kind in ("calendar", "race", "game"):
        (tmp_path / "landing" / kind).mkdir(parents=True)
    calendar = {
        "tracks": [
            {"sport": "trot", "countryCode": "SE", "races": [race("r1"), race("r2"), race("r3", "upcoming"), race("gone")]},
            {"sport": "gallop", "countryCode": "SE", "races": [race("r4")]},
            {"sport": "trot", "country": "NO", "races": [race("r5")]},
        ],
        "games": {"V75": [{"id": "V75_2024-01-01_5_1"}, {"id": "g2"}], "other": [{"id": "g3"}]},
    }
    top = tmp_path / "landing"
    (top / "calendar/2024-01-01.json").write_text(json.dumps(calendar))
    for i in (2, 3, 5):
        other = {"tracks": [{"sport": "trot", "countryCode": "SE", "races": [race(f"d{i}")]}]}
        (top / f"calendar/2024-01-0{i}.json").write_text(json.dumps(other))
        (top / f"race/d{i}.json").write_text(json.dumps({"id": f"d{i}"}))
    document = {"id": "r1", "date": "2024-01-01", "sport": "trot", "status": "results", "track": {"id": 23, "name": "Solvalla", "countryCode": "SE"}}
    (top / "race/r1.json").write_text(json.dumps(document))
    for i in ("r4", "r5"):
        (top / f"race/{i}.json").write_text(json.dumps({"id": i}))
    (top / "race/r2.json").write_text("<html>")
    (top / "game/V75_2024-01-01_5_1.json").write_text(json.dumps({"id": "V75_2024-01-01_5_1", "status": "results"}))
    (top / "game/g2.json").write_text(json.dumps({"id": "g2", "status": "open"}))
    return top


def read(spark, root, **options):
    spark.dataSource.register(network.DocumentSource)
    return spark.read.format("racing_documents").options(transport="furlong.sources.network:folder", root=str(root), delay="0", **options).load()


def test_source_equals_the_landing_folder(spark, land):
    got = read(spark, land, kind="calendar", first="2023-12-30", last="2024-01-04")
    assert got.rdd.getNumPartitions() == 6
    kept = landing.documents(spark, f"{land}/calendar").where("key < '2024-01-05'").select("key", "json")
    assert sorted(map(tuple, got.select("key", "json").collect())) == sorted(map(tuple, kept.collect())) and kept.count() == 3
    races = read(spark, land, kind="race", keys="r1,r2,none,r4", readers="2", attempts="1").collect()
    assert sorted((r.key, r.json is not None, r.failure and r.failure.split(":")[0]) for r in races) == [("r1", True, None), ("r2", False, "/races/r2"), ("r4", True, None)]


def test_readers_share_the_delay():
    assert network._fetcher({"transport": "furlong.sources.network:folder", "root": "x", "delay": "0.5"}, 4).delay == 2.0


def test_ingest_is_resumable(spark, land, tmp_path):
    at, second = str(tmp_path / "store"), DAY + dt.timedelta(days=3)
    days = lambda **more: sorted(
        tuple(r) for r in store.ingest(spark, store.from_landing(str(land)), at, DAY, second, ["SE"], **more).collect() if r.day in (DAY, second)
    )
    assert days() == [(DAY, 1, 1, 1, False), (second, 0, 0, 0, True)]
    (land / "race/r2.json").write_text(json.dumps({"id": "r2"}))
    assert days() == [(DAY, 2, 1, 0, True)]
    assert days() == []
    (land / "race/r1.json").write_text(json.dumps({"id": "r1", "distance": 2140}))
    (land / "race/r2.json").unlink()
    assert days(refetch=True) == [(DAY, 2, 1, 0, True), (second, 0, 0, 0, True)]
    held = {r.key: json.loads(r.json) for r in store.current(spark, at, "race").where(f"day = '{DAY}'").collect()}
    assert held == {"r1": {"id": "r1", "distance": 2140}, "r2": {"id": "r2"}}
    assert not (tmp_path / "store/staging").exists() or not list((tmp_path / "store/staging").iterdir())
    assert landing.days(spark, second, DAY).isEmpty()


def test_store_keeps_keys_and_one_file_a_day(spark, land, tmp_path):
    at = str(tmp_path / "store")
    for _ in range(3):
        store.ingest(spark, store.from_landing(str(land)), at, DAY, DAY + dt.timedelta(days=4), ["SE"], refetch=True)
    files = [p.parent.name for p in (tmp_path / "store/race").rglob("*.parquet")]
    assert sorted(files) == ["day=2024-01-01", "day=2024-01-02", "day=2024-01-03", "day=2024-01-05"]
    r1 = store.current(spark, at, "race").where("key = 'r1'").first()
    assert (r1.race_date, r1.track_id, r1.track_name, r1.sport, r1.country, r1.status) == (DAY, 23, "Solvalla", "trot", "SE", "results")
    game = store.current(spark, at, "game").first()
    assert (game.key, game.game_type, game.game_date, game.status) == ("V75_2024-01-01_5_1", "V75", DAY, "results")
    one_day = store.stored(spark, f"{at}/race", store.STORED["race"]).where(f"day = '{DAY}'")
    assert "PartitionFilters: [isnotnull(day" in one_day._jdf.queryExecution().executedPlan().toString() and one_day.count() == 1


def test_stream_isolates_a_bad_day(spark, land, tmp_path):
    at, last = str(tmp_path / "store"), DAY + dt.timedelta(days=4)
    asked = []

    def fetch(transport):
        options = {"transport": transport, "root": str(land), "delay": "0", "attempts": "1"}

        def run(kind, keys):
            if kind == "calendar":
                asked.append(sorted(r.key for r in keys.collect()))
            return network.fetch_keys(keys, kind, options, readers=2)

        return run

    run = lambda name: {
        str(r.day)[-1]: (r.n_races, r.n_fail, r.done)
        for r in store.ingest_stream(spark, fetch(name), at, DAY, last, ["SE"], skip_games=True, days_per_batch=2).collect()
    }
    (land / "race/r2.json").unlink()
    assert run("tests.test_sources:refusing") == {"1": (1, 0, True), "2": (0, 1, False), "3": (1, 0, True), "4": (0, 0, True), "5": (1, 0, True)}
    assert asked == [["2024-01-01", "2024-01-02"], ["2024-01-03", "2024-01-04"], ["2024-01-05"]]
    assert run("furlong.sources.network:folder") == {"2": (1, 0, True)}
    assert asked[3:] == [["2024-01-02"]]
    assert run("furlong.sources.network:folder") == {}
    assert sorted(r.key for r in store.current(spark, at, "race").collect()) == ["d2", "d3", "d5", "r1"]
