"""Queries of the feature table and the reports over the driver tables, with their SQL.

An order is a race, its lines are starts: part = horse and trainer, supplier = driver, line number =
post, extended price decides the place, quantity gives the time. Lines of quantity 50 are scratched.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.functions import documents
from furlong.operators import features, market, reports, scoring
from furlong.plans import driver_queries


def races(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.selectExpr(
        "o_orderkey as race_id", "to_date(o_orderdate) as date", "cast(null as string) as scheduled_start_time",
        "cast(o_custkey % 7 as int) as track_id", "o_orderstatus as country", "cast(1600 + 200 * (o_custkey % 8) as int) as distance_m",
        "o_orderpriority as start_method", "case when o_custkey % 5 = 0 then 'monte' else 'trot' end as sport",
        "cast(o_orderkey % 12 as int) as race_no", "cast(null as int) as n_starters",
    )


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("scratched", (F.col("l_quantity") == 50).cast("int"))
    w = Window.partitionBy("l_orderkey", "scratched").orderBy(F.col("l_extendedprice").desc())
    return x.withColumn("place", F.when(F.col("scratched") == 0, F.rank().over(w))).selectExpr(
        "concat(l_orderkey, '_', cast(floor(l_extendedprice * 100) as bigint)) as start_id", "l_orderkey as race_id", "l_linenumber as number",
        "nullif(l_linenumber % 6, 0) as post_position", "cast(2140 as int) as start_distance_m", "l_partkey as horse_id",
        "cast(3 + l_partkey % 9 as int) as age", "case l_partkey % 3 when 0 then 'mare' when 1 then 'gelding' else 'stallion' end as sex",
        "cast(l_partkey % 2 as int) as shoes_changed", "cast(null as int) as shoe_front_changed", "cast(null as int) as shoe_back_changed",
        "cast(l_suppkey % 2 as int) as sulky_changed", "nullif(l_suppkey, 7) as driver_id", "l_partkey % 300 as trainer_id", "scratched", "place",
        "case when l_quantity < 45 then 70 + l_quantity / 10 end as km_time_s", "cast(floor(l_extendedprice / 100) as bigint) as prize_money",
        "l_quantity / 5 as final_odds", "cast(place = 1 as int) as is_winner", "cast(l_returnflag = 'R' as int) as galloped_or_dq",
        "cast(l_partkey % 50 as int) as stat_life_starts", "l_discount as stat_win_pct", "l_tax as stat_place_pct",
        "case when l_linestatus = 'O' then cast(floor(l_extendedprice) as bigint) end as stat_earn_per_start",
        "cast(l_suppkey % 40 as int) as stat_start_points", "cast(null as double) as best_km_time_s",
        "cast(nullif(l_suppkey % 3, 2) as int) as shoe_front_on", "cast(nullif(l_partkey % 4, 3) % 2 as int) as shoe_back_on",
        "case when l_partkey % 4 = 0 then 'American' when l_partkey % 4 = 1 then 'Standard' end as sulky_type",
        "cast(l_suppkey % 5 = 0 as int) as driver_changed",
    )


def _features(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return features.build(races(spark, sf_dir), starts(spark, sf_dir), elo=False, columns=("start_id", *columns))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    # Plus 0, so that no negative zero is left.
    return df.select("start_id", *[(F.round(F.col(c).cast("double"), 6) + 0.0).alias(c) for c in columns])


#: Added before rounding, because engines round exact halves differently.
NUDGE = 1e-9
FORM = ("form_speed", "form_n", "form_method_speed")
HISTORY = ("hist_starts", "is_debut", "days_since_last", "cum_earnings", "avg_earn_per_start", "field_size", "post_rel")
PEOPLE = ("driver_win_rate", "driver_place_rate", "driver_n", "trainer_win_rate", "trainer_place_rate", "trainer_n")


def form_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_features(spark, sf_dir, *FORM), *FORM)


def class_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_features(spark, sf_dir, "class_move"), "class_move")


def draw_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_features(spark, sf_dir, "draw_win_rate"), "draw_win_rate")


def people_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_features(spark, sf_dir, *PEOPLE), *PEOPLE)


def horse_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_features(spark, sf_dir, *HISTORY), *HISTORY)


def history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the last month, from the history of all races before it."""
    r, s = races(spark, sf_dir), starts(spark, sf_dir)
    cut = r.agg(F.max("date")).first()[0] - dt.timedelta(days=30)
    _, history = features.build(r.where(F.col("date") < F.lit(cut)), s, elo=False, keep=True)
    got = features.build(r.where(F.col("date") >= F.lit(cut)), s, elo=False, history=history)
    return _rounded(got, *FORM, "class_move", "draw_win_rate", *PEOPLE, *HISTORY)


def _inputs() -> list[str]:
    return [k for k in features.INPUTS if k not in ("elo", "elo_default")]


def design_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trotting runners; the scale is of races before 2000. Ratings have a query of their own."""
    used = [c for c in features.OUTPUTS if c in (*features.PLAIN, *features.LOGS, "shoe_front_on", "shoe_back_on", "sulky_type", "sex")]
    trot = _features(spark, sf_dir, "race_id", "date", "sport", "is_winner", "final_odds", *used).where("sport = 'trot'")
    got = features.design_matrix(features.eligible(trot), F.col("date") < F.lit("2000-01-01").cast("date"))
    return _rounded(got, *[f"{k}_z" for k in _inputs()])


def race_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priors, field class, par time and day variant of each race."""
    ran = starts(spark, sf_dir).where("scratched = 0").join(features.dated(races(spark, sf_dir)), "race_id")
    got = features.race_states(ran)
    return got.select("race_id", "field_size", *[F.round(F.col(c) + NUDGE, 6).alias(c) for c in ("win_prior", "place_prior", "field_class", "par", "variant")])


def odds_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = starts(spark, sf_dir).where("scratched = 0")
    return s.select("start_id", F.round(market.from_odds(F.col("final_odds"), "race_id") + NUDGE, 6).alias("p"))


def coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = races(spark, sf_dir)
    return reports.coverage(r, F.col("date"), n_countries=F.countDistinct("country"), n_trot=F.count_if(F.expr("sport = 'trot'")))


def country_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.counts_by(races(spark, sf_dir), F.col("country"), "country")


def sport_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return races(spark, sf_dir).groupBy("sport").agg(F.count("*").alias("n"), F.countDistinct("race_id").alias("n_races"))


def start_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.start_counts(starts(spark, sf_dir))


def winner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.winner_counts(starts(spark, sf_dir).withColumn("is_winner", F.col("galloped_or_dq")))


def json_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = documents.parsed(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("props").alias("json")), needs_id=False)
    k = documents.path(F.col("doc"), "$.k", "bigint")
    return e.agg(F.count("*").alias("documents_read"), F.count_if("parse_error").alias("parse_errors"), F.count_if(k.isNull()).alias("missing_k"))


def calibration_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = driver_queries._market(spark, sf_dir)
    bins = scoring.calibration(m, n_bins=10, strategy="quantile")
    return bins.select("bin", F.round("p_mean", 6).alias("p_mean"), F.round("y_rate", 6).alias("y_rate"), "n")


def skill_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill and Brier gain of the market's power form over the market."""
    m = driver_queries._market(spark, sf_dir)
    both = scoring.paired_differences(m.withColumn("p", market.power_share(F.col("p"), 1.15, "race_id")), m)
    means = both.agg(*[F.avg(c).alias(c) for c in ("model", "market", "model_brier", "market_brier")], F.count("*").alias("n_races"))
    return means.select(
        "n_races", F.round(1 - F.col("model") / F.col("market"), 6).alias("skill"),
        F.round(1 - F.col("model_brier") / F.col("market_brier"), 6).alias("brier_skill"),
    )


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "event_id", "value")
    return documents.first_wins(e, ["user_id", "event_type"], "event_id")


def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "event_id", "value")
    return documents.last_wins(e, ["user_id", "event_type"], "event_id")


def queries() -> dict:
    every = (
        form_speed, class_move, draw_rate, people_rates, horse_history, history_features, design_matrix, race_states, odds_market, coverage_counts,
        country_counts, sport_counts, start_counts, winner_counts, json_quality_report, calibration_quantile, skill_score, dedup_first, dedup_last,
    )
    return {f.__name__: f for f in every}


_BEFORE = "order by seq range between unbounded preceding and 1 preceding"

STARTS_SQL = """with races as (select o_orderkey race_id, cast(o_orderdate as date) date, cast(o_custkey % 7 as int) track_id, o_orderstatus country,
 1600 + 200 * (o_custkey % 8) distance_m, o_orderpriority start_method, case when o_custkey % 5 = 0 then 'monte' else 'trot' end sport, o_orderkey % 12 race_no from orders),
 placed as (select *, (l_quantity = 50)::int scratched, rank() over (partition by l_orderkey, l_quantity = 50 order by l_extendedprice desc) k from lineitem),
 starts as (select l_orderkey || '_' || cast(floor(l_extendedprice * 100) as bigint) start_id, l_orderkey race_id, nullif(l_linenumber % 6, 0) post_position,
 l_partkey horse_id, 3 + l_partkey % 9 age, l_partkey % 3 sex3, l_partkey % 2 shoes_changed, l_suppkey % 2 sulky_changed, nullif(l_suppkey, 7) driver_id,
 l_partkey % 300 trainer_id, scratched, case when scratched = 0 then k end place, case when l_quantity < 45 then 70 + l_quantity / 10 end km,
 cast(floor(l_extendedprice / 100) as bigint) prize, l_quantity / 5 final_odds, case when scratched = 0 and k = 1 then 1 else 0 end won,
 (l_returnflag = 'R')::int galloped_or_dq, l_partkey % 50 life_starts, l_discount win_pct, l_tax place_pct,
 case when l_linestatus = 'O' then cast(floor(l_extendedprice) as bigint) end earn, l_suppkey % 40 points, nullif(l_suppkey % 3, 2) front_on,
 nullif(l_partkey % 4, 3) % 2 back_on, l_partkey % 4 = 0 american, (l_suppkey % 5 = 0)::int driver_changed from placed)
"""

STATES_SQL = STARTS_SQL + f""", seqs as (select *, row_number() over (order by date, race_no, race_id) seq,
 cast(date_diff('day', (select min(date) from races), date) as double) as day,
 case when distance_m < 1800 then 1 when distance_m < 2200 then 2 when distance_m < 2700 then 3 else 4 end bucket from races),
 ran as (select s.*, r.* exclude (race_id) from starts s join seqs r using (race_id) where scratched = 0),
 r1 as (select race_id, seq, day, sport, start_method, track_id, bucket, count(*) field_size, sum(won) wins, count(*) filter (place <= 3) top3,
 sum(km) km_total, count(km) km_n, ln(1 + avg(earn)) field_class from ran group by all),
 r2 as (select *, coalesce(sum(wins) over w / sum(field_size) over w, 0.1) win_prior, coalesce(sum(top3) over w / sum(field_size) over w, 0.3) place_prior,
 coalesce(case when sum(km_n) over a >= 30 then sum(km_total) over a / sum(km_n) over a end, case when sum(km_n) over b >= 30 then sum(km_total) over b / sum(km_n) over b end,
 case when sum(km_n) over c >= 30 then sum(km_total) over c / sum(km_n) over c end, case when sum(km_n) over d >= 30 then sum(km_total) over d / sum(km_n) over d end,
 sum(km_total) over w / nullif(sum(km_n) over w, 0)) par from r1
 window w as ({_BEFORE}), a as (partition by sport, start_method, track_id, bucket {_BEFORE}), b as (partition by sport, start_method, bucket {_BEFORE}),
 c as (partition by sport, start_method {_BEFORE}), d as (partition by sport {_BEFORE})),
 r3 as (select *, case when par is not null and km_n > 0 then km_total - km_n * par end dev, case when par is not null then km_n else 0 end dev_n, pow(2.0, day / 30) w30 from r2),
 states as (select *, coalesce(case when sum(dev_n) over t >= 5 then sum(dev) over t / sum(dev_n) over t end,
 sum(w30 * dev / nullif(dev_n, 0)) over k / sum(case when dev is not null then w30 end) over k, 0) variant from r3
 window t as (partition by track_id, day {_BEFORE}), k as (partition by track_id {_BEFORE}))
"""

FEATURES_SQL = STATES_SQL + f""", f1 as (select r.*, s.field_size, s.win_prior, s.place_prior, s.field_class, s.variant - (r.km - s.par) speed,
 pow(2.0, r.day / 120) w120, pow(2.0, r.day / 180) w180, pow(2.0, r.day / 365) w365, pow(2.0, r.day / 1460) w1460, case when r.place <= 3 then 1 else 0 end top3
 from ran r join states s using (race_id)),
 f2 as (select *, count(*) over h hist_starts, day - max(day) over h days_since_last, coalesce(sum(prize) over h, 0) cum_earnings, count(speed) over h form_n,
 sum(w120 * speed) over h / sum(case when speed is not null then w120 end) over h form_speed,
 sum(w120 * speed) over hm / sum(case when speed is not null then w120 end) over hm form_method_speed,
 field_class - sum(w180 * field_class) over h / sum(case when field_class is not null then w180 end) over h class_move,
 case when post_position is not null then (coalesce(sum(w1460 * won) over p, 0) / w1460 + 25 * win_prior) / (coalesce(sum(w1460) over p, 0) / w1460 + 25) end draw_win_rate,
 case when driver_id is not null then coalesce(sum(w365) over d, 0) / w365 end driver_n, coalesce(sum(w365) over t, 0) / w365 trainer_n,
 coalesce(sum(w365 * won) over d, 0) / w365 dw, coalesce(sum(w365 * top3) over d, 0) / w365 dp, coalesce(sum(w365 * won) over t, 0) / w365 tw, coalesce(sum(w365 * top3) over t, 0) / w365 tp
 from f1 window h as (partition by horse_id {_BEFORE}), hm as (partition by horse_id, start_method {_BEFORE}), d as (partition by driver_id {_BEFORE}),
 t as (partition by trainer_id {_BEFORE}), p as (partition by track_id, start_method, post_position {_BEFORE})),
 features as (select *, post_position / field_size post_rel, case when hist_starts = 0 then 1 else 0 end is_debut, case when hist_starts > 0 then cum_earnings / hist_starts end avg_earn_per_start,
 (dw + 20 * win_prior) / (driver_n + 20) driver_win_rate, (dp + 20 * place_prior) / (driver_n + 20) driver_place_rate,
 (tw + 20 * win_prior) / (trainer_n + 20) trainer_win_rate, (tp + 20 * place_prior) / (trainer_n + 20) trainer_place_rate from f2)
"""

#: Inputs of the matrix as expressions of ``features``, where the name alone does not say it.
_AS = {
    "stat_win_pct": "win_pct", "stat_place_pct": "place_pct", "best_km_time_s": "cast(null as double)", "stat_start_points": "points",
    "barefoot_front": "1.0 - front_on", "barefoot_back": "1.0 - back_on", "is_american_sulky": "american::int", "age2": "age * age",
    "is_mare": "(sex3 = 0)::int", "is_stallion": "(sex3 = 2)::int", "log_stat_earn_per_start": "ln(1 + earn)", "log_stat_life_starts": "ln(1 + life_starts)",
}


def _matrix_sql() -> str:
    names = _inputs()
    value = lambda k: _AS.get(k) or (f"ln(1 + {k[4:]})" if k.startswith("log_") else k)
    raw = ", ".join(f"cast({value(k)} as double) {k}" for k in names)
    fill = ", ".join(f"coalesce({k}, avg({k}) over (partition by race_id), 0) {k}" for k in names)
    centre = ", ".join(f"{k} - avg({k}) over (partition by race_id) {k}" for k in names)
    scale = ", ".join(f"stddev_samp({k}) filter (date < date '2000-01-01') {k}_s" for k in names)
    out = ", ".join(f"round({k} / case when {k}_s > 1e-12 then {k}_s else 1.0 end, 6) + 0.0 {k}_z" for k in names)
    good = "select race_id from features where sport = 'trot' group by 1 having sum(won) = 1 and min(final_odds) > 0"
    return (
        f", m1 as (select start_id, race_id, date, {raw} from features where sport = 'trot' and race_id in ({good})), m2 as (select start_id, race_id, date, {fill} from m1)"
        f", m3 as (select start_id, race_id, date, {centre} from m2), sc as (select {scale} from m3) select start_id, {out} from m3, sc"
    )


def oracle_sql() -> dict[str, str]:
    picked = lambda *columns: "select start_id, " + ", ".join(f"round(cast({c} as double), 6) + 0.0 {c}" for c in columns) + " from features"
    per_key = "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id {}) = 1"
    market_sql = driver_queries.RUNNERS_SQL
    edges = ", e as (select list_sort(list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) e from market)"
    power = ", q as (select *, pow(p, 1.15) / sum(pow(p, 1.15)) over (partition by race_id) q from market), l as (select race_id, -ln(max(case when y = 1 then p end)) a, -ln(max(case when y = 1 then q end)) b, sum((p - y) * (p - y)) c, sum((q - y) * (q - y)) d from q group by 1)"
    return {
        "form_speed": FEATURES_SQL + picked(*FORM),
        "class_move": FEATURES_SQL + picked("class_move"),
        "draw_rate": FEATURES_SQL + picked("draw_win_rate"),
        "people_rates": FEATURES_SQL + picked(*PEOPLE),
        "horse_history": FEATURES_SQL + picked(*HISTORY),
        "history_features": FEATURES_SQL + picked(*FORM, "class_move", "draw_win_rate", *PEOPLE, *HISTORY) + " where date >= (select max(date) from races) - 30",
        "design_matrix": FEATURES_SQL + _matrix_sql(),
        "race_states": STATES_SQL + "select race_id, field_size, round(win_prior + 1e-9, 6) win_prior, round(place_prior + 1e-9, 6) place_prior, round(field_class + 1e-9, 6) field_class, round(par + 1e-9, 6) par, round(variant + 1e-9, 6) variant from states",
        "odds_market": STARTS_SQL + "select start_id, round((1 / final_odds) / sum(1 / final_odds) over (partition by race_id) + 1e-9, 6) p from starts where scratched = 0",
        "coverage_counts": STARTS_SQL + "select count(*) n_rows, min(date) date_min, max(date) date_max, count(distinct country) n_countries, count(*) filter (sport = 'trot') n_trot from races",
        "country_counts": STARTS_SQL + "select country, count(*) n from races group by 1 order by 2 desc, 1",
        "sport_counts": STARTS_SQL + "select sport, count(*) n, count(distinct race_id) n_races from races group by 1",
        "start_counts": STARTS_SQL + "select count(*) n_starts, count(*) filter (scratched = 0) starts_ran, count(*) filter (scratched = 1) scratched, count(*) filter (galloped_or_dq = 1) galloped_or_dq, count(*) filter (scratched = 0 and final_odds > 0) starts_with_final_odds from starts",
        "winner_counts": STARTS_SQL + "select count(*) filter (w = 0) races_no_winner, count(*) filter (w > 1) races_multi_winner from (select race_id, sum(galloped_or_dq) w from starts group by 1)",
        "json_quality_report": "select count(*) documents_read, count(*) filter (coalesce(json_type(try_cast(props as json)), '') <> 'OBJECT') parse_errors, count(*) filter (try_cast(json_extract_string(props, '$.k') as bigint) is null) missing_k from events",
        "calibration_quantile": market_sql + edges + ", b as (select p, y, cast(len(list_filter(e[2:len(e) - 1], lambda x: x <= p)) as int) bin from market, e) select bin, round(avg(p), 6) p_mean, round(avg(y), 6) y_rate, count(*) n from b group by 1",
        "skill_score": market_sql + power + " select count(*) n_races, round(1 - avg(b) / avg(a), 6) skill, round(1 - avg(d) / avg(c), 6) brier_skill from l",
        "dedup_first": per_key.format(""),
        "dedup_last": per_key.format("desc"),
    }
