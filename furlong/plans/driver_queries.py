"""Queries of the library's own operators over the driver tables, with their SQL.

An order is a race, its lines are runners: part = horse, supplier = driver, extended price
decides the winner, quantity is the market's weight and the time.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.operators import asof, forecasts, market, models, ratings, scoring, splits
from furlong.operators.quantiles import exact_quantiles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("race_id"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"),
        F.col("l_partkey").alias("horse"), F.col("l_suppkey").alias("driver"),
    )
    orders = _table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("race_id"), F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("method")
    )
    w = Window.partitionBy("race_id")
    day = F.datediff("date", F.lit(dt.date(1995, 1, 1))).cast("double")
    place = F.rank().over(w.orderBy(F.col("price").desc()))
    return lines.join(orders, "race_id").select(
        "*", (F.col("price") == F.max("price").over(w)).cast("int").alias("y"), day.alias("day"), place.alias("place")
    )


def sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runners with seq; the global order is taken over one row per race."""
    r = runners(spark, sf_dir)
    races = asof.race_sequence(r.select("race_id", "date").distinct(), "date", "race_id").select("race_id", "seq")
    return r.join(races, "race_id")


RUNNERS_SQL = """with runners as (select l_orderkey race_id, l_extendedprice price, l_quantity qty, l_partkey horse, l_suppkey driver,
 cast(o_orderdate as date) date, o_orderpriority as method,
 case when l_extendedprice = max(l_extendedprice) over (partition by l_orderkey) then 1 else 0 end y,
 cast(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as double) as day,
 rank() over (partition by l_orderkey order by l_extendedprice desc) place
 from lineitem join orders on l_orderkey = o_orderkey),
 market as (select *, qty / sum(qty) over (partition by race_id) p from runners),
 loss as (select race_id, any_value(date) date, -ln(max(case when y = 1 then p end)) log_loss, sum((p - y) * (p - y)) brier from market group by race_id),
 seqs as (select race_id, row_number() over (order by date, race_id) seq from (select distinct race_id, date from runners)),
 sequenced as (select r.*, seq from runners r join seqs using (race_id))
"""


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runners(spark, sf_dir).withColumn("p", market.share_of_group(F.col("qty"), "race_id"))


def market_logloss_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scoring.mean_losses(scoring.race_losses(_market(spark, sf_dir)))
    return got.select("n_races", F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"))


def market_overround(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = runners(spark, sf_dir).groupBy("race_id").agg((F.sum("qty") / 100).alias("total"))
    middle = exact_quantiles(per, "total", [0.5])
    return spark.createDataFrame([tuple(middle or [None])], "median double").select(F.round("median", 6).alias("median_overround"))


def race_cleaning_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    return market.cleaning_report(market.clean_groups(lines, "l_orderkey", F.col("l_returnflag") == "R", F.col("l_quantity") - 5))


def _rounded(df: DataFrame, value, name: str) -> DataFrame:
    return df.select("race_id", "price", F.round(value, 6).alias(name))


def devig_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_market(spark, sf_dir), F.col("p"), "p")


def power_recalibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_market(spark, sf_dir), market.power_share(F.col("p"), 1.15, "race_id"), "p")


def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(runners(spark, sf_dir), market.softmax_in_group(F.col("qty") / 10, "race_id"), "p")


def centred_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(runners(spark, sf_dir), market.centred(F.when(F.col("qty") > 10, F.col("qty")), "race_id"), "x")


def calibration_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = scoring.calibration(_market(spark, sf_dir), strategy="uniform")
    return bins.select("bin", F.round("p_mean", 6).alias("p_mean"), F.round("y_rate", 6).alias("y_rate"), "n")


def murphy_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scoring.murphy(scoring.calibration(_market(spark, sf_dir), strategy="uniform"))
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


def clustered_mean_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _market(spark, sf_dir)
    losses = scoring.race_losses(m).join(m.groupBy("race_id").agg(F.min("date").alias("date")), "race_id")
    got = scoring.clustered_test(losses, "date", "log_loss")
    return got.select("n", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"))


def hist_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sequenced(spark, sf_dir)
    n = asof.prior_count(["horse"])
    return r.select(
        "race_id", "price", n.alias("hist_starts"), asof.days_since(F.col("day"), ["horse"]).alias("days_since_last"),
        F.round(asof.prior_sum(F.col("price"), ["horse"]), 2).alias("cum_earnings"),
    )


def driver_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate, n = asof.decayed_rate(F.col("y"), F.lit(0.1), F.col("day"), ["driver"], 365.0, 20.0)
    return sequenced(spark, sf_dir).select("race_id", "price", F.round(rate, 6).alias("rate"), F.round(n, 6).alias("n"))


def class_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sequenced(spark, sf_dir), asof.decayed_mean(F.col("qty"), F.col("day"), ["horse"], 120.0), "form")


def _race_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequenced(spark, sf_dir).groupBy("race_id", "seq", "method", "day").agg(
        F.sum("y").alias("wins"), F.count("*").alias("n"), F.sum("qty").alias("total")
    )


def global_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.global_prior(_race_rows(spark, sf_dir), "wins", "n", 0.1).select("race_id", F.round("prior", 6).alias("prior"))


def par_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.par_time(_race_rows(spark, sf_dir), "total", "n", [["method"]]).select("race_id", F.round("par", 6).alias("par"))


def elo_pre_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sequenced(spark, sf_dir)
    once = r.groupBy("race_id", "seq", "horse").agg(F.min("place").alias("place"))
    return ratings.elo_before(once, "race_id", "seq", "horse", "place")


def fixed_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return o.select("o_orderkey", splits.fixed_part(F.col("date"), dt.date(1998, 12, 31), dt.date(1999, 12, 31), 5).alias("part"))


def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return splits.walk_forward(o, dt.date(1999, 1, 1), 91, purge_days=3).groupBy("fold", "part").agg(F.count("*").alias("n"))


def top_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = market.top_one(runners(spark, sf_dir), ["race_id"], F.col("qty").desc_nulls_last(), F.col("price"))
    return top.select("race_id", "price", "qty")


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


def clogit_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runners(spark, sf_dir).withColumn("x", market.centred(F.col("qty") / 10, "race_id"))
    beta = models.fit_conditional_logit(r, ["x"])
    return spark.createDataFrame([("x", round(float(beta[0]), 6))], "feature string, beta double")


def power_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(round(models.fit_power(_market(spark, sf_dir)), 5),)], "power double")


def share_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags stand for pools, quantity for shares and turnover."""
    shares = _table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("race_id"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("game_id"),
        F.col("l_quantity").alias("pool_turnover"), F.col("l_quantity").alias("share"),
    )
    return _rounded(market.from_shares(runners(spark, sf_dir), shares, number="price"), F.col("p"), "p")


def day_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    races = _race_rows(spark, sf_dir).withColumn("dev", F.col("total") - 25.0 * F.col("n"))
    got = asof.day_variant(races, "dev", "n", "method", "day")
    return got.select("race_id", F.round("variant", 6).alias("variant"))


def market_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frame that forecasts need, with quantity and part as features."""
    frame = _market(spark, sf_dir)
    return frame.select("race_id", F.col("price").alias("number"), "date", "y", F.col("p").alias("p_market"), "qty", F.col("horse").alias("part"))


def walk_forward_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses by fold of the market, its power form, a logit and their combination, over all windows of 91 days after the first 180."""
    frame = market_frame(spark, sf_dir)
    first = _table(spark, sf_dir, "orders").agg(F.min(F.to_date("o_orderdate"))).first()[0]
    got = forecasts.walk_forward(frame, ["qty", "part"], first + dt.timedelta(days=180))
    return forecasts.fold_losses(got)


def queries() -> dict:
    every = (
        market_logloss_brier, market_overround, race_cleaning_report, devig_probabilities, power_recalibrated, softmax_scores,
        centred_features, calibration_uniform, murphy_parts, clustered_mean_test, hist_counts, driver_rates, class_form,
        global_prior, par_fallback, elo_pre_race, fixed_split, walk_forward_folds, top_pool, json_props, clogit_fit, power_fit,
        share_market, day_variant, walk_forward_forecasts,
    )
    return {f.__name__: f for f in every}


_BEFORE = "order by seq range between unbounded preceding and 1 preceding"
_BINS = ", bins as (select cast(least(9, (p >= 0.1)::int + (p >= 0.2)::int + (p >= 0.3)::int + (p >= 0.4)::int + (p >= 0.5)::int + (p >= 0.6)::int + (p >= 0.7)::int + (p >= 0.8)::int + (p >= 0.9)::int) as int) bin, avg(p) p_mean, avg(cast(y as double)) y_rate, count(*) n from market group by 1)\n"
_RACES = ", races as (select race_id, seq, method, day, sum(y) wins, count(*) n, sum(qty) total from sequenced group by all)\n"


def oracle_sql() -> dict[str, str]:
    own = {
        "market_logloss_brier": "select count(*) n_races, round(avg(log_loss), 6) log_loss, round(avg(brier), 6) brier from loss",
        "market_overround": "select round(median(t), 6) median_overround from (select sum(qty) / 100 t from runners group by race_id)",
        "race_cleaning_report": ", g as (select l_orderkey, sum(case when l_returnflag = 'R' then 1 else 0 end) = 1 w, bool_and(l_quantity - 5 > 0) u from lineitem group by 1) select count(*) n_races, count(*) filter (not w) excluded_winner, count(*) filter (w and not u) excluded_value, count(*) filter (w and u) n_clean from g",
        "devig_probabilities": "select race_id, price, round(p, 6) p from market",
        "power_recalibrated": "select race_id, price, round(pow(p, 1.15) / sum(pow(p, 1.15)) over (partition by race_id), 6) p from market",
        "softmax_scores": "select race_id, price, round(exp(qty / 10) / sum(exp(qty / 10)) over (partition by race_id), 6) p from runners",
        "centred_features": ", v as (select *, case when qty > 10 then qty end v from runners), m as (select *, coalesce(avg(v) over (partition by race_id), 0.0) m from v) select race_id, price, round(coalesce(v, m) - m, 6) x from m",
        "calibration_uniform": _BINS + "select bin, round(p_mean, 6) p_mean, round(y_rate, 6) y_rate, n from bins",
        "murphy_parts": _BINS + ", t as (select sum(n) t, sum(n * y_rate) / sum(n) b from bins) select round(sum(n * (p_mean - y_rate) ** 2) / any_value(t), 6) reliability, round(sum(n * (y_rate - b) ** 2) / any_value(t), 6) resolution, round(any_value(b) * (1 - any_value(b)), 6) uncertainty from bins, t",
        "clustered_mean_test": ", d as (select date, sum(log_loss) s, count(*) k from loss group by 1), t as (select sum(k) n, sum(s) / sum(k) m from d) select cast(any_value(n) as bigint) n, round(any_value(m), 6) mean, round(sqrt(sum((s - k * m) ** 2)) / any_value(n), 6) se from d, t",
        "hist_counts": f"select race_id, price, count(*) over w hist_starts, day - max(day) over w days_since_last, round(coalesce(sum(price) over w, 0), 2) cum_earnings from sequenced window w as (partition by horse {_BEFORE})",
        "driver_rates": f", x as (select *, pow(2.0, day / 365) w from sequenced), s as (select race_id, price, coalesce(sum(w) over b, 0) / w n, coalesce(sum(w * y) over b, 0) / w e from x window b as (partition by driver {_BEFORE})) select race_id, price, round((e + 2.0) / (n + 20), 6) rate, round(n, 6) n from s",
        "class_form": f", x as (select *, pow(2.0, day / 120) w from sequenced) select race_id, price, round(sum(w * qty) over b / sum(w) over b, 6) form from x window b as (partition by horse {_BEFORE})",
        "global_prior": _RACES + f"select race_id, round(coalesce(sum(wins) over w / sum(n) over w, 0.1), 6) prior from races window w as ({_BEFORE})",
        "par_fallback": _RACES + f"select race_id, round(coalesce(case when sum(n) over m >= 30 then sum(total) over m / sum(n) over m end, sum(total) over w / sum(n) over w), 6) par from races window w as ({_BEFORE}), m as (partition by method {_BEFORE})",
        "fixed_split": "select o_orderkey, case when cast(o_orderdate as date) <= date '1998-12-26' then 'train' when cast(o_orderdate as date) > date '1998-12-31' and cast(o_orderdate as date) <= date '1999-12-31' then 'val' when cast(o_orderdate as date) > date '1999-12-31' then 'test' end part from orders",
        "walk_forward_folds": ", f as (select i, date '1999-01-01' + cast(91 * i as int) t from range(200) r(i) where date '1999-01-01' + cast(91 * i as int) <= (select max(cast(o_orderdate as date)) from orders)), d as (select cast(i as int) fold, case when cast(o_orderdate as date) < t - 3 then 'train' when cast(o_orderdate as date) >= t and cast(o_orderdate as date) < t + 91 then 'test' end part from orders, f) select fold, part, count(*) n from d where part is not null group by 1, 2",
        "share_market": ", g as (select l_orderkey race_id, l_returnflag f, max(l_quantity) t from lineitem group by all), c as (select race_id, f from (select *, row_number() over (partition by race_id order by t desc, f) k from g) where k = 1), h as (select r.race_id, r.price, r.y, s.l_quantity share from runners r left join (select l_orderkey, l_extendedprice, l_quantity from lineitem join c on race_id = l_orderkey and f = l_returnflag) s on s.l_orderkey = r.race_id and s.l_extendedprice = r.price) select race_id, price, round(share / sum(share) over (partition by race_id), 6) p from h qualify sum(y) over (partition by race_id) = 1 and count(*) filter (share > 0) over (partition by race_id) = count(*) over (partition by race_id)",
        "day_variant": _RACES + f", d as (select *, total - 25.0 * n dev, pow(2.0, day / 30) w from races) select race_id, round(coalesce(case when sum(n) over t >= 5 then sum(dev) over t / sum(n) over t end, sum(w * dev / n) over k / sum(w) over k, 0), 6) variant from d window t as (partition by method, day {_BEFORE}), k as (partition by method {_BEFORE})",
        "top_pool": "select race_id, price, qty from (select *, row_number() over (partition by race_id order by qty desc nulls last, price) r from runners) where r = 1",
        "json_props": "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) k from events",
    }
    return {k: RUNNERS_SQL + v for k, v in own.items()}
