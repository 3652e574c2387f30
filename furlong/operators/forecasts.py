"""Forecast drivers: walk-forward folds, one day's prediction, snapshots and their scoring.

A frame has race_id, number, date, y (0 or 1, one winner a race), p_market and raw features,
which may be null. Fits read Spark aggregates; only coefficients reach the driver.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.operators import market, models, scoring, trees

TINY = 1e-12
KEYS = ["race_id", "number", "date", "y"]
#: Model against market, as the reports pair them.
PAIRS = [("p_market_flb", "p_market"), ("p_logit", "p_market"), ("p_trees", "p_market"), ("p_combination", "p_market"), ("p_combination", "p_market_flb")]


@dataclass
class Fold:
    """A test window [start, end), and what its forecasts are made of: fitted on the days before ``start``."""

    number: int
    start: dt.date
    end: dt.date
    cut: dt.date
    scale: np.ndarray
    logit: models.Choice
    power: models.Choice
    combination: models.Choice | None = None

    @property
    def values(self) -> dict:
        fundamental, own = self.combination.beta
        return {"logit": self.logit.beta.tolist(), "fundamental": float(fundamental), "market": float(own), "power": models.power_of(self.power)}


def _softmax(v: Column) -> Column:
    w = Window.partitionBy("fold", "race_id")
    e = F.exp(v - F.max(v).over(w))
    return e / F.sum(e).over(w)


def _scales(days: list, features: list[str], end: dt.date) -> np.ndarray:
    """The sample deviation of every centred feature over the days before ``end``, from sums by day; 1 for a constant or wholly unknown one."""
    past = [r for r in days if r.date < end]
    n = sum(r.n for r in past)
    sums, squares = (np.array([sum(r[f"{k}{i}"] for r in past) for i in range(len(features))]) for k in ("s", "q"))
    spread = np.maximum(squares - sums * sums / max(n, 1), 0.0) / max(n - 1, 1)
    sd = np.sqrt(np.where(spread > 1e-18 * np.maximum(squares, 1e-300), spread, 0.0))
    return np.where(sd > 1e-12, sd, 1.0)


def forecast_windows(
    df: DataFrame, features: list[str], windows: list[tuple[dt.date, dt.date]], val_days: int = 60, trees_rounds: int = 0,
    trees_settings: dict | None = None,
) -> tuple[DataFrame, list[Fold]] | None:
    """(forecasts with fold, folds) of the races in each window [start, end); windows with an empty part are left out, None if all are.

    Everything is fitted on races before the window: the scale and the market's power on all of them, the
    logit (and the trees where ``trees_rounds`` > 0) before the last ``val_days``, the
    combination's two weights on those days. All windows are fitted together: rows are centred once, scales come from sums by day, and every
    Newton pass serves all windows' logits and powers, then all combinations. Trees are grown window by window, with
    ``trees_settings`` for ``trees.fit``.
    """
    spark, xs = df.sparkSession, [f"x{i}" for i in range(len(features))]
    centred = df.select(*KEYS, "p_market", F.log(scoring.clipped(F.col("p_market"), TINY)).alias("ln_m"), *[
        market.centred(F.col(f).cast("double"), "race_id").alias(x) for f, x in zip(features, xs, strict=True)
    ]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(xs)] + [F.sum(F.col(x) * F.col(x)).alias(f"q{i}") for i, x in enumerate(xs)]
        days = centred.where("date is not null").groupBy("date").agg(F.count("*").alias("n"), *sums).collect()  # one a day
        folds: list[Fold] = []
        for start, end in windows:
            cut = start - dt.timedelta(days=val_days)
            if any(r.date < cut for r in days) and any(cut <= r.date < start for r in days) and any(start <= r.date < end for r in days):
                scale = _scales(days, features, start)
                folds.append(Fold(len(folds), start, end, cut, scale, models.Choice(xs, scale=scale, end=cut), models.power_choice("ln_m", end=start)))
        if not folds:
            return None
        models.fit_choices(centred, [c for f in folds for c in (f.logit, f.power)])
        table = [
            (f.number, f.cut, f.start, f.end, models.power_of(f.power), *(float(b) for b in f.logit.beta / f.scale)) for f in folds
        ]
        kind = "fold int, cut date, start date, end date, power double, " + ", ".join(f"b{i} double" for i in range(len(xs)))
        held = F.broadcast(spark.createDataFrame(table, kind))  # a row a fold
        v = sum((F.col(x) * F.col(f"b{i}") for i, x in enumerate(xs)), F.lit(0.0))
        rows = centred.join(held, (F.col("date") >= F.col("cut")) & (F.col("date") < F.col("end")))
        rows = rows.withColumn("p_logit", _softmax(v)).withColumn("ln_f", F.log(scoring.clipped(F.col("p_logit"), TINY)))
        for f in folds:
            f.combination = models.Choice(["ln_f", "ln_m"], 0.01, key=f.number)
        models.fit_choices(rows.where("date < start"), [f.combination for f in folds], key="fold")
        weights = F.broadcast(spark.createDataFrame([(f.number, *map(float, f.combination.beta)) for f in folds], "fold int, w_f double, w_m double"))
        out = rows.where("date >= start").join(weights, "fold").withColumns({
            "p_market_flb": _softmax(F.col("power") * F.col("ln_m")), "p_combination": _softmax(F.col("w_f") * F.col("ln_f") + F.col("w_m") * F.col("ln_m"))
        })
        names = ["p_market", "p_market_flb", "p_logit", "p_combination"]
        if trees_rounds:
            parts = []
            for f in folds:
                core = centred.where(F.col("date") < F.lit(f.cut))
                held_out = centred.where((F.col("date") >= F.lit(f.cut)) & (F.col("date") < F.lit(f.start)))
                grown = trees.fit(core, held_out, xs, rounds=trees_rounds, row=F.xxhash64("race_id", "number"), **(trees_settings or {}))
                parts.append(out.where(F.col("fold") == f.number).withColumn("p_trees", grown.probability(xs)))
            out = reduce(DataFrame.unionByName, parts)
            out = out.withColumn("p_trees", F.try_divide("p_trees", F.sum("p_trees").over(Window.partitionBy("fold", "race_id"))))
            names.append("p_trees")
        return out.select("fold", *KEYS, *names), folds
    finally:
        centred.unpersist()


def forecast_window(
    df: DataFrame, features: list[str], test_from: dt.date, test_to: dt.date, val_days: int = 60, trees_rounds: int = 0
) -> tuple[DataFrame, dict] | None:
    """(forecasts, fitted values) of the races in [test_from, test_to); None where a part has no rows."""
    got = forecast_windows(df, features, [(test_from, test_to)], val_days, trees_rounds)
    return got and (got[0].drop("fold"), got[1][0].values)


def fixed_split(df: DataFrame, features: list[str], train_end: dt.date, val_end: dt.date, trees_rounds: int = 0) -> tuple[DataFrame, dict] | None:
    """Forecasts of all races after ``val_end``: the logit and trees learn up to ``train_end``, the combination on the days between, the scale and the power on both."""
    last = df.agg(F.max("date")).first()[0]
    if last is None:
        return None
    start = val_end + dt.timedelta(days=1)
    return forecast_window(df, features, start, last + dt.timedelta(days=1), (val_end - train_end).days, trees_rounds)


def walk_forward(
    df: DataFrame, features: list[str], first_test: dt.date, span_days: int = 91, val_days: int = 60, trees_rounds: int = 0,
    trees_settings: dict | None = None,
) -> DataFrame | None:
    """Forecasts of all folds with fold; windows without a test, core or validation row are left out, None if all are."""
    last, windows, start = df.agg(F.max("date")).first()[0], [], first_test
    while last is not None and start <= last:
        windows.append((start, start + dt.timedelta(days=span_days)))
        start = windows[-1][1]
    got = forecast_windows(df, features, windows, val_days, trees_rounds, trees_settings)
    return got and got[0]


def fold_losses(forecasts: DataFrame) -> DataFrame:
    """Mean log loss of every forecast by fold, with races and runners."""
    names = [c for c in forecasts.columns if c.startswith("p_")]
    won = lambda c: -F.log(F.max(F.when(F.col("y") == 1, scoring.clipped(F.col(c)))))
    per = forecasts.groupBy("fold", "race_id").agg(F.count("*").alias("n"), *[won(c).alias(c) for c in names])
    return per.groupBy("fold").agg(F.count("*").alias("n_races"), F.sum("n").alias("n_runners"), *[F.avg(c).alias("loss_" + c[2:]) for c in names])


def reliability(forecasts: DataFrame, n_bins: int = 12) -> DataFrame:
    """(forecast, reliability, resolution, uncertainty) of every forecast over all folds, from quantile bins.

    Quantiles and bins are passes of their own over ``forecasts``, so cache it where it is dear.
    """
    parts = [
        scoring.murphy(scoring.calibration(forecasts, c, n_bins=n_bins)).select(F.lit(c[2:]).alias("forecast"), "*")
        for c in forecasts.columns if c.startswith("p_")
    ]
    return reduce(DataFrame.unionByName, parts)


def comparisons(forecasts: DataFrame, n_boot: int = 2000) -> DataFrame:
    """One row per pair of ``PAIRS`` whose columns are there: losses, skill, interval, test and verdict."""
    spark = forecasts.sparkSession
    dates = forecasts.groupBy("race_id").agg(F.min("date").alias("date"))
    frame = lambda c: forecasts.select("race_id", "y", F.col(c).alias("p"))
    held = [(a, b) for a, b in PAIRS if a in forecasts.columns and b in forecasts.columns]
    return spark.createDataFrame([{"label": f"{a[2:]} vs {b[2:]}"} | scoring.compare(frame(a), frame(b), dates, n_boot) for a, b in held])


def predict_day(df: DataFrame, features: list[str], day: dt.date, val_days: int = 60, trees_rounds: int = 0) -> tuple[DataFrame, dict]:
    """Forecasts for one day from models fitted on earlier days; ValueError where there is nothing to predict or learn from."""
    got = forecast_window(df, features, day, day + dt.timedelta(days=1), val_days, trees_rounds)
    if got is None:
        raise ValueError(f"no races on {day}, or none before it to learn from")
    return got


def append_snapshot(forecasts: DataFrame, path: str) -> None:
    """Appends the forecasts with predicted_at to the Parquet folder, partitioned by date."""
    forecasts.withColumn("predicted_at", F.current_timestamp()).write.mode("append").partitionBy("date").parquet(path)


def score_snapshots(snapshots: DataFrame, outcomes: DataFrame, keys: list[str], n_boot: int = 2000) -> DataFrame:
    """``comparisons`` of stored forecasts, with y from ``outcomes`` (keys, is_winner).

    Of repeated snapshots of a start the latest counts. Races without exactly one winner are
    left out; ValueError where none is left.
    """
    if "predicted_at" in snapshots.columns:
        snapshots = market.top_one(snapshots, keys, F.col("predicted_at").desc())
    joined = snapshots.drop("y", "is_winner").join(outcomes.select(*keys, F.col("is_winner").alias("y")), keys)
    good = joined.groupBy("race_id").agg(F.sum("y").alias("w")).where("w = 1").select("race_id")
    joined = joined.join(good, "race_id", "left_semi")
    if joined.isEmpty():
        raise ValueError("no race with exactly one winner to score")
    return comparisons(joined, n_boot)
