"""Time splits: fixed parts and walk-forward folds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fixed_part(date: Column, train_end: dt.date, val_end: dt.date, purge_days: int = 0) -> Column:
    """train, val, test, or null for purged days."""
    return (
        F.when(date <= F.lit(train_end - dt.timedelta(days=purge_days)), "train")
        .when((date > F.lit(train_end)) & (date <= F.lit(val_end)), "val")
        .when(date > F.lit(val_end), "test")
    )


def walk_forward(
    races: DataFrame, first_test: dt.date, span_days: int, n_folds: int | None = None, date: str = "date", step_days: int | None = None,
    purge_days: int = 0, embargo_days: int = 0,
) -> DataFrame:
    """Rows (fold, part) for each race in train or test of a fold.

    A fold tests ``span_days``, the next begins ``step_days`` (or as many) later; it trains on all days more than
    ``purge_days`` before its test, without ``embargo_days`` after it. Folds without a test race are left out and do not
    count; ``n_folds`` None goes on to the last date. Which folds there are comes from counts by day; a race
    then meets only the folds it belongs to.
    """
    spark, d = races.sparkSession, F.col(date)
    days = sorted(r[0] for r in races.where(d.isNotNull()).select(d).distinct().collect())  # one a day
    folds, start = [], first_test
    while days and start <= days[-1] and (n_folds is None or len(folds) < n_folds):
        end = start + dt.timedelta(days=span_days)
        if any(start <= x < end for x in days):
            folds.append((len(folds), start - dt.timedelta(days=purge_days), start, end, end + dt.timedelta(days=embargo_days)))
        start += dt.timedelta(days=step_days or span_days)
    table = F.broadcast(spark.createDataFrame(folds, "fold int, train_before date, test_from date, test_to date, rest_to date"))  # one a fold
    train = (d < F.col("train_before")) & ~((d >= F.col("test_to")) & (d < F.col("rest_to")))
    part = F.when(train, "train").otherwise("test")
    inside = train | ((d >= F.col("test_from")) & (d < F.col("test_to")))
    return races.join(table, inside).withColumn("part", part).drop("train_before", "test_from", "test_to", "rest_to")
