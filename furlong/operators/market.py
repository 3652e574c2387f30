"""Within-group probabilities and the market's cleaning rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(group: str):
    return Window.partitionBy(group)


def share_of_group(value: Column, group: str) -> Column:
    """value / sum(value) within the group; null where the sum is 0 or null."""
    return F.try_divide(value, F.sum(value).over(_w(group)))


def from_odds(odds: Column, group: str) -> Column:
    """The market's probability: 1 / odds as a share of the group; odds that are not above 0 count for nothing."""
    return share_of_group(F.when(~F.isnan(odds) & (odds > 0), 1.0 / odds), group)


def power_share(p: Column, a: float, group: str) -> Column:
    return share_of_group(F.pow(p, F.lit(float(a))), group)


def softmax_in_group(v: Column, group: str) -> Column:
    """exp(v - max) / sum, so that large scores do not overflow."""
    return share_of_group(F.exp(v - F.max(v).over(_w(group))), group)


def centred(v: Column, group: str) -> Column:
    """v, nulls replaced by the group's mean and else by 0, minus the group's mean."""
    mean = F.coalesce(F.avg(v).over(_w(group)), F.lit(0.0))
    return F.coalesce(v, mean) - mean


def clean_groups(df: DataFrame, group: str, winner: Column, value: Column) -> DataFrame:
    """One row per group: one_winner, all_usable. NaN and null values are unusable."""
    usable = F.coalesce(~F.isnan(value) & (value > 0), F.lit(False))
    return df.groupBy(group).agg(
        F.coalesce(F.sum(winner.cast("int")) == 1, F.lit(False)).alias("one_winner"), F.min(usable).alias("all_usable")
    )


def cleaning_report(groups: DataFrame) -> DataFrame:
    """Counts of groups; those without exactly one winner are counted once, before unusable values."""
    return groups.agg(
        F.count("*").alias("n_races"),
        F.count_if(~F.col("one_winner")).alias("excluded_winner"),
        F.count_if(F.col("one_winner") & ~F.col("all_usable")).alias("excluded_value"),
        F.count_if(F.col("one_winner") & F.col("all_usable")).alias("n_clean"),
    )


def keep_clean(df: DataFrame, group: str, winner: Column, value: Column) -> DataFrame:
    good = clean_groups(df, group, winner, value).where("one_winner and all_usable").select(group)
    return df.join(good, group, "left_semi")


def top_one(df: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given total order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def from_shares(runners: DataFrame, shares: DataFrame, race: str = "race_id", number: str = "number", y: str = "y") -> DataFrame:
    """(race, number, p, y) from betting shares (race, number, game_id, pool_turnover, share).

    Of a race's pools the one with the largest turnover counts, of equal ones the least game_id.
    Races without exactly one winner or with a runner without a share are left out.
    """
    pools = shares.groupBy(race, "game_id").agg(F.max("pool_turnover").alias("turnover"))
    chosen = top_one(pools, [race], F.col("turnover").desc_nulls_last(), F.col("game_id")).select(race, "game_id")
    held = runners.select(race, number, y).join(shares.join(chosen, [race, "game_id"]).select(race, number, "share"), [race, number], "left")
    clean = keep_clean(held, race, F.col(y) == 1, F.col("share"))
    return clean.select(race, number, share_of_group(F.col("share"), race).alias("p"), y)
