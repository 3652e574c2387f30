"""Forecast scores per race, calibration, day-clustered tests and bootstraps."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.operators.quantiles import exact_quantiles

TINY = 1e-15


def clipped(p: Column, tiny: float = TINY) -> Column:
    return F.greatest(F.least(p, F.lit(1 - tiny)), F.lit(tiny))


def require_one_winner(df: DataFrame, group: str = "race_id", y: str = "y") -> None:
    """Raises ValueError with up to five examples where a group has not exactly one winner."""
    bad = df.groupBy(group).agg(F.sum(y).alias("w")).where("w is null or w <> 1").select(group).limit(5).collect()
    if bad:
        raise ValueError(f"groups without exactly one winner, for example {[r[0] for r in bad]}")


def race_losses(df: DataFrame, group: str = "race_id", p: str = "p", y: str = "y") -> DataFrame:
    """One row per race: log loss of the winner and Brier sum."""
    return df.groupBy(group).agg(
        (-F.log(F.max(F.when(F.col(y) == 1, clipped(F.col(p)))))).alias("log_loss"),
        F.sum(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"),
    )


def mean_losses(losses: DataFrame) -> DataFrame:
    return losses.agg(F.count("*").alias("n_races"), F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"))


def calibration(df: DataFrame, p: str = "p", y: str = "y", n_bins: int = 10, strategy: str = "quantile") -> DataFrame:
    """(bin, p_mean, y_rate, n) of bins that hold rows; edges are quantiles or equal widths.

    A bin is the number of inner edges at or below p. Equal quantile edges count once, so a
    constant p gives one bin.
    """
    if strategy == "uniform":
        edges = [i / n_bins for i in range(1, n_bins)]
    elif strategy == "quantile":
        shares = [i / n_bins for i in range(n_bins + 1)]
        edges = sorted(set(exact_quantiles(df, p, shares) or []))[1:-1]
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    number = sum((F.when(F.col(p) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return df.groupBy(number.alias("bin")).agg(
        F.avg(p).alias("p_mean"), F.avg(F.col(y).cast("double")).alias("y_rate"), F.count("*").alias("n")
    )


def murphy(bins: DataFrame) -> DataFrame:
    """Reliability, resolution and uncertainty from calibration bins, in one pass."""
    n, rate = F.col("n"), F.col("y_rate")
    got = bins.agg(
        F.sum("n").alias("n"), (F.sum(n * rate) / F.sum(n)).alias("base"), F.sum(n * rate * rate).alias("squares"),
        F.sum(n * F.pow(F.col("p_mean") - rate, F.lit(2.0))).alias("off"),
    )
    return got.select(
        (F.col("off") / F.col("n")).alias("reliability"),
        F.greatest(F.col("squares") / F.col("n") - F.col("base") * F.col("base"), F.lit(0.0)).alias("resolution"),
        (F.col("base") * (1 - F.col("base"))).alias("uncertainty"),
    )


def paired_differences(model: DataFrame, market: DataFrame, group: str = "race_id") -> DataFrame:
    """market log loss - model log loss of races that both have."""
    m = race_losses(market, group).select(group, F.col("log_loss").alias("market"), F.col("brier").alias("market_brier"))
    both = race_losses(model, group).withColumnRenamed("brier", "model_brier").join(m, group)
    return both.select(group, "market", F.col("log_loss").alias("model"), (F.col("market") - F.col("log_loss")).alias("diff"), "model_brier", "market_brier")


def clustered_test(diffs: DataFrame, cluster: str, value: str = "diff") -> DataFrame:
    """n, mean, day-clustered standard error and z of a mean."""
    per = diffs.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("k"))
    s, k, m = F.col("s"), F.col("k"), F.col("mean")
    sums = per.agg(F.sum("k").alias("n"), (F.sum("s") / F.sum("k")).alias("mean"), F.sum(s * s).alias("ss"), F.sum(s * k).alias("sk"), F.sum(k * k).alias("kk"))
    spread = F.greatest(F.col("ss") - 2 * m * F.col("sk") + m * m * F.col("kk"), F.lit(0.0))
    # What rounding leaves of equal sums is no spread.
    spread = F.when(spread > 1e-12 * F.col("ss"), spread).otherwise(0.0)
    out = sums.select("n", "mean", (F.sqrt(spread) / F.col("n")).alias("se"))
    z = F.when(F.col("se") > 0, F.col("mean") / F.col("se")).when(F.col("mean") == 0, 0.0).otherwise(F.signum("mean") * F.lit(float("inf")))
    return out.withColumn("z", z)


def two_sided_p(z: float) -> float:
    return 2 * (1 - NormalDist().cdf(abs(z)))


def detectable_factor(alpha: float = 0.05, power: float = 0.8) -> float:
    """Times the standard error: the least effect found with the given power."""
    n = NormalDist()
    return n.inv_cdf(1 - alpha / 2) + n.inv_cdf(power)


def day_bootstrap(diffs: DataFrame, cluster: str, value: str = "diff", n_boot: int = 2000, seed: int = 0) -> tuple[float, float]:
    """2.5 and 97.5 % of the mean when days are drawn with replacement; days are summed by Spark first. Nan without days."""
    days = diffs.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n")).orderBy(cluster).toPandas()
    if not len(days):
        return float("nan"), float("nan")
    rng = np.random.default_rng(seed)
    pick = rng.integers(0, len(days), size=(n_boot, len(days)))
    means = days["s"].to_numpy()[pick].sum(axis=1) / days["n"].to_numpy()[pick].sum(axis=1)
    low, high = np.percentile(means, [2.5, 97.5])
    return float(low), float(high)


#: Races that one task resamples at a time.
BLOCK = 1 << 15


def drawn_in_block(sizes: np.ndarray, block: int, n_boot: int, seed: int) -> np.ndarray:
    """How many of its n draws each resample takes from ``block``, if all are drawn from blocks of ``sizes`` rows, n in all.

    A multinomial draw, split in halves: a binomial draw parts the draws of a range of blocks between its halves, seeded by the range. So every
    task finds its own numbers, and those of all blocks add up to n.
    """
    first, end = 0, len(sizes)
    sums = np.concatenate(([0], np.cumsum(sizes)))
    draws = np.full(n_boot, sums[-1], dtype=np.int64)
    while end - first > 1:
        mid = (first + end) // 2
        share = (sums[mid] - sums[first]) / max(1, sums[end] - sums[first])
        left = np.random.default_rng([seed, first, end]).binomial(draws, share)
        draws, first, end = (left, first, mid) if block < mid else (draws - left, mid, end)
    return draws


def block_sums(values: np.ndarray, draws: np.ndarray, block: int, seed: int) -> np.ndarray:
    """The sum of as many values as ``draws`` says, drawn with replacement, for each resample."""
    rng = np.random.default_rng([seed, block])
    return np.array([values[rng.integers(0, len(values), size=k)].sum() for k in draws])


def race_bootstrap(
    diffs: DataFrame, group: str = "race_id", value: str = "diff", n_boot: int = 2000, seed: int = 0, block: int = BLOCK
) -> tuple[float, float]:
    """2.5 and 97.5 % of the mean when as many races as there are are drawn with replacement. Nan without races.

    Races are dealt into blocks by a hash of their group, ordered there by group and value, and drawn there (``drawn_in_block``). A block gives one
    sum for each resample; only those and the blocks' sizes are brought together. Null values do not count.
    """
    held = diffs.select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("x")).where("x is not null")
    n = held.count()
    if not n:
        return float("nan"), float("nan")
    n_blocks = -(-n // block)
    held = held.withColumn("block", F.pmod(F.xxhash64("g"), F.lit(n_blocks)).cast("int"))
    sizes = np.zeros(n_blocks, dtype=np.int64)
    for r in held.groupBy("block").agg(F.count("*").alias("n")).collect():
        sizes[r.block] = r.n

    def resampled(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        values = table.sort_by([("g", "ascending"), ("x", "ascending")]).column("x").to_numpy()
        sums = block_sums(values, drawn_in_block(sizes, number, n_boot, seed), number, seed)
        return pa.table({"b": np.arange(n_boot, dtype=np.int32), "total": sums})

    sums = held.groupBy("block").applyInArrow(resampled, "b int, total double").groupBy("b").agg(F.sum("total").alias("total"))
    means = np.array([r.total for r in sums.collect()]) / n  # n_boot of them
    low, high = np.percentile(means, [2.5, 97.5])
    return float(low), float(high)


def compare(model: DataFrame, market: DataFrame, dates: DataFrame, n_boot: int = 2000, seed: int = 0) -> dict:
    """Losses on common races, skill, bootstrap interval, clustered z and p, detectable effect, verdict.

    Significant means that the interval excludes 0 and p is under 0.05.
    """
    diffs = paired_differences(model, market).join(dates, "race_id").cache()
    t = clustered_test(diffs, "date").first()
    names = ("model", "market", "model_brier", "market_brier")
    means = diffs.agg(*[F.avg(c).alias(c) for c in names], F.count("*").alias("n")).first()
    low, high = day_bootstrap(diffs, "date", n_boot=n_boot, seed=seed)
    p = two_sided_p(t["z"])
    diffs.unpersist()
    return {
        "n_races": means["n"], "model_log_loss": means["model"], "market_log_loss": means["market"],
        "model_brier": means["model_brier"], "market_brier": means["market_brier"],
        "skill": 1 - means["model"] / means["market"], "mean_diff": t["mean"], "ci_low": low, "ci_high": high, "z": t["z"], "p": p,
        "mde": detectable_factor() * t["se"], "significant": (low > 0 or high < 0) and p < 0.05,
    }
