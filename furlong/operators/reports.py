"""Counts that describe what has been taken in and how well it parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(df: DataFrame, date: Column, **more: Column) -> DataFrame:
    """One row: n_rows, first and last date, and the given aggregates."""
    return df.agg(F.count("*").alias("n_rows"), F.min(date).alias("date_min"), F.max(date).alias("date_max"), *[c.alias(k) for k, c in more.items()])


def counts_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    """(name, n), the most frequent first; null is a key."""
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def start_counts(starts: DataFrame) -> DataFrame:
    """One row: starters, scratched, galloped or disqualified, starters with odds."""
    ran = F.coalesce(F.col("scratched"), F.lit(0)) == 0
    return starts.agg(
        F.count("*").alias("n_starts"), F.count_if(ran).alias("starts_ran"), F.count_if(F.expr("scratched = 1")).alias("scratched"),
        F.count_if(F.expr("galloped_or_dq = 1")).alias("galloped_or_dq"), F.count_if(ran & (F.col("final_odds") > 0)).alias("starts_with_final_odds"),
    )


def winner_counts(starts: DataFrame, group: str = "race_id", winner: str = "is_winner") -> DataFrame:
    """One row: groups without a winner, and with several."""
    per = starts.groupBy(group).agg(F.sum(winner).alias("w"))
    return per.agg(F.count_if(F.expr("w = 0")).alias("races_no_winner"), F.count_if(F.expr("w > 1")).alias("races_multi_winner"))


def parse_quality(parsed: DataFrame, starts: DataFrame) -> DataFrame:
    """One row: documents read and not parsed, starts without number or post position."""
    docs = parsed.agg(F.count("*").alias("documents_read"), F.count_if("parse_error").alias("parse_errors"))
    rows = starts.agg(F.count_if(F.expr("number is null")).alias("missing_number"), F.count_if(F.expr("post_position is null")).alias("missing_post_position"))
    return docs.crossJoin(rows)  # one row each


def sample_race(races: DataFrame, starts: DataFrame, n: int = 3) -> DataFrame:
    """The first race by id with its first ``n`` runners by number."""
    one = races.orderBy("race_id").limit(1)
    runners = starts.join(F.broadcast(one.select("race_id")), "race_id", "left_semi").groupBy("race_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("number", "horse_name", "place", "km_time_s", "final_odds"))), 1, n).alias("runners")
    )
    return one.join(runners, "race_id", "left")


#: Counts that should be 0.
CHECKS = (
    "race_parse_errors", "game_parse_errors", "start_missing_number", "start_missing_postposition", "races_no_winner", "races_multi_winner", "races_undated",
)


def normalisation_text(report: dict) -> str:
    """The counts of ``normalise.normalise`` as text: what was read and written, then what should be 0 and is not."""
    known = [k for k in report if not k.startswith(("races_sport_", "date_")) and k not in CHECKS]
    lines = [f"{k.replace('_', ' '):<28}{report[k]:>12,}" for k in known]
    lines.append(f"{'dates':<28}{report.get('date_min')} to {report.get('date_max')}")
    lines += [f"{'races of ' + k.removeprefix('races_sport_'):<28}{report[k]:>12,}" for k in report if k.startswith("races_sport_")]
    lines += [f"CHECK {k.replace('_', ' '):<22}{report[k]:>12,}" for k in CHECKS if report.get(k)]
    if report.get("raw_games_read") and not report.get("norm_bet_distribution"):
        lines.append("CHECK games were read, but none has a bet distribution")
    return "\n".join(lines)


def comparison_text(label: str, result: dict) -> str:
    """One result of ``scoring.compare`` as text."""
    verdict = "significant" if result["significant"] else "not significant"
    return "\n".join([
        f"{label}: {result['n_races']:,} races in common",
        f"  log loss {result['model_log_loss']:.4f} against {result['market_log_loss']:.4f}, Brier {result['model_brier']:.4f} against {result['market_brier']:.4f}",
        f"  skill {result['skill']:+.4f}, difference a race {result['mean_diff']:+.5f} [{result['ci_low']:+.5f}, {result['ci_high']:+.5f}]",
        f"  z {result['z']:+.2f}, p {result['p']:.4f}, least detectable {result['mde']:.5f}: {verdict}",
    ])


def forecast_text(label: str, losses: dict) -> str:
    """One row of ``scoring.mean_losses`` as text, and with ``median_overround`` that too."""
    more = f", median overround {losses['median_overround']:.3f}" if losses.get("median_overround") is not None else ""
    return f"{label}: {losses['n_races']:,} races, log loss {losses['log_loss']:.4f}, Brier {losses['brier']:.4f}{more}"
