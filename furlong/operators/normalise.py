"""Raw documents to the three normalised tables, with counts that are taken while the tables are written."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from furlong.functions import documents

#: Whether a game's document carries a distribution in any pool of any start.
HAS_DISTRIBUTION = """coalesce(exists(try_variant_get(doc, '$.races', 'array<variant>'),
    leg -> exists(try_variant_get(leg, '$.starts', 'array<variant>'),
        start -> exists(map_values(try_variant_get(start, '$.pools', 'map<string,variant>')), pool -> variant_get(pool, '$.betDistribution') is not null))), false)"""


class Counted:
    """Counts of the rows that pass, by ``observe``: they are there once a write has ended, without a pass of their own."""

    def __init__(self) -> None:
        self.seen: list[tuple[Observation, list[str]]] = []

    def watch(self, df: DataFrame, **counts: Column) -> DataFrame:
        self.seen.append((Observation(), list(counts)))
        return df.observe(self.seen[-1][0], *[c.alias(k) for k, c in counts.items()])

    def result(self) -> dict:
        out: dict = {}
        for observation, names in self.seen:
            try:
                out |= observation.get
            except Py4JJavaError:  # Spark saw that no row can pass, and left the observation out of the plan
                out |= {k: None if k.startswith("date_") else 0 for k in names}
        return out


def write_races(raw: DataFrame, folder: str) -> dict:
    """Writes the races of ``raw`` (json, fetched_at); of documents with one id the latest counts. Returns raw_races_read, race_parse_errors,
    norm_races, races_undated, date_min and date_max."""
    seen = Counted()
    docs = seen.watch(documents.parsed(raw), raw_races_read=F.count(F.lit(1)), race_parse_errors=F.count_if("parse_error"))
    races = documents.races(docs.where("not parse_error"), "fetched_at")
    latest = documents.last_wins(races, ["race_id"], "fetched_at").drop("fetched_at")
    undated = F.count_if(F.col("date").isNull())
    latest = seen.watch(latest, norm_races=F.count(F.lit(1)), races_undated=undated, date_min=F.min("date"), date_max=F.max("date"))
    latest.write.mode("overwrite").parquet(folder)
    return seen.result()


def write_starts(raw: DataFrame, folder: str) -> dict:
    """Writes the starts; of those with one id the latest document's counts. Returns norm_starts and the counts of starts by what happened and what is missing."""
    seen, ran = Counted(), F.col("scratched") == 0
    starts = documents.starts(documents.parsed(raw), "fetched_at")
    starts = documents.last_wins(starts, ["start_id"], "fetched_at").drop("fetched_at")
    starts = seen.watch(
        starts, norm_starts=F.count(F.lit(1)), starts_ran=F.count_if(ran), scratched=F.count_if(~ran), galloped_or_dq=F.count_if(F.col("galloped_or_dq") == 1),
        starts_with_final_odds=F.count_if(ran & (F.col("final_odds") > 0)), start_missing_number=F.count_if(F.col("number").isNull()),
        start_missing_postposition=F.count_if(F.col("post_position").isNull()),
    )
    starts.write.mode("overwrite").parquet(folder)
    return seen.result()


def write_distributions(raw: DataFrame, folder: str) -> dict:
    """Writes the bet distributions, the first of a game, race and number. Returns raw_games_read, game_parse_errors, game_without_betdist and norm_bet_distribution."""
    seen = Counted()
    docs = documents.parsed(raw, needs_id=False)
    without = ~F.col("parse_error") & ~F.expr(HAS_DISTRIBUTION)
    docs = seen.watch(docs, raw_games_read=F.count(F.lit(1)), game_parse_errors=F.count_if("parse_error"), game_without_betdist=F.count_if(without))
    games = docs.where("not parse_error").withColumn("game_id", F.coalesce(documents.path(F.col("doc"), "$.id", "string"), F.lit("")))
    shares = seen.watch(documents.first_shares(games), norm_bet_distribution=F.count(F.lit(1)))
    shares.write.mode("overwrite").parquet(folder)
    return seen.result()


def normalise(spark: SparkSession, raw_races: DataFrame, raw_games: DataFrame, folder: str) -> dict:
    """Writes races, starts and bet_distribution under ``folder`` from documents (json, fetched_at); returns all counts.

    Each table is one pass over its documents, and its counts come with it. Races without or with several winners, and races by sport, are
    counted in the small tables that were written.
    """
    report = write_races(raw_races, f"{folder}/races") | write_starts(raw_races, f"{folder}/starts")
    report |= write_distributions(raw_games, f"{folder}/bet_distribution")
    per = spark.read.parquet(f"{folder}/starts").groupBy("race_id").agg(F.sum("is_winner").alias("w"))
    report |= per.agg(F.count_if(F.expr("w = 0")).alias("races_no_winner"), F.count_if(F.expr("w > 1")).alias("races_multi_winner")).first().asDict()
    sports = spark.read.parquet(f"{folder}/races").groupBy("sport").count().collect()
    return report | {f"races_sport_{r.sport}": r["count"] for r in sports}
