"""Documents of a landing folder, calendar/<day>.json, race/<id>.json and game/<id>.json, and what a calendar asks for.

A downloader fills the folder; a file that is missing stands for "not found".
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.functions.documents import last_wins, leg_races

#: The game types and sport that are kept.
GAME_TYPES = ["V75", "V86", "V64", "V65", "GS75", "V5", "V4", "V3", "dd", "ld"]
SPORTS = ["trot"]


def days(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """Every day from first to last, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day")) if first <= last else spark.createDataFrame([], "day date")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(key, json, doc): whole files by name without its ending; doc is null where the text is no JSON object."""
    try:
        raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json")
    except AnalysisException:  # nothing has landed
        raw = spark.createDataFrame([], "value string").withColumn("_metadata", F.struct(F.lit("").alias("file_name")))
    name = F.regexp_replace(F.col("_metadata.file_name"), "\\.json$", "")
    doc = F.try_parse_json("value")
    return raw.select(name.alias("key"), F.col("value").alias("json"), F.when(F.startswith(F.schema_of_variant(doc), F.lit("OBJECT")), doc).alias("doc"))


def game_parts(games: DataFrame) -> DataFrame:
    """``games`` with game_type and game_date, the first two parts of a key like V75_2024-01-01_5_1."""
    parts = F.split("key", "_")
    return games.withColumns({"game_type": F.get(parts, F.lit(0)), "game_date": F.get(parts, F.lit(1)).try_cast("date")})


def wanted_races(calendars: DataFrame, countries: list[str] | None = None) -> DataFrame:
    """(day, key) of finished races of the kept sports, of all countries or the given ones; calendars: day, doc."""
    got = calendars.sparkSession.sql(
        """select day, try_variant_get(t.value, '$.sport', 'string') sport,
                  coalesce(try_variant_get(t.value, '$.countryCode', 'string'), try_variant_get(t.value, '$.country', 'string')) country,
                  try_variant_get(r.value, '$.status', 'string') status, try_variant_get(r.value, '$.id', 'string') key
           from {c}, lateral variant_explode(variant_get(doc, '$.tracks')) as t, lateral variant_explode(variant_get(t.value, '$.races')) as r""",
        c=calendars,
    ).where(F.col("sport").isin(SPORTS) & (F.col("status") == "results") & F.col("key").isNotNull())
    if countries is not None:
        got = got.where(F.col("country").isin(list(countries)))
    return got.select("day", "key").distinct()


def wanted_games(calendars: DataFrame) -> DataFrame:
    """(day, key) of games of the kept types."""
    got = calendars.sparkSession.sql(
        """select day, g.key kind, try_variant_get(x.value, '$.id', 'string') key
           from {c}, lateral variant_explode(variant_get(doc, '$.games')) as g, lateral variant_explode(g.value) as x""",
        c=calendars,
    )
    return got.where(F.col("kind").isin(GAME_TYPES) & F.col("key").isNotNull()).select("day", "key").distinct()


def sample_races(spark: SparkSession, folder: str) -> DataFrame:
    """(key, json) of a folder of samples: its race documents, and the legs of its games, which count where both are there."""
    own = documents(spark, f"{folder}/race").where("doc is not null").select("key", "json", F.lit(0).alias("order"))
    legs = leg_races(documents(spark, f"{folder}/game").where("doc is not null")).withColumn("order", F.lit(1))
    return last_wins(own.unionByName(legs), ["key"], "order").select("key", "json")


def fetch_keys(keys: DataFrame, kind: str, folder: str) -> DataFrame:
    """``keys`` (day, key) with json and failure, both null where nothing has landed; a payload that is no JSON object is a failure."""
    found = documents(keys.sparkSession, f"{folder}/{kind}")
    bad = F.when(F.col("json").isNotNull() & F.col("doc").isNull(), "not a JSON object")
    return keys.join(found, "key", "left").select("day", "key", F.when(bad.isNull(), F.col("json")).alias("json"), bad.alias("failure"))
