"""The raw store: documents as they came, in tables by day, and the log of days; and the ingest that fills them.

Tables are parquet, partitioned by day. What is fetched again replaces its key's row: the days of a batch are read, merged and written as
one file each, so a store does not grow by fetching again. The log is written last; a run that broke off is taken up by the next.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.functions.documents import last_wins, path
from furlong.sources import landing

#: From kind and keys (day, key) to (day, key, json, failure); json and failure are null where there is no document.
Fetch = Callable[[str, DataFrame], DataFrame]

STORED = {
    "calendar": "key string, json string, fetched_at timestamp, day date",
    "race": "key string, race_date date, track_id int, track_name string, sport string, country string, status string, json string, fetched_at timestamp, day date",
    "game": "key string, game_type string, game_date date, status string, json string, fetched_at timestamp, day date",
}
LOG = "day date, n_races long, n_games long, n_fail long, done boolean, logged_at timestamp"


def from_landing(folder: str) -> Fetch:
    return lambda kind, keys: landing.fetch_keys(keys, kind, folder)


def stored(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException:  # the first run
        return spark.createDataFrame([], schema)


def current(spark: SparkSession, store: str, kind: str) -> DataFrame:
    """The documents of ``kind``, one a key: a key that several days hold is read as it was fetched last."""
    return last_wins(stored(spark, f"{store}/{kind}", STORED[kind]), ["key"], "fetched_at")


def log(spark: SparkSession, store: str) -> DataFrame:
    """The last entry of each day."""
    return last_wins(stored(spark, f"{store}/log", LOG), ["day"], "logged_at")


def open_days(spark: SparkSession, store: str, days: DataFrame) -> DataFrame:
    return days.join(log(spark, store).where("done").select("day"), "day", "left_anti")


def _keyed(kind: str) -> dict[str, Column]:
    """The columns that are read from a document or its key, so that scans need not parse it."""
    doc = F.try_parse_json("json")
    of = lambda at, to="string": path(doc, at, to)
    if kind == "race":
        return {
            "race_date": F.substring(of("$.date"), 1, 10).try_cast("date"), "track_id": of("$.track.id", "int"), "track_name": of("$.track.name"),
            "sport": of("$.sport"), "country": of("$.track.countryCode"), "status": of("$.status"),
        }
    return {"status": of("$.status")} if kind == "game" else {}


def upsert(spark: SparkSession, store: str, kind: str, rows: DataFrame, days: list[dt.date]) -> None:
    """Put ``rows`` (key, day, json), all of ``days``, in place of those of the same keys; other days are neither read nor written."""
    new = rows.withColumn("fetched_at", F.current_timestamp()).withColumns(_keyed(kind))
    if kind == "game":
        new = landing.game_parts(new)
    names = [f.split()[0] for f in STORED[kind].split(", ")]
    have = stored(spark, f"{store}/{kind}", STORED[kind]).where(F.col("day").isin(days))
    merged = last_wins(have.select(*names).unionByName(new.select(*names)), ["key", "day"], "fetched_at")
    merged.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{store}/{kind}")


def take_in(
    fetch: Fetch, store: str, days: DataFrame, countries: list[str] | None = None, skip_games: bool = False, refetch: bool = False
) -> DataFrame:
    """Takes in ``days`` and logs each: (day, n_races, n_games, n_fail, done).

    Races and games already stored count but are not fetched, unless ``refetch``; games must be finished. A document that cannot be had, or is
    no JSON object, is a failure, and leaves its day open while the others of the batch are done. A day without a calendar is done with nothing. Fetched documents
    are staged in the store, so that no lost executor makes them be fetched again.
    """
    spark = days.sparkSession
    staging, n = f"{store}/staging/{uuid.uuid4().hex}", 0

    def staged(kind: str, keys: DataFrame) -> DataFrame:
        nonlocal n
        n += 1
        got = fetch(kind, keys)
        is_object = F.startswith(F.schema_of_variant(F.try_parse_json("json")), F.lit("OBJECT"))
        bad = F.coalesce("failure", F.when(F.col("json").isNotNull() & ~F.coalesce(is_object, F.lit(False)), "not a JSON object"))
        got.select("day", "key", F.when(bad.isNull(), F.col("json")).alias("json"), bad.alias("failure")).write.parquet(f"{staging}/{n}")
        return spark.read.parquet(f"{staging}/{n}")

    found = staged("calendar", days.select("day", F.col("day").cast("string").alias("key")).distinct())
    calendars = found.where("json is not null")
    parsed = calendars.select("day", F.parse_json("json").alias("doc"))
    counts = found.select("day", F.lit(None).cast("string").alias("kind"), F.col("failure").isNotNull().alias("failed"))
    new = {"calendar": calendars}
    for kind, want in [("race", landing.wanted_races(parsed, countries))] + ([] if skip_games else [("game", landing.wanted_games(parsed))]):
        have = stored(spark, f"{store}/{kind}", STORED[kind]).select("key").distinct()
        # A key that two days ask for is fetched for the first.
        missing = (want if refetch else want.join(have, "key", "left_anti")).groupBy("key").agg(F.min("day").alias("day"))
        got = staged(kind, missing.select("day", "key"))
        taken = got.where("json is not null")
        if kind == "game":
            taken = taken.where(path(F.parse_json("json"), "$.status", "string") == "results")
        new[kind] = taken
        held = want.join(have.union(taken.select("key")), "key", "left_semi").select("day", "key")
        counts = counts.union(held.select("day", F.lit(kind), F.lit(False)))
        failed = want.join(got.where("failure is not null").select("key"), "key", "left_semi")
        counts = counts.union(failed.select("day", F.lit(None).cast("string"), F.lit(True)))
    n_fail = F.count_if("failed")
    report = counts.groupBy("day").agg(
        F.count_if(F.col("kind") == "race").alias("n_races"), F.count_if(F.col("kind") == "game").alias("n_games"),
        n_fail.alias("n_fail"), (n_fail == 0).alias("done"),
    )
    rows = report.collect()  # one a day
    for kind, taken in new.items():
        upsert(spark, store, kind, taken, [r.day for r in rows])
    out = spark.createDataFrame(rows, LOG.rsplit(",", 1)[0])
    out.withColumn("logged_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{store}/log")
    _remove(spark, staging)
    return out


def _remove(spark: SparkSession, folder: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ingest(
    spark: SparkSession, fetch: Fetch, store: str, first: dt.date, last: dt.date, countries: list[str] | None = None, skip_games: bool = False,
    refetch: bool = False,
) -> DataFrame:
    """``take_in`` of the days from ``first`` to ``last`` that are not done, as one batch; with ``refetch`` of all of them."""
    days = landing.days(spark, first, last)
    return take_in(fetch, store, days if refetch else open_days(spark, store, days), countries, skip_games, refetch)


def ingest_stream(
    spark: SparkSession, fetch: Fetch, store: str, first: dt.date, last: dt.date, countries: list[str] | None = None, skip_games: bool = False,
    days_per_batch: int = 7,
) -> DataFrame:
    """The same as a stream: open days are put in a queue, batches of them are taken in and logged one after the other; returns this run's days as logged.

    The stream's checkpoint tells which batches are through, so a run that broke off goes on after the last of them. A failing day is logged
    as open: the next run asks for it again, and for nothing that is done.
    """
    days = [r.day for r in open_days(spark, store, landing.days(spark, first, last)).orderBy("day").collect()]
    for k in range(0, len(days), days_per_batch):  # a file is a batch
        part = spark.createDataFrame([(d,) for d in days[k : k + days_per_batch]], "day date")
        part.coalesce(1).write.mode("append").parquet(f"{store}/queue")
    if days:
        batch = lambda df, _: take_in(fetch, store, open_days(spark, store, df.distinct()), countries, skip_games)
        stream = spark.readStream.schema("day date").option("maxFilesPerTrigger", 1).parquet(f"{store}/queue")
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{store}/queue_checkpoint").trigger(availableNow=True).start().awaitTermination()
    return log(spark, store).where(F.col("day").isin(days)).drop("logged_at")
