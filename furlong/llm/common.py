"""What the corpus operators share: reading tables, column names that cannot clash, cutting lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of that very name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores behind it until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole texts to Python workers at most ``rows`` at a time, in this session from now on.

    Spark's 10,000 are tens of megabytes of text in the executor and again in each worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    spark.conf.set(name, str(rows if now <= 0 else min(now, rows)))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written rows."""
    return Scratch(df.sparkSession).write(df)
