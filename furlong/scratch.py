"""Tables that one job writes to the shared folder and reads again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written tables: the session's ``spark.checkpoint.dir``.

    Where that is unset a temporary folder serves a session on one machine (tests); on a
    cluster it would be lost with its machine, so there it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="furlong-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


#: For each open ``temporary`` block the folders made in it.
_OPEN: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, every table that a ``Scratch`` wrote within; write what is wanted of them elsewhere before."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for folder in made:
            remove(spark, folder)


class Scratch:
    """Tables that one job writes to the shared folder and reads again.

    Written tables survive lost executors, are read by column, and have a known size, by which
    Spark decides what it broadcasts. ``drop`` removes those that no later step reads, ``close`` all; what is returned to a
    caller reads from them, so only the caller knows when that is. As a context manager it closes at the end.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.top, self.paths = spark, f"{checkpoint_dir(spark)}/furlong-{uuid.uuid4().hex}", []
        for made in _OPEN:
            made.append(self.top)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}/{len(self.paths)}"
        self.paths.append(path)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove what ``write`` returned; None is passed over."""
        for t in tables:
            if t is not None:
                remove(self.spark, t.scratch_path)

    def close(self) -> None:
        remove(self.spark, self.top)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
