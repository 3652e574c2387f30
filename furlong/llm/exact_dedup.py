"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm.common import Scratch, cut, free_name, named

PREFIX_CHARS = 128
#: Up to so many lengths (16 MB) their list is broadcast; beyond, Spark joins by shuffle.
MAX_LENGTHS = 1 << 20


def _survivors(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that share ``keys`` with another row; both sides of the join are written tables or plain scans."""
    shared = cut(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*keys))
    return rows.join(shared, keys, "left_semi")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with identical texts the one with the largest id stays. Texts are grouped by
    UTF-8 length; rows alone in their length drop out, the others are grouped by a hash of
    their first ``PREFIX_CHARS`` characters, and only rows that still share both go on to the
    full hash. The digest of every row is a column of the result, so the one scan that
    reads the texts takes it too; what the refinement saves is grouping and moving digests.
    Every grouping is a partial count before its shuffle, so a hot group moves one row a task.

    Null texts count as empty. Rows with equal text and equal id (repeated rows): one of them is kept. Null
    ids lose against any other id; a group of null ids keeps one row with a null keep_id.
    Extra columns are ignored. An empty table gives an empty result.
    """
    text = F.coalesce(named(text_col), F.lit(""))
    rows = cut(
        df.select(
            F.monotonically_increasing_id().alias("row"),
            named(id_col).alias("doc_id"),
            F.octet_length(text).alias("n_bytes"),
            F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("prefix"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
        )
    )
    slim = rows.select("row", "doc_id", "n_bytes", "prefix", "digest")
    by_length = _survivors(slim, ["n_bytes"])
    by_prefix = _survivors(by_length, ["n_bytes", "prefix"])
    groups = cut(
        by_prefix.groupBy("digest")
        .agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n")
    )
    return rows.join(groups, "digest", "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of identical texts, the one with the largest id; all columns unchanged.

    Rows are refined step by step: a list of shared lengths; of the rows with such a length, a hash of their first ``PREFIX_CHARS``
    characters; the written ids of those that share both. Only the texts of these ids are read to their end and hashed. All passes
    group lengths, hashes and ids; texts only meet the list of suspects and the list of rows that go, by id.

    Null texts count as empty. Of repeated rows with one id and text one stays, any of those that differ in other
    columns. Null ids lose against any other. Column names of ``df`` cannot clash. An empty table gives an empty result.
    """
    text = F.coalesce(named(text_col), F.lit(""))
    scratch = Scratch(df.sparkSession)
    lengths = df.select(F.octet_length(text).alias("n_bytes")).groupBy("n_bytes").agg(F.count("*").alias("n"))
    lengths = scratch.write(lengths.where("n > 1").select("n_bytes"))
    alike = df.select(named(id_col).alias("id"), F.octet_length(text).alias("n_bytes"), F.xxhash64(F.substring(text, 1, PREFIX_CHARS)).alias("prefix"))
    alike = alike.join(F.broadcast(lengths) if lengths.count() <= MAX_LENGTHS else lengths, "n_bytes", "left_semi")
    alike = scratch.write(alike)
    prefixes = alike.groupBy("n_bytes", "prefix").agg(F.count("*").alias("n")).where("n > 1").select("n_bytes", "prefix")
    prefixes = scratch.write(prefixes)
    suspects = scratch.write(alike.join(prefixes, ["n_bytes", "prefix"], "left_semi").select("id").distinct())
    # Equal rows become one with their number before anything is shuffled.
    texts = df.select(named(id_col).alias("own_id"), text.alias("text")).join(suspects, F.col("own_id").eqNullSafe(F.col("id")), "left_semi")
    hashed = texts.select(F.col("own_id").alias("id"), F.xxhash64("text").alias("h"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = scratch.write(hashed.groupBy("digest", "id", "h").agg(F.count("*").alias("n")))
    # Written before the join, so that Spark can broadcast it or split a hot digest.
    groups = scratch.write(rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.sum("n").alias("size")).where("size > 1"))
    judged = scratch.write(rows.join(groups, "digest").select("id", "h", "n", F.col("id").eqNullSafe(F.col("keep_id")).alias("best")))
    scratch.drop(lengths, alike, prefixes, suspects, rows, groups)
    mark = free_name(df, "marked")
    # Joined by id; a text is hashed only where its id is listed, so the hash must not become a key of the join.
    same = lambda marked: named(id_col).eqNullSafe(marked[mark]["id"]) & (F.xxhash64(text).bitwiseXOR(marked[mark]["h"]) == 0)
    listed = lambda rows: rows.select(F.struct("id", "h").alias(mark))
    gone, twice = listed(judged.where("not best or n > 1")), judged.where("best and n > 1")
    left = df.join(gone, same(gone), "left_anti")
    if twice.isEmpty():
        return left
    repeated = listed(twice)
    own = [named(c) for c in df.columns]
    again = df.join(repeated, same(repeated)).dropDuplicates([mark]).select(*own)
    return left.unionByName(again)
