"""Two-pass external shuffle into shards. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furlong.llm.common import cut, named

#: Up to here (about 16 MB) the buckets' offsets are broadcast; beyond, Spark joins by shuffle.
MAX_BROADCAST_BUCKETS = 1 << 20


def external_shuffle(
    df: DataFrame,
    n_shards: int = 8,
    seed: int = 17,
    bucket_bytes: int = 64 << 20,
    min_buckets: int = 64,
    text_col: str = "text",
) -> DataFrame:
    """All rows and columns of ``df`` in random order, dealt to shards whose counts differ by one at most.

    First pass: a seeded hash of the whole row scatters the rows uniformly into buckets of
    about ``bucket_bytes`` of text, each the one partition of its number. Second pass: each bucket, small
    enough for one task's memory, is sorted by the rows' hashes and then permuted by Fisher-Yates
    (``shuffle`` with a seed). Buckets follow each other by number, so a row's place in the whole is its bucket's
    offset plus its place there; place modulo ``n_shards`` is the shard, the quotient the slot.
    The seed and the rows alone fix every place, whatever the input splits.
    Result: the struct column ``row`` with the input row, ``shard`` int, ``slot`` long. Write it
    with ``partitionBy("shard")`` sorted by slot to get the shard files.

    Null texts weigh nothing. Rows that are equal in all columns share a hash: those, and only those, also
    take a salt from their place in the input, so that many of them spread over all buckets. They cannot be
    told apart, but how many of them a bucket gets may then vary with the splits. Columns must be comparable
    (no maps or variants). Input column names cannot clash, the row travels as one struct.
    An empty table gives an empty result. The rows of the second pass are written once to the
    shared folder, so a lost executor cannot mix two permutations.
    """
    spark = df.sparkSession
    row = F.struct(*[named(c) for c in df.columns])
    n_bytes = df.agg(F.sum(F.octet_length(named(text_col))).alias("b")).first()["b"] or 0
    n_buckets = int(max(min_buckets, -(-n_bytes // bucket_bytes)))
    hashed = df.select(row.alias("row"), F.xxhash64(F.lit(seed), *[named(c) for c in df.columns]).alias("h"))
    equal = cut(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("equal")))
    salt = F.when(F.col("equal").isNotNull(), F.monotonically_increasing_id()).otherwise(0)
    scattered = hashed.join(equal, F.col("h") == F.col("equal"), "left").select(
        "row", "h", F.pmod(F.xxhash64("h", salt), F.lit(n_buckets)).cast("int").alias("bucket")
    )
    gathered = scattered.repartitionById(n_buckets, "bucket").groupBy("bucket").agg(
        F.sort_array(F.collect_list(F.struct("h", "row"))).alias("rows")
    )
    permuted = gathered.select("bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("place", "x"))
    placed = cut(permuted.select("bucket", "place", "x.row"))
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    # One row per bucket, so this window stays small: a million buckets at 64 TB.
    offsets = counts.select(
        "bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("offset")
    )
    # n_buckets rows of two numbers: known before the job, so the rows need no second shuffle.
    if n_buckets <= MAX_BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    spot = F.col("offset") + F.col("place")
    return placed.join(offsets, "bucket").select(
        "row", F.pmod(spot, F.lit(n_shards)).cast("int").alias("shard"), F.floor(spot / n_shards).cast("long").alias("slot")
    )
