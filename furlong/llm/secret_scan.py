"""Multipart credential linking. DataFrame functions only.

A text is cut into scopes; access identifiers, secrets and endpoints found there are
interval-joined, and weak candidates are reported only next to complementary parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.llm.common import Scratch, cut, free_name, named

#: The base kinds: name, pattern, group that is measured, least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Weak candidates: alone they are too common to report. Name, pattern, part they can play.
WEAK = (
    ("user", r"(?i:\b(user(name)?|login|client_?id|account))\x20*[:=]\x20*[A-Za-z0-9@._-]{3,}", "access"),
    ("key40", r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])", "secret"),
    ("endpoint", r"(?i:https?://[a-z0-9.:/_-]{4,}|\b(host|endpoint|region)\x20*[:=]\x20*[a-z0-9.:/_-]{4,})", "endpoint"),
)
#: What makes a scan for the weak kind worth while; plain substrings, cheap to look for.
HINTS = {"user": r"(?i)user|login|client|account", "endpoint": r"(?i)http|host|endpoint|region"}
#: Parts played by the base kinds.
PARTS = {"assign": "secret", "hex": "secret", "access": "access"} | {k: part for k, _, part in WEAK}
ORDER = ["assign", "access", "hex", "user", "key40", "endpoint"]


def _lengths(text: Column, pattern: str, group: int) -> Column:
    """Of each match the length of the gap before it, its own, and its group's, in code points; empty without a match.

    The gaps come from splitting at the pattern, so a match starts after all gaps and matches before it.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), measured.alias("measured"))
    found = F.transform(
        F.filter(parts, lambda x: x["whole"].isNotNull()),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["whole"]).alias("n"), F.length(x["measured"]).alias("measured")),
    )
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<gap:int,n:int,measured:int>>"))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row per input row: ``row`` (its number), doc_id, ``base`` and ``spans``, arrays of start, rank, end, kind.

    ``base`` holds all matches of the base kinds. ``spans`` adds each weak candidate that has a
    complementary part (another of access, secret, endpoint; base or weak; one of the two a secret) ending or
    starting within ``scope`` code points. Candidates of one kind never overlap, so a
    scope holds a bounded number and the interval join, on text and scope number, stays
    in proportion to the text. Places are running sums over a text's matches, so work is linear in them.

    Null texts count as empty; texts without a match give empty arrays. Repeated rows are
    scanned one by one. Extra columns are ignored. An empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession)
    text = F.col("text")
    none = F.array().cast("array<struct<gap:int,n:int,measured:int>>")
    kinds = [(*kind, True) for kind in BASE] + [(k, p, 0, 1, False) for k, p, _ in WEAK]
    scanned = [
        F.when(text.rlike(HINTS[k]), _lengths(text, p, group)).otherwise(none) if k in HINTS else _lengths(text, p, group)
        for k, p, group, _, _ in kinds
    ]
    rows = df.select(F.monotonically_increasing_id().alias("row"), named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    rows = scratch.write(rows.select("row", "doc_id", F.array(*scanned).alias("kinds")))
    matched = rows.where(F.exists("kinds", lambda x: F.size(x) > 0)).select("row", F.posexplode("kinds").alias("k", "found"))
    matched = matched.select("row", "k", F.posexplode("found").alias("i", "m"))
    before = F.sum(F.col("m.gap").cast("long") + F.col("m.n")).over(Window.partitionBy("row", "k").orderBy("i"))
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("k"))
    placed = matched.withColumn("end", before).where(F.col("m.measured") >= pick([k[3] for k in kinds]))
    x = F.struct(
        (F.col("end") - F.col("m.n")).alias("start"), (pick([ORDER.index(k[0]) + 1 for k in kinds])).alias("rank"), "end", pick([k[0] for k in kinds]).alias("kind")
    )
    placed = scratch.write(placed.select("row", x.alias("x"), pick([PARTS[k[0]] for k in kinds]).alias("part"), pick([k[4] for k in kinds]).alias("is_base")))
    # A complement touches a scope number that a span touches, or a neighbouring one.
    reach = placed.select(
        "row", F.col("x").alias("y"), F.col("part").alias("other"),
        F.explode(F.sequence(F.floor(F.col("x.start") / scope) - 1, F.floor(F.col("x.end") / scope) + 1)).alias("scope_no"),
    )
    weak_only = placed.where("not is_base").select(
        "row", "x", "part", F.explode(F.sequence(F.floor(F.col("x.start") / scope), F.floor(F.col("x.end") / scope))).alias("scope_no")
    )
    linked = (
        weak_only.join(reach, ["row", "scope_no"])
        .where(
            (F.col("part") != F.col("other"))
            & F.lit("secret").isin(F.col("part"), F.col("other"))
            & (F.col("y.start") - F.col("x.end") <= scope)
            & (F.col("x.start") - F.col("y.end") <= scope)
        )
        .select("row", "x", F.lit(False).alias("is_base"))
        .distinct()
    )
    kind = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
    spans = placed.where("is_base").select("row", "x", "is_base").union(linked).groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_base"), F.col("x")))).alias("base"), F.sort_array(F.collect_list("x")).alias("spans")
    )
    return rows.select("row", "doc_id").join(scratch.write(spans), "row", "left").select(
        "row", "doc_id", *[F.coalesce(c, F.array()).cast(kind).alias(c) for c in ("base", "spans")]
    )


def span_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


#: Gaps whose text is taken at once; substrings of a long text are sought from its start.
PART = 128


def _gaps(found: DataFrame) -> DataFrame:
    """What is left between the spans of each text: key, ``parts`` of up to PART gaps (start, n) each, and the end of the last span.

    Overlapping spans count as one. A span is a row here, so work is linear in them.
    """
    x = found.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("key"), "row", F.explode("spans").alias("x")).select("key", "row", "x.start", "x.end")
    w = Window.partitionBy("row").orderBy("start", "end")
    before = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("before", before).withColumn("island", F.sum((F.col("start") >= F.col("before")).cast("int")).over(w))
    islands = x.groupBy("row", "island").agg(F.first("key").alias("key"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("before").alias("before"))
    gap = F.struct(F.col("before").alias("start"), (F.col("start") - F.col("before")).alias("n"))
    parts = islands.groupBy("row", F.floor((F.col("island") - 1) / PART).alias("part")).agg(
        F.first("key").alias("key"), F.min("before").alias("from"), F.max("start").alias("to"), F.max("end").alias("end"), F.sort_array(F.collect_list(gap)).alias("gaps")
    )
    part = F.struct(F.col("from").alias("start"), F.col("to").alias("end"), "gaps")
    return parts.groupBy("row").agg(F.first("key").alias("key"), F.sort_array(F.collect_list(part)).alias("parts"), F.max("end").alias("end"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200, mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every reported span replaced by ``mask``; all other text and columns unchanged.

    Overlapping spans are replaced as one. Null texts stay null. Rows find their spans by id (null is an id too) and a
    hash of the text, so repeated rows and ids with several texts are each masked rightly. Column names of ``df``
    cannot clash. An empty table gives an empty result.
    """
    info = free_name(df, "secrets")
    text, key = named(text_col), F.struct(named(id_col).alias("id"), F.xxhash64(named(text_col)).alias("h"))
    keyed = df.select(key.alias("key"), text.alias("text"))
    found = scan_secrets(keyed, "key", "text", scope).where(F.size("spans") > 0)
    gaps = cut(_gaps(found).select(F.struct("key", "parts", "end").alias(info)))
    held = F.col(info)

    def joined(part: Column) -> Column:
        one = F.transform(part["gaps"], lambda g: F.substring(part["text"], (g["start"] - part["start"] + 1).cast("int"), g["n"].cast("int")))
        return F.array_join(one, mask)

    # A part's text is taken once, and its gaps from that short text.
    parts = F.transform(
        held["parts"], lambda p: F.struct(p["start"], p["gaps"], F.substring(text, (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int")).alias("text"))
    )
    tail = F.substring(text, (held["end"] + 1).cast("int"), F.length(text))
    clean = F.array_join(F.concat(F.transform(parts, joined), F.array(tail)), mask)
    same = named(id_col).eqNullSafe(held["key"]["id"]) & (F.xxhash64(text).bitwiseXOR(held["key"]["h"]) == 0)
    joined_rows = df.join(gaps, same, "left")
    return joined_rows.select(*[F.when(held.isNull(), text).otherwise(clean).alias(c) if c == text_col else named(c) for c in df.columns])
