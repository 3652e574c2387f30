"""Line-first cleaning: judge every line, drop the failing ones, then judge the document.

DataFrame functions only. All statistics of a document are computed inside its own row
(arrays of words, lines and window hashes), so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, besides the blank.
BLANKS = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A window of this many words counts as repeated when the text holds it twice.
WINDOW = 8

#: A mark that ends a sentence, at the end of the line or before a blank or a closing mark.
SENTENCE_END = r"[.!?…。！？]([\x20\x09\x0B-\x0D\x22'”’»)\]]|$)"
#: Three or more of these in a line: menus, bread crumbs, tables of links.
SEPARATORS = "|»›•·>"
MENU = 3
#: Wording of page furniture; it fails only short lines, prose may mention it.
FURNITURE = (
    r"(?i)\b(cookies?|javascript|privacy policy|terms of (use|service)|all rights reserved|lorem ipsum|"
    r"click here|read more|sign (in|up)|log ?in|subscribe|share this|skip to content|back to top)\b"
)


def _without(text: Column, chars: str, by: str = "") -> Column:
    """``text`` with each of ``chars`` replaced; cheap where a text holds none of them."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(_without(text, chars))


def _line_fails(line: Column, max_furniture_chars: int, max_marks_percent: int) -> Column:
    return (
        (100 * _count(line, SYMBOLS + "!{}") > max_marks_percent * F.length(line))
        | (_count(line, SEPARATORS) >= MENU)
        | ~line.rlike(SENTENCE_END)
        | ((F.length(line) <= max_furniture_chars) & line.rlike(FURNITURE))
    )


def line_first_clean(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    min_kept_percent: int = 50,
    max_furniture_chars: int = 120,
    max_marks_percent: int = 8,
) -> DataFrame:
    """One row per input row: statistics, the text without failing lines, and the verdict.

    A line with a word fails when it has no sentence end or more than ``max_marks_percent``
    of its characters are symbols or exclamation marks (punctuation rule), when it is a menu
    (navigation rule), or when it is short and holds page furniture (boilerplate rule).
    Lines without a word neither fail nor count. A document is kept unless the base rules
    fail it (``n_words < min_words`` or too many repeated words) or the lines left hold
    under ``min_kept_percent`` of the characters of its lines.

    Null and empty texts have no words: they fail the base rule. Repeated rows are judged
    one by one. Other input columns are ignored, so their names cannot clash. An empty
    table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = df.select(
        F.col(id_col).alias("doc_id"),
        text.alias("text"),
        F.array_remove(F.split(_without(text, BLANKS, " "), " "), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    hashed = words.select(
        "doc_id", "text", "lines",
        F.size("words").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    # A 64-bit hash of eight word hashes stands for a window; they are only compared within one text.
    windows = hashed.select(
        "*",
        F.when(
            F.col("n_words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.col("n_words") - WINDOW),
                lambda i: F.xxhash64(F.slice("hashes", i + 1, F.lit(WINDOW))),
            ),
        ).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    ).drop("hashes")
    ordered = windows.select(
        "doc_id", "text", "lines", "n_words",
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("w"),
    )
    twice = ordered.select(
        "doc_id", "text", "lines", "n_words",
        F.when(
            F.col("w").isNotNull(),
            F.sort_array(
                F.transform(
                    F.filter(
                        "w",
                        lambda x, k: F.get("w", k - 1)["h"].eqNullSafe(x["h"])
                        | F.get("w", k + 1)["h"].eqNullSafe(x["h"]),
                    ),
                    lambda x: x["i"],
                )
            ),
        ).alias("at"),
        F.filter("lines", lambda x: ~_line_fails(x, max_furniture_chars, max_marks_percent)).alias("good"),
    )
    covered = F.aggregate(
        F.transform("at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("at", k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    total = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda t, x: t + F.length(x))
    stats = twice.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.length(_without(F.col("text"), BLANKS + " ")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("good").cast("long").alias("n_good_lines"),
        total(F.col("lines")).alias("line_chars"),
        total(F.col("good")).alias("good_chars"),
        F.array_join("good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (100 * F.col("good_chars") >= min_kept_percent * F.col("line_chars"))
    )
