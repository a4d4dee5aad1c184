"""Quality rules, line first: each line meets punctuation, navigation and boilerplate rules; a document that loses too much goes.

A line fails without any punctuation; with marks of menus, or shouting, beyond a share of its characters; or if it has a boilerplate
phrase for every PHRASE_CHARS of them. All rules are asked of lines of every length.

DataFrame functions only. Every document is handled in its own row, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import words_of

OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_bad_lines", "lost_chars", "clean_text", "kept")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document goes if rules remove more than this share (in percent) of the characters in its lines.
MAX_LOST_PERCENT = 40
#: A boilerplate phrase speaks against so many characters of its line.
PHRASE_CHARS = 400
BOILERPLATE = (
    r"(?i)\b(licensed under|all rights reserved|copyright (\(c\)|\xA9)|privacy policy|cookie policy|terms of (use|service)|"
    r"enable javascript|click here|sign up|log ?in to|subscribe (now|to)|read more|share (this|on)|powered by|lorem ipsum)\b"
)


def _line_fails(line: Column) -> Column:
    n = F.char_length(line)
    marks = F.regexp_count(line, F.lit(r"[#*$%&|<>~^={}\\\xBB›•\xB7]"))
    shouts = F.regexp_count(line, F.lit(r"[!?]{2,}|\.{4,}"))
    unpunctuated = ~line.rlike(r"[.,;:!?…。！？]")
    navigation = (marks >= 3) & (marks * 25 > n)
    shouting = (shouts >= 3) & (shouts * 30 > n)
    boilerplate = line.rlike(BOILERPLATE) & (F.regexp_count(line, F.lit(BOILERPLATE)) * PHRASE_CHARS >= n)
    return unpunctuated | navigation | shouting | boilerplate


def with_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and the columns of OUTPUTS, one row for each row.

    A null or empty text has no words and no lines: every count is 0, base_failed is true, clean_text is "". Repeated
    rows are judged alike. Input columns named like an output are replaced. Three-word windows are compared by a 64-bit
    hash of their words.
    """
    own = [c for c in docs.columns if c.lower() not in OUTPUTS]
    # the row goes along as one column, so no name of its own can clash with those in between
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in own], F.lit(True)).alias("__row"), F.col(f"`{text}`").alias("__t"))
    t = F.coalesce(F.col("__t"), F.lit(""))
    n = F.col("n_words")
    d = src.withColumn("__w", words_of(F.col("__t"))).withColumn("n_words", F.size("__w").cast("long"))
    d = d.withColumn(
        "__h",
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), (n - 3).cast("int")), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)))).otherwise(F.array().cast("array<bigint>")),
    )
    d = d.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(F.get("__s", k)["h"] == x["h"], F.lit(False))
    # equal windows are neighbours once sorted; of those, each covers the words up to the next one's start, three at most
    d = d.withColumn("__f", F.sort_array(F.transform(F.filter("__s", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])))
    covered = F.aggregate(F.transform("__f", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("__f", k + 1) - x, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    d = d.withColumn("word_chars", F.char_length(F.array_join("__w", "")).cast("long"))
    d = d.withColumn("n_symbols", F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"))
    d = d.withColumn("__l", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    d = d.withColumn("n_lines", F.size("__l").cast("long"))
    d = d.withColumn("__k", F.filter("__l", lambda x: ~_line_fails(x)))
    d = d.withColumn("n_bad_lines", (F.size("__l") - F.size("__k")).cast("long"))
    d = d.withColumn("clean_text", F.array_join("__k", "\n"))
    chars = F.char_length(F.array_join("__l", "")).cast("long")
    d = d.withColumn("lost_chars", chars - F.char_length(F.array_join("__k", "")))
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    d = d.withColumn("base_failed", failed)
    # the id, always true here, keeps the optimizer from copying all of the above into a filter on this column
    verdict = ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST_PERCENT * chars)
    d = d.withColumn("kept", verdict & (F.monotonically_increasing_id() >= 0))
    return d.select(*[F.col(f"__row.`{c}`").alias(c) for c in own], *OUTPUTS)


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, less the lines that fail; same columns, n_chars brought up to date if there is one."""
    rest = [c for c in docs.columns if c != text]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(True)).alias("__row"), F.col(f"`{text}`").alias("text"))
    d = with_quality(d).where("kept")
    out = {text: F.col("clean_text")} | ({"n_chars": F.char_length("clean_text").cast("long")} if "n_chars" in rest else {})
    return d.select(*[out.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns])
