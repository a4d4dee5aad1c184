"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws u from a hash of its id; its exponential key is -ln(u) / weight. A source whose target is T of S
words takes floor(T / S) complete epochs and, for the rest, the documents of the smallest keys up to the budget, and one
more that best fills what is then missing. What decides a document is therefore a threshold and an id for each source. The threshold is found by two rounds of sums over key
ranges, so no task ever sorts a whole source. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import SPACES, SPACES_RE, small, table
from kindred.operators.ranking import sums_before

#: Ranges of a key's first and second round; a third of 10^11 documents leaves some ten thousand for the last.
RANGES = 1024
#: How much symbols count against a document: at one for every so many words its weight is halved.
SYMBOLS = 10.0
#: A source gives at most so many times its own size.
MAX_REPEATS = 3


def word_count(text: Column) -> Column:
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACES_RE))).cast("long")


def quality_weight(text: Column, size: Column) -> Column:
    """A document's weight, from 0 to 1: the share of its lines that are different ones, over 1 + SYMBOLS times its symbols (those
    that op1 counts) a word, and a quarter of that where words don't have 3 to 8 characters on average, white space counted once."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(size, F.lit(1))
    lines = F.split(t, "\n")
    different = F.size(F.array_distinct(lines)) / F.size(lines)
    symbols = F.regexp_count(t, F.lit(r"[#*$%&|<>]")) / n
    plain = F.when((F.char_length(t) / n).between(4, 9), F.lit(1.0)).otherwise(F.lit(0.25))
    return different / (1.0 + F.lit(SYMBOLS) * symbols) * plain


def with_key(rows: DataFrame, seed: int = 7) -> DataFrame:
    """``rows`` with doc_id and text, and their size and key."""
    nameless = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), nameless), F.lit(f"|{seed}"))
    u = (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    d = rows.withColumn("size", word_count(F.col("text")))
    return d.withColumn("key", -F.log(u) / quality_weight(F.col("text"), F.col("size")))


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """(doc_id, source, size, key) of every row. A null source or text is a value like any other; rows of null ids are told apart by their texts."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    return with_key(rows, seed).drop("text")


def _range(key: Column, rounds: int) -> Column:
    return F.least(F.floor((1.0 - F.exp(-key)) * F.lit(float(RANGES**rounds))), F.lit(RANGES**rounds - 1))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row for each source.

    Sources by code point, null last, weigh ``weights`` repeating and share the sum of all sizes; a target stops at
    MAX_REPEATS times its source's size and the excess goes to the others by weight. With the sources in order of cap /
    weight, the level L at which sum(min(cap, L * weight)) is the whole is that of the first source it doesn't fill.
    """
    ranks = sums_before(sizes.withColumn("one", F.lit(1).cast("long")), ["one"], F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("before_one", F.lit(len(weights))) + 1).cast("int"))
    d = ranks.withColumn("w", w).withColumn("cap", (MAX_REPEATS * F.col("source_size")).cast("double")).select("source", "source_size", "w", "cap", (F.col("cap") / F.col("w")).alias("fill"))
    d = sums_before(d, ["cap", "w"], F.col("fill").asc(), F.col("source").asc_nulls_last())
    whole = d.agg(F.sum("source_size").cast("double").alias("total"), F.sum("w").alias("all_w"))
    d = d.crossJoin(F.broadcast(whole))
    level = (F.col("total") - F.col("before_cap")) / (F.col("all_w") - F.col("before_w"))
    first = d.agg(F.min(F.when(F.col("cap") >= level * F.col("w"), F.struct("fill", level.alias("l"))))["l"].alias("level"))
    d = d.crossJoin(F.broadcast(first))
    return d.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def plan(base: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, budget, last_key, last_id, low, fill_key, fill_id) from keyed rows that are already written.

    A row is in the fractional part if (key, doc_id) is not above (last_key, last_id), the last that fits the budget, or
    if it is the one that fills what is missing best. Rows of equal key and id go together.
    """
    b = base.where("size > 0").withColumn("r1", _range(F.col("key"), 1)).withColumn("r2", _range(F.col("key"), 2))
    t = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")))
    t = t.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    t = small(table(t.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size")), "sources"))

    def cross(rows: DataFrame, bound: DataFrame, by: str) -> DataFrame:
        """Of each source, the range of ``by`` in which the budget ends, and what lies before it."""
        sums = rows.groupBy("source", by).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("n").over(run))
        hit = sums.withColumnRenamed("source", "__s").join(bound, F.col("__s").eqNullSafe(F.col("source")))
        hit = hit.where((F.col("done") + F.col("upto") >= F.col("budget")) & (F.col("done") + F.col("upto") - F.col("n") < F.col("budget")))
        return hit.select("source", "budget", F.col(by).alias("at"), (F.col("done") + F.col("upto") - F.col("n")).alias("done"))

    def inside(rows: DataFrame, hit: DataFrame, by: str) -> DataFrame:
        h = hit.select(F.col("source").alias("__s"), F.col("at").alias("__at"))
        return rows.join(h, F.col("source").eqNullSafe(F.col("__s")) & (F.col(by) == F.col("__at"))).drop("__s", "__at")

    one = small(table(cross(b, t.where("budget > 0").select("source", "budget", F.lit(0).cast("long").alias("done")), "r1"), "first"))
    two = small(table(cross(inside(b, one, "r1"), one.select("source", "budget", "done"), "r2"), "second"))
    rest = inside(b, two, "r2").groupBy("source", "key", "doc_id").agg(F.sum("size").alias("n"))
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_first())
    rest = rest.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = two.select(F.col("source").alias("__s"), "budget", "done")
    fits = rest.join(ends, F.col("source").eqNullSafe(F.col("__s"))).where(F.col("done") + F.col("upto") <= F.col("budget"))
    last = fits.groupBy("source").agg(F.max(F.struct("upto", "key", "doc_id")).alias("last")).withColumnRenamed("source", "__l")
    bound = two.select(F.col("source").alias("__b"), F.col("at").alias("low"), "done")
    out = t.join(bound, F.col("source").eqNullSafe(F.col("__b")), "left").join(last, F.col("source").eqNullSafe(F.col("__l")), "left")
    gap = F.col("budget") - F.coalesce(F.col("done") + F.coalesce(F.col("last.upto"), F.lit(0)), F.lit(0))
    out = out.select("source", "source_size", "target", "epochs", "budget", F.col("last.key").alias("last_key"), F.col("last.doc_id").alias("last_id"), "low", gap.alias("gap"))
    out = small(table(out, "prefix"))
    # one document more: of those left, that whose size is nearest to what is missing, if that is an improvement
    left = b.join(out.withColumnRenamed("source", "__p"), F.col("source").eqNullSafe(F.col("__p"))).where(F.col("budget") > 0).where(~_in_prefix())
    left = left.groupBy("source", "key", "doc_id").agg(F.sum("size").alias("n"), F.first("gap").alias("gap")).withColumn("off", F.abs(F.col("n") - F.col("gap"))).where("off < gap")
    fill = left.groupBy(F.col("source").alias("__f")).agg(F.min(F.struct("off", "key", "doc_id")).alias("f"))
    out = out.join(fill, F.col("source").eqNullSafe(F.col("__f")), "left")
    return out.select("source", "source_size", "target", "epochs", "budget", "last_key", "last_id", "low", F.col("f.key").alias("fill_key"), F.col("f.doc_id").alias("fill_id"))


def _in_prefix() -> Column:
    """Whether a row (key, doc_id) is not above its source's (last_key, last_id), or in a range of keys below that of the budget's end."""
    same = (F.col("key") == F.col("last_key")) & (F.col("last_id").isNull() == F.col("doc_id").isNull())
    upto = (F.col("key") < F.col("last_key")) | (same & F.coalesce(F.col("doc_id") <= F.col("last_id"), F.lit(True)))
    return F.coalesce(upto, _range(F.col("key"), 2) < F.col("low"), F.lit(False))


def decided(base: DataFrame, p: DataFrame) -> DataFrame:
    """``base`` and source_size, target, copies and taken of each row."""
    p = p.withColumnRenamed("source", "__p")
    d = base.join(p, F.col("source").eqNullSafe(F.col("__p")), "left")
    more = F.coalesce((F.col("key") == F.col("fill_key")) & F.col("doc_id").eqNullSafe(F.col("fill_id")), F.lit(False))
    extra = (F.col("budget") > 0) & (_in_prefix() | more)
    d = d.withColumn("copies", F.col("epochs") + extra.cast("long")).withColumn("taken", F.col("size") * F.col("copies"))
    return d.drop("__p", "epochs", "budget", "last_key", "last_id", "low", "fill_key", "fill_id")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of ``docs``; reruns agree.

    Texts without words have size 0 and are taken 0 words. Repeated rows share one key and one fate. An empty table
    gives no rows. Other columns, whatever their names, are not read.
    """
    base = table(keyed(docs, doc_id, text, source, seed), "keyed")
    p = small(table(plan(base), "plan"))
    return decided(base, p).drop("key")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, same columns. Only thresholds meet the texts: no text is shuffled."""
    base = table(keyed(docs, doc_id, text, source, seed), "keyed")
    p = small(table(plan(base), "plan"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    k = docs.select(row, F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    k = with_key(k, seed).drop("text")
    d = decided(k, p).where("copies > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return d.select("__row.*")
