"""Scalar column functions: numbers, hashes, sets and strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that stand for a missing one (fixed values).
PLACEHOLDERS = ("", "na", "n/a", "-", "--", "none", "null", "nil", "0", ".")


def lit(x: float) -> Column:
    return F.lit(float(x))


def hash_score(a: Column, b: Column) -> Column:
    """A score in [0, 1) that depends on two ids; the prime denominator keeps it off halves of decimals."""
    return F.pmod(F.lit(7919) * a + F.lit(104729) * b, F.lit(997)) / lit(997)


def clip(x: Column, eps: float) -> Column:
    return F.greatest(lit(eps), F.least(lit(1 - eps), x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps)
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def odds(p: Column) -> Column:
    q = F.least(p, lit(1 - 1e-6))
    return q / (1 - q)


def smooth_idf(n: Column, df: Column) -> Column:
    return F.ln((1 + n) / (1 + df)) + 1


def entropy_term(p: Column) -> Column:
    return -p * F.ln(F.greatest(p, lit(1e-9)))


def f_beta(tp: Column, chosen: Column, gold: Column) -> Column:
    """F0.5: 1.25 tp / (chosen + 0.25 gold); 1 if both are empty, 0 without a true one."""
    return F.when(gold == 0, (chosen == 0).cast("double")).when(tp == 0, lit(0)).otherwise(1.25 * tp / (chosen + 0.25 * gold))


def safe_div(a: Column, b: Column, floor: float = 1e-9) -> Column:
    return a / F.greatest(b, lit(floor))


def recalibrate(p: Column, a: float, b: float) -> Column:
    """sigmoid(a logit(p) + b); zero stays zero."""
    return F.when(p <= 0, lit(0)).otherwise(sigmoid(lit(a) * logit(p, 1e-7) + lit(b)))


def bucket(p: Column, bins: int = 10) -> Column:
    """Equal-width bins of [0, 1]; the right edge belongs to the last."""
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("bigint")


def md5_bucket(id_: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(id_.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))


def uniform(id_: Column, seed: str) -> Column:
    """A number in [0, 1) from an id and a seed, the same in any engine that has MD5."""
    h = F.md5(F.concat(id_.cast("string"), F.lit("|" + seed)).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / lit(4294967296)


def is_placeholder(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin(*PLACEHOLDERS)


def coalesce_empty(core: Column, full: Column) -> Column:
    return F.when(F.length(core) > 0, core).otherwise(full)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; null if both are empty."""
    return F.when((F.size(a) > 0) | (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def overlap(a: Column, b: Column) -> Column:
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small)


def containment(a: Column, b: Column) -> Column:
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), lit(0), lambda s, x: s + x)


def region_key(addr: Column) -> Column:
    """The last but one non-empty field between commas, else the last, in lower case."""
    f = F.filter(F.transform(F.split(addr, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.lower(F.coalesce(F.when(F.size(f) >= 2, F.get(f, F.size(f) - 2)), F.get(f, F.size(f) - 1), F.lit("")))


def squeezed(c: Column) -> Column:
    """Lower case, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\x0B\f\r]+", " "))


def country_key(c: Column) -> Column:
    k = squeezed(F.coalesce(c, F.lit("")))
    return F.when(k == "", F.lit("__na__")).otherwise(k)
