"""Aggregations: histograms, bands, modes with support, densities, votes and set algebra of relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.columns import bucket

#: Bounds of logit-spaced bands (fixed values): 40 steps of the logit from -5 to 8, with 0 and 1 outside.
BANDS = 40
LOW, HIGH = -5.0, 8.0


def weighted_counts(df: DataFrame, key: str, weight: Column) -> DataFrame:
    """(key, n, total): rows and sum of weights by value."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.sum(weight).alias("total"))


def distinct_counts(df: DataFrame, by: str, *cols: str) -> DataFrame:
    return df.groupBy(by).agg(*[F.countDistinct(c).alias(f"n_{c}") for c in cols])


def percentiles(df: DataFrame, by: str, value: str, at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles with linear interpolation. Values are counted, their places found by sums over ranges, and the two values about
    each percentile's place picked; no group is held by one task. Nulls don't count."""
    from kindred.operators.ranking import sums_before

    c = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    c = sums_before(c, ["n"], F.col(by).asc_nulls_first(), F.col(value).asc())
    g = c.groupBy(F.col(by).alias("__by")).agg(F.min("before_n").alias("__first"), F.sum("n").alias("__n"))
    d = c.join(g, F.col(by).eqNullSafe(F.col("__by"))).withColumn("__at", F.col("before_n") - F.col("__first"))
    x = F.col(value).cast("double")
    holds = lambda place: (F.col("__at") <= place) & (place < F.col("__at") + F.col("n"))
    cols = []
    for q in at:
        place = F.lit(float(q)) * (F.col("__n") - 1)
        low, high = F.floor(place), F.ceil(place)
        cols += [F.max(F.when(holds(low), x)).alias(f"__l{q}"), F.max(F.when(holds(high), x)).alias(f"__h{q}"), F.max(place - low).alias(f"__f{q}")]
    mid = lambda q: F.col(f"`__l{q}`") + (F.col(f"`__h{q}`") - F.col(f"`__l{q}`")) * F.col(f"`__f{q}`")
    return d.groupBy(by).agg(*cols).select(by, *[mid(q).alias(f"p{round(q * 100)}") for q in at])


def histogram(df: DataFrame, p: str, bins: int = 10) -> DataFrame:
    return df.groupBy(bucket(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"))


def band(p: Column) -> Column:
    """Number of the logit-spaced band of a probability: 0 below the first bound, BANDS at or above the last."""
    z = F.ln(p / (1 - p))
    step = (HIGH - LOW) / (BANDS - 1)
    return F.when(p <= 0, F.lit(0)).when(p >= 1, F.lit(BANDS)).otherwise(F.greatest(F.lit(0), F.least(F.lit(BANDS), F.floor((z - LOW) / step + 1e-9) + 1))).cast("bigint")


def mode_with_share(pairs: DataFrame, key: str, value: str, least: int = 2, share: float = 0.6) -> DataFrame:
    """(key, value, n, share): each key's commonest value, if it comes often enough and often enough of all."""
    n = pairs.groupBy(key, value).agg(F.count("*").alias("n"))
    n = n.withColumn("__all", F.sum("n").over(Window.partitionBy(key))).withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), value)))
    return n.where((F.col("__r") == 1) & (F.col("n") >= least) & (F.col("n") / F.col("__all") >= share)).select(key, value, "n", (F.col("n") / F.col("__all")).alias("share"))


def most_common(df: DataFrame, value: str, n: int) -> DataFrame:
    """The ``n`` most frequent values, ties by value."""
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), value).limit(n)


def density(pool: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """(key, pool, anchors, density) by partition."""
    p, a = pool.groupBy(key).agg(F.count("*").alias("pool")), anchors.groupBy(key).agg(F.count("*").alias("anchors"))
    return a.join(p, key, "left").select(key, F.coalesce("pool", F.lit(0)).alias("pool"), "anchors", (F.coalesce("pool", F.lit(0)) / F.col("anchors")).alias("density"))


def partition_vote(gold: DataFrame, keys: DataFrame, least: float = 0.999) -> DataFrame:
    """(same, partitioned): share of gold pairs (s1, cand) whose two keys agree, and whether that allows matching within keys only."""
    a = keys.select(F.col("id").alias("s1"), F.col("key").alias("ka"))
    b = keys.select(F.col("id").alias("cand"), F.col("key").alias("kb"))
    v = gold.join(a, "s1").join(b, "cand").agg(F.avg((F.col("ka") == F.col("kb")).cast("double")).alias("same"))
    return v.withColumn("partitioned", F.coalesce(F.col("same") >= least, F.lit(False)))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: that of the least ``order``; rows without a key go."""
    w = Window.partitionBy(key).orderBy(order)
    return df.where(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) != "").withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
