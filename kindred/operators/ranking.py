"""Ranks, running sums and values of a group, by windows whose order always ends in a tie key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.columns import entropy_term, lit
from kindred.sources.shared import table


def best_first(key: str | list[str], value: str, tie: str):
    return Window.partitionBy(key).orderBy(F.col(value).desc(), F.col(tie))


def grouped_rank(df: DataFrame, key: str, value: str, tie: str, out: str = "rank") -> DataFrame:
    """1-based rank by ``value`` descending within ``key``, ties by ``tie`` ascending."""
    return df.withColumn(out, F.row_number().over(best_first(key, value, tie)).cast("bigint"))


def group_broadcast(df: DataFrame, key: str, value: str) -> DataFrame:
    """Each row with its group's maximum, sum and count of ``value``."""
    w = Window.partitionBy(key)
    return df.withColumns({"g_max": F.max(value).over(w), "g_sum": F.sum(value).over(w), "g_n": F.count("*").over(w)})


def second_best(df: DataFrame, key: str, value: str, tie: str, out: str = "second") -> DataFrame:
    """The value at rank 2 of each row's group, 0 if there is none."""
    r = grouped_rank(df, key, value, tie, "__r")
    return r.withColumn(out, F.coalesce(F.max(F.when(F.col("__r") == 2, F.col(value))).over(Window.partitionBy(key)), lit(0))).drop("__r")


def group_summary(df: DataFrame, key: str, p: str, tie: str) -> DataFrame:
    """One row a group: best three values, sum, entropy, counts above thresholds, number of rows."""
    r = grouped_rank(df, key, p, tie, "__r")
    at = lambda k: F.coalesce(F.max(F.when(F.col("__r") == k, F.col(p))), lit(0))
    above = lambda t: F.count_if(F.col(p) > t)
    return r.groupBy(key).agg(
        at(1).alias("top1"), at(2).alias("top2"), at(3).alias("top3"), F.sum(p).alias("mass"), F.sum(entropy_term(F.col(p))).alias("entropy"),
        above(0.3).alias("n03"), above(0.5).alias("n05"), above(0.7).alias("n07"), F.count_if((F.col(p) > 0.2) & (F.col(p) <= 0.8)).alias("n_gray"), F.count("*").alias("n"),
    )


def top_per_group(df: DataFrame, key: str | list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each partition before it shuffles."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def running_true(df: DataFrame, key: str, p: str, y: str, tie: str) -> DataFrame:
    """Rank and number of true rows up to it."""
    w = best_first(key, p, tie)
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).withColumn("tp", F.sum(y).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))


def sums_before(df: DataFrame, sums: list[str], *order: Column) -> DataFrame:
    """``df`` and, as before_x for each x of ``sums``, the sum of x over all rows before a row in ``order``, which has no ties.

    Rows are dealt to ranges of the order; sums run within a range, and over the ranges, of which there are as many as
    shuffle partitions. So no task sees all rows.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = table(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range").agg(*[F.sum(x).alias(f"__{x}") for x in sums])
    totals = totals.select("__range", *[F.coalesce(F.sum(f"__{x}").over(over), F.lit(0)).alias(f"__{x}") for x in sums])
    out = ranged.withColumns({f"before_{x}": F.coalesce(F.sum(x).over(within), F.lit(0)) for x in sums}).join(F.broadcast(totals), "__range")
    return out.withColumns({f"before_{x}": F.col(f"before_{x}") + F.col(f"__{x}") for x in sums}).drop("__range", *[f"__{x}" for x in sums])


def cumulative_budget(groups: DataFrame, size: str, order: list[Column], budget: int) -> DataFrame:
    """Groups in the given order until their sizes reach ``budget``, the crossing group included."""
    return sums_before(groups, [size], *order).where(F.col(f"before_{size}") < budget).drop(f"before_{size}")
