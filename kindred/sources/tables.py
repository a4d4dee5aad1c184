"""Views of the driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.columns import hash_score


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores if it is read in fewer pieces than there are: a small file is one split, and texts take long to
    normalize. Tables of more splits than cores, which all large ones are, are left as they are."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def records(spark: SparkSession, d: str) -> DataFrame:
    """Entity records made of ``documents``: (entity_id, doc_id, src, cty, name, addr, text). A fifth are anchors (S1), the
    rest pool (S2, S3); the name is a text's first line, the address all others."""
    t = F.coalesce(F.col("text"), F.lit(""))
    r = F.pmod("doc_id", F.lit(5))
    src = F.when(r == 0, "S1").when(r <= 2, "S2").otherwise("S3")
    cut = F.instr(t, "\n")
    return spread(read(spark, d, "documents").select("doc_id", "lang", "text")).select(
        F.concat_ws("-", src, F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("entity_id"),
        "doc_id",
        src.alias("src"),
        F.col("lang").alias("cty"),
        F.when(cut > 0, F.expr("substring(text, 1, instr(text, '\n') - 1)")).otherwise(t).alias("name"),
        F.when(cut > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(F.lit("")).alias("addr"),
        t.alias("text"),
    )


def claims(spark: SparkSession, d: str) -> DataFrame:
    """Scored pairs made of ``lineitem``: (s1 = order, cand = part, p in [0, 1), y = returned), one row for each pair."""
    return (
        read(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("s1"), F.col("l_partkey").alias("cand"))
        .agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"))
        .select("s1", "cand", hash_score(F.col("cand"), F.col("s1")).alias("p"), "y")
    )


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """The anchors of ``claims``: all orders, with a country key (customer's nation) and the number of true pool records."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("s1"), "o_custkey")
    c = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("cty"))
    g = claims(spark, d).where("y = 1").groupBy("s1").agg(F.count("*").alias("g"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(g, "s1", "left").select("s1", "cty", F.coalesce("g", F.lit(0)).cast("bigint").alias("g"))
