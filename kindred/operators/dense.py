"""Exact nearest neighbours of dense vectors, block by block: every query against every row as matrix products.

Rows are packed into blocks of bounded size; each block of queries meets each block of rows in one task, which keeps its k
best. The work is what brute force is; no task or executor holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.ship import ship

BLOCK = 4096


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    return pd.DataFrame([(str(pdf["part"].iloc[0]), len(x[0]), int(pdf["block"].iloc[0]), pdf["id"].to_numpy(np.int64).tobytes(), x.tobytes())], columns=["part", "width", "block", "ids", "x"])


def _best(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                q, c = np.frombuffer(r.qids, np.int64), np.frombuffer(r.ids, np.int64)
                s = np.round(np.frombuffer(r.qx).reshape(len(q), -1) @ np.frombuffer(r.x).reshape(len(c), -1).T, 9)
                rows = []
                for i, row in enumerate(s):
                    j = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if len(row) > k else np.arange(len(row))
                    j = j[np.lexsort((c[j], -row[j]))][:k]
                    rows += zip([int(q[i])] * len(j), c[j].tolist(), row[j].tolist(), strict=True)
                yield pd.DataFrame(rows, columns=["s1", "cand", "score"])

    return run


def dense_topk(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(s1, cand, score, rank): of both (part, id, v), the k largest inner products within a part, rounded to 9 places, ties to smaller ids.

    Vectors meet those of their own length. Rows of a null part or id, and vectors that are null or hold null or non-finite
    components, take no part.
    """
    ship(queries.sparkSession)
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))

    def taking_part(df: DataFrame) -> DataFrame:
        return df.where(F.col("part").isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite).select(F.col("part").cast("string").alias("part"), "id", "v", F.size("v").alias("width"))

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("part", "width").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))

    def blocks(df: DataFrame, n: DataFrame, name: str) -> DataFrame:
        d = df.join(n, ["part", "width"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col(name)).cast("int"))
        return d.select("part", "width", "block", "id", "v").groupBy("part", "width", "block").applyInPandas(_pack, "part string, width int, block int, ids binary, x binary")

    q, r = taking_part(queries), taking_part(rows)
    n = counts(r, "blocks")
    # each block of queries goes to every block of rows, a pair of blocks to a task
    asked = blocks(q, counts(q, "asked"), "asked").join(n, ["part", "width"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asked.select("part", "width", "block", F.col("ids").alias("qids"), F.col("x").alias("qx"))
    found = asked.join(blocks(r, n, "blocks"), ["part", "width", "block"]).select("qids", "qx", "ids", "x").mapInPandas(_best(k), "s1 bigint, cand bigint, score double")
    best = F.row_number().over(Window.partitionBy("s1").orderBy(F.col("score").desc(), "cand"))
    return found.withColumn("rank", best.cast("bigint")).where(F.col("rank") <= k)
