"""Scoring predictions that stand in files, and the rule by which a variant of a pipeline stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.operators import evaluation
from kindred.sources import files


def score_files(spark: SparkSession, matches: str, gold: str, candidates: str | None = None) -> dict[str, DataFrame]:
    """Per-anchor scores, breakdown and, with candidates, the error budget of a file of id lists."""
    g = files.read_tsv(spark, gold)
    first = g.columns[0]
    anchors = g.select(F.trim(first).alias("s1")).distinct().withColumn("cty", F.substring("s1", 1, 2))
    truth = files.explode_gold(g, first, g.columns[1])

    def pairs(path: str) -> DataFrame:
        m = files.read_tsv(spark, path)
        return files.explode_gold(m, m.columns[0], m.columns[1])

    chosen = pairs(matches)
    scored = evaluation.per_anchor(anchors, truth, chosen, pairs(candidates) if candidates else None)
    out = {"anchors": scored, "breakdown": evaluation.breakdown(scored)}
    if candidates:
        out["budget"] = evaluation.error_budget(scored)
    return out


def keep_variant(gain: float, least: float, seconds: float = 0.0, left: float = float("inf")) -> bool:
    """A variant stays if it gains enough on held-out folds and fits in the time that is left."""
    return gain >= least and seconds <= left
