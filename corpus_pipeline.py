"""A training-data pipeline over documents, in five stages; belongs to the subpackage ``kindred.llm``.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm.bpe import tokenize
from kindred.llm.common import table
from kindred.llm.mixing import mixed
from kindred.llm.nearcopies import one_of_each
from kindred.llm.quality import clean
from kindred.llm.queries import tokenizer_path
from kindred.llm.secret_scan import without_secrets
from kindred.sources.tables import spread


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, less the lines that fail."""
    return clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8 or more): that of the smallest doc_id."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced."""
    return without_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document; with half the cache, as workers keep what other stages left them, too."""
    return tokenize(docs, tokenizer_path(), keep_ids=True, cache=200_000)


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("secret scans", secrets), ("mixing", mixing), ("tokens", tokens)]

#: SQL can't express the near-duplicates, the randomness tests and the tokenizer; tests/llm holds the rows of run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for i, (_, stage) in enumerate(STAGES):
        docs = table(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
