"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import ship as package
from kindred.sources.shared import table

__all__ = ["SPACES", "SPACES_RE", "parts", "ship", "small", "table", "without", "words_of"]


#: The six ASCII white-space characters that separate words, as text and as a Java regular expression.
SPACES = " \t\n\x0b\x0c\r"
SPACES_RE = r"[\x20\x09-\x0D]+"
#: Rows that a side of a join may have to be sent to every executor; beyond it the join shuffles.
BROADCAST_ROWS = 20_000

#: Rows of a batch that goes to a Python worker, where the session has Spark's own number: texts are long.
BATCH_ROWS = 1000
ROWS_CONF, SPARKS_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ship(spark: SparkSession) -> None:
    """Make ready for Python workers: they can import this package, and get batches that fit texts."""
    package.ship(spark)
    if spark.conf.get(ROWS_CONF) == SPARKS_ROWS:
        spark.conf.set(ROWS_CONF, BATCH_ROWS)


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its operator sets by the size of the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already written) marked for broadcast if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that an operator is about to add; names match in any letter case."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES_RE))
