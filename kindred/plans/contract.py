"""How a query and its SQL are held to one result: the same columns, types and rounding on both sides.

Rounding is spelled out, since two engines' round() part ways on halves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK = {"i": "bigint", "d": "double", "s": "string", "b": "boolean"}
DUCK = {"i": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}


@dataclass
class Catalogue:
    """Named queries; ``spec`` lists a query's columns as name:type with i, d (rounded to 6 places), s and b."""

    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, spec: str, sql: str | None = None):
        cols = [c.split(":") for c in spec.split()]

        def wrap(f: Callable[[SparkSession, str], DataFrame]):
            def run(spark: SparkSession, d: str) -> DataFrame:
                typed = lambda c, t: F.floor(F.col(c).cast("double") * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6) if t == "d" else F.col(c).cast(SPARK[t])
                return f(spark, d).select(*[typed(c, t).alias(c) for c, t in cols])

            run.__name__ = name
            run.__doc__ = f.__doc__
            self.queries[name] = run
            if sql is not None:
                typed = ", ".join(f"floor(CAST({c} AS DOUBLE) * 1e6 + 0.5::DOUBLE) / 1e6 AS {c}" if t == "d" else f"CAST({c} AS {DUCK[t]}) AS {c}" for c, t in cols)
                self.oracles[name] = f"SELECT {typed} FROM ({sql})"
            return f

        return wrap
