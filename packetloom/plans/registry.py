"""Registry of named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at 6 places, so that engines that sum in another order still agree; the nudge
    keeps exact half-way values, which such sums put on either side, on one side."""
    return df.select(*[
        (F.round(F.col(f.name) + 3e-10, 6) + 0.0).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
        for f in df.schema.fields])


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return register
