"""Queries by name, each with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores by their first column.  Spark reads a row group in one task, so a table that is small
    in bytes is one task however many rows it has, and what is worked out from each row would run there."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, rows.columns[0])


def constants(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A short list as a table whose size Catalyst knows, so joins with it are broadcast.  What createDataFrame makes of
    a list has no size, and the other side of a join would be shuffled by the few keys of the list."""
    names = [c.split()[0] for c in schema.split(", ")]
    values = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in rows))
    return spark.range(1).select(F.inline(values)).select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")))
