"""Driver tables in the roles that queries give them, and small fixtures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paperlake.operators.common import shared_dir as ensure_checkpoints, shared_path  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of which every text is worked on: if it has fewer splits than the cluster has
    cores, its rows are dealt to all of them; larger tables stay as they are."""
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with the same result in DuckDB's SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def values(data: list[tuple], names: str) -> str:
    """The same fixture as a DuckDB subquery."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(lit, v)) + "]"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in data) + f") AS v({names}))"
