"""Helpers of all operators: exact rounding, total orders, checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sides of up to so many rows are broadcast after they were counted.
BROADCAST_ROWS = 100_000


def micro(c: Column) -> Column:
    """A score in millionths, rounded half up: ranks and results don't depend on the order in
    which doubles were added."""
    return F.floor(c * 1e6 + 0.5).cast("long")


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in a total order. Spark limits groups before the
    shuffle, so no task gets more than k rows of a group from each other task."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a table or columns of one, with a broadcast hint if it has few rows, which is
    checked by counting up to the bound; else as it is, so that the join shuffles. What has to
    be computed first goes through ``kept``, or the count would compute it a second time."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def blocks(df: DataFrame, most: int = BROADCAST_ROWS) -> list[DataFrame]:
    """A stated set of queries in parts of about ``most`` rows at most, each with a broadcast
    hint: what has to be held against all rows of a table then meets it part by part."""
    n = -(-df.count() // most)
    if n <= 1:
        return [F.broadcast(df)]
    part = F.pmod(F.xxhash64(*df.columns), F.lit(2 * n))
    return [F.broadcast(df.where(part == i)) for i in range(2 * n)]


def light(df: DataFrame, text: str = "text", most: int = 32 << 20) -> bool:
    """Whether the texts of a table have few bytes, so that what follows from each of their
    words is small too."""
    return (df.agg(F.sum(F.octet_length(text))).first()[0] or 0) <= most


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which driver and executors share. Only
    where a session on one machine has none (tests) a temporary one is made."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """``df`` written to the shared folder and read again, so that all that use it compute it
    once and a lost executor costs a reread."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidied(spark: SparkSession) -> None:
    """Lets Spark delete what finished steps left: shuffle files, checkpoints and broadcasts go
    once the driver has collected the garbage that refers to them, which a driver with memory to
    spare may put off beyond the last of many rounds."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
