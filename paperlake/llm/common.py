"""What the training-data operators share: tables, the shared folder, graph components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Of the row groups of ``stored`` tables.
GROUP_BYTES = 8 << 20
#: Of ``components``: up to so many edges, counted, its sides are broadcast.
FEW_EDGES = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only where a session on one machine has none (tests) a temporary one is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def whole_numbers(df: DataFrame, name: str) -> None:
    """Refuses ids of another kind, which the files and orders here have no place for."""
    kind = df.schema[name].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
        raise TypeError(f"{name} must hold whole numbers, not {kind.simpleString()}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends there, so a
    lost executor costs a reread and Python work upstream is not repeated. Row groups are
    small, as a writer, and later a reader, holds a whole one for each task."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the shared folder; for narrow tables."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is to shuffle. Spark takes rows to be as many after an explode as
    before it, also behind a checkpoint, so on its own it broadcasts tables of which the
    driver can't hold the many rows."""
    return df.hint("merge")


def slices(batch: pa.RecordBatch, column: int, most: int = 8 << 20):
    """Parts of ``batch`` whose texts in ``column`` have about ``most`` bytes, one row at least."""
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    part = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for low, high in zip(cuts, cuts[1:]):
        yield batch.slice(low, high - low)


def tidied(spark: SparkSession) -> None:
    """Lets Spark delete what finished steps left: broadcasts in the driver's memory, shuffle files
    and checkpoints go once the driver has collected the garbage that refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def named_apart(docs: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``docs`` has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Gives memory that Arrow and the allocator hold back to the system. Workers live on from
    task to task and stage to stage, so each does this after a batch."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def crc_of_id(doc_id: Column | str) -> Column:
    """crc32 of the id as text; null ids count as the text ''."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of the undirected graph ``edges``: rows (node, root), root the
    smallest node reachable, for every node that has an edge.

    Alternates two star contractions until nothing changes. Each is a grouped minimum
    (combined before the shuffle) and an equi-join that AQE may split, so a node with very
    many edges is no single task. Every round ends in a checkpoint. Sides are broadcast if
    the counted edges are few, and else shuffled, whatever Spark takes their size to be.
    """
    e = saved(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    last, n = None, e.count()
    for _ in range(rounds):
        side = F.broadcast if n <= FEW_EDGES else shuffled
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # every larger neighbour of u is hung below u's smallest neighbour
        large = both.where("v > u").join(side(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        # u and its smaller neighbours are hung below the smallest of them
        small = down.join(side(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = saved(small.where("u <> v").distinct())
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.bit_xor(F.hash("v", "u")).alias("y")).first()
        if now == last:
            break
        last, n = now, now["n"]
        tidied(edges.sparkSession)
    else:
        raise RuntimeError("components did not converge")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(e.select("v", "v").distinct())
