"""Weighted rendezvous (highest random weight) hashing of record keys over shards.

Every shard draws a number for a key from a hash of both; the largest of ``-weight / ln(u)``
takes it. A new shard only adds one draw, so the keys that move all move into it, in
proportion to its weight. Law ``key``: nothing but key and shards decide, so rows of one key
(null is a key too) share a shard, however many they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from paperlake.llm.common import named_apart


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 to len(weights) - 1) of ``key``; all weights must be above zero."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights above zero are needed")
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    draws = []
    for shard, weight in enumerate(weights):
        # 53 bits, moved off both ends: 0 < u < 1
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(shard), text), 11).cast("double") + 0.5) / float(1 << 53)
        draws.append(F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(shard).alias("shard")))
    return (F.greatest(*draws) if len(draws) > 1 else draws[0])["shard"]


def assign(docs: DataFrame, weights: Sequence[float], doc_id: str = "doc_id", text: str = "text", buckets: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size``: UTF-8 bytes of the text (null: none) plus 8. ``slot`` counts the rows of a shard
    from 0 without gaps: a shard's rows are dealt over ``buckets`` by their hash, numbered in
    each, and moved by the rows of the buckets before, so no task holds a whole shard. Slots
    of equal rows are interchangeable. ``grown_shard``: the shard with one more of the last
    weight. Empty tables give no rows; extra columns are not looked at.
    """
    weights = list(weights)
    key = F.col(doc_id)
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(key.alias("doc_id"), (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), shard_of(key, weights).alias("shard"), shard_of(key, [*weights, weights[-1]]).alias("grown_shard"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    # at most len(weights) * buckets rows, whatever the input
    rows = rows.withColumn("own", own).join(F.broadcast(before), ["shard", "bucket"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast(T.IntegerType()).alias("shard"), (F.col("before") + F.col("own")).cast("long").alias("slot"), F.col("grown_shard").cast(T.IntegerType()).alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], doc_id: str = "doc_id", files: int = 8) -> None:
    """Writes ``docs`` under ``path`` in folders ``shard=N``; a shard is spread over ``files``
    tasks by the hash of its rows. A column ``shard`` of the table is replaced."""
    rows = docs.withColumn("shard", shard_of(F.col(doc_id), weights))
    (part,) = named_apart(rows, "_part")
    rows = rows.withColumn(part, F.pmod(F.xxhash64(*docs.columns), F.lit(files)))
    rows.repartition("shard", part).drop(part).write.mode("overwrite").partitionBy("shard").parquet(path)
