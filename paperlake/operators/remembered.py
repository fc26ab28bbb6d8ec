"""Costly functions over rows, called once for each different content and remembered.

A model's embedding of a text, or its score of a claim against a source, is kept under a hash
of the model's name, the version of what it is asked and the whole contents. Rows whose key is
known are joined; of the others each content is asked for once, in requests of some rows. What
fails is not remembered, so the next run asks again, and its rows have no value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.operators.common import kept


def content_key(model: str, version: str, *contents: Column) -> Column:
    """SHA-256 of model, version and the hashes of the stripped contents; null if one is blank."""
    stripped = [F.btrim(c, F.lit(" \n\t\r")) for c in contents]
    blank = F.lit(False)
    for c in stripped:
        blank = blank | F.coalesce(c == "", F.lit(True))
    return F.when(~blank, F.sha2(F.concat_ws("|", F.lit(model), F.lit(version), *[F.sha2(c, 256) for c in stripped]), 256))


def recalled(rows: DataFrame, cache: DataFrame | None, contents: list[str], ask: Callable[[list[tuple]], list[Any]], value: str, kind: T.DataType, model: str, version: str = "1", request: int = 32) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with ``value``, the new cache (key, value)). ``ask`` gets up to ``request``
    tuples of different contents and gives as many values; None is a failure of one, an
    exception or another number of values one of all. Blank contents have no value and are not
    asked for. Of a key that the cache has twice the smallest value counts."""
    keyed = rows.withColumn("_key", content_key(model, version, *[F.col(c) for c in contents]))
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", kind)])
    known = (cache if cache is not None else rows.sparkSession.createDataFrame([], schema)).select("key", "value")
    todo = keyed.where("_key IS NOT NULL").select(F.col("_key").alias("key"), *contents).dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")

    def answers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low in range(0, len(frame), request):
                part = frame.iloc[low : low + request]
                try:
                    got = ask(list(part[contents].itertuples(index=False, name=None)))
                    if len(got) != len(part):
                        raise ValueError("another number of answers")
                except Exception:  # a request may fail in any way; its rows stay without a value
                    got = [None] * len(part)
                yield pd.DataFrame({"key": part["key"].tolist(), "value": got})

    new = kept(todo.mapInPandas(answers, schema).where("value IS NOT NULL"), "answers")
    all_ = known.unionByName(new)
    one = all_.groupBy("key").agg(F.min("value").alias(value)) if not isinstance(kind, T.ArrayType) else all_.groupBy("key").agg(F.first("value").alias(value))
    return keyed.join(one.withColumnRenamed("key", "_key"), "_key", "left").drop("_key"), all_
