"""Outlines: versions that are only appended, differences, rollback, what a good one has."""

from __future__ import annotations

import difflib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: what saving adds to an outline, and so is no part of its content
META = ["version", "created_at", "parent_version", "content_sha256", "source"]


@F.pandas_udf(T.StringType())
def core(outline: pd.Series) -> pd.Series:
    """An outline's content: compact JSON with sorted keys, without what saving adds. Broken
    JSON, and what is no object, is null."""

    def one(text):
        try:
            data = json.loads(text)
        except (TypeError, ValueError):
            return None
        if not isinstance(data, dict):
            return None
        return json.dumps({k: v for k, v in data.items() if k not in META}, ensure_ascii=False, sort_keys=True, separators=(",", ":"))

    return outline.map(one)


@F.pandas_udf(T.StringType())
def unified_diff(old: pd.Series, new: pd.Series, old_name: pd.Series, new_name: pd.Series) -> pd.Series:
    """A unified diff of two contents (``core``) as indented JSON with sorted keys."""
    lines = lambda t: json.dumps(json.loads(t), ensure_ascii=False, indent=2, sort_keys=True).splitlines()
    return pd.Series(["\n".join(difflib.unified_diff(lines(a), lines(b), fromfile=x, tofile=y, lineterm="")) if a is not None and b is not None else None for a, b, x, y in zip(old, new, old_name, new_name)])


def appended(rows: DataFrame) -> DataFrame:
    """(key, version, parent, content, content_sha, source) of saved contents (key, no, content,
    source): one that equals the latest makes no new version, unless its source is a rollback."""
    w = Window.partitionBy("key").orderBy("no", "content_sha")
    hashed = rows.where("content is not null").withColumn("content_sha", F.sha2("content", 256))
    new = hashed.withColumn("_b", F.lag("content_sha").over(w)).where(~F.col("content_sha").eqNullSafe(F.col("_b")) | F.col("source").startswith("rollback:"))
    numbered = new.withColumn("version", F.row_number().over(w))
    return numbered.select("key", "version", F.nullif(F.col("version") - 1, F.lit(0)).alias("parent"), "content", "content_sha", "source")


def rolled_back(versions: DataFrame, targets: DataFrame) -> DataFrame:
    """``versions`` and, for each target (key, version) that exists, its content once more as
    the newest version, with source ``rollback:vN``."""
    last = versions.groupBy("key").agg(F.max("version").alias("_last"))
    again = versions.join(targets.groupBy("key").agg(F.max("version").alias("_to")), "key").where("version = _to").join(last, "key")
    again = again.select("key", (F.col("_last") + 1).alias("version"), F.col("_last").alias("parent"), "content", "content_sha", F.concat(F.lit("rollback:v"), F.col("_to").cast("string")).alias("source"))
    return versions.unionByName(again)


def differences(versions: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, old, new, diff) for pairs (key, old, new) of versions that exist."""
    side = lambda n, c: versions.select("key", F.col("version").alias(n), F.col("content").alias(c))
    rows = pairs.join(side("old", "_a"), ["key", "old"]).join(side("new", "_b"), ["key", "new"])
    name = lambda c: F.concat(F.lit("v"), F.col(c).cast("string"))
    return rows.select("key", "old", "new", unified_diff("_a", "_b", name("old"), name("new")).alias("diff"))


def changed_sections(old: Column, new: Column) -> Column:
    """What two arrays of sections don't share: (removed, added)."""
    return F.struct(F.array_except(old, new).alias("removed"), F.array_except(new, old).alias("added"))


def problem(sections: Column, entities: Column) -> Column:
    """The first thing wrong with an outline's sections (h1, h2, chunks, h3, claims) and its
    entities, null if it can be drawn up: sections there are, headings aren't blank, arrays
    are arrays without nulls (h3, claims and entities may be missing)."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    holed = lambda a: F.coalesce(F.exists(a, lambda x: x.isNull()), F.lit(False))
    wrong = F.transform(sections, lambda s, i: F.when(s.isNull(), F.concat(F.lit("sections["), i.cast("string"), F.lit("]"))).when(blank(s["h1"]), F.concat(F.lit("sections["), i.cast("string"), F.lit("].h1"))).when(blank(s["h2"]), F.concat(F.lit("sections["), i.cast("string"), F.lit("].h2"))).when(s["chunks"].isNull() | holed(s["chunks"]), F.concat(F.lit("sections["), i.cast("string"), F.lit("].chunks"))).when(holed(s["h3"]), F.concat(F.lit("sections["), i.cast("string"), F.lit("].h3"))).when(holed(s["claims"]), F.concat(F.lit("sections["), i.cast("string"), F.lit("].claims"))))
    first = F.get(F.filter(wrong, lambda x: x.isNotNull()), F.lit(0))
    return F.when(F.coalesce(F.size(sections), F.lit(0)) <= 0, "sections").otherwise(F.coalesce(first, F.when(holed(entities), "entities")))
