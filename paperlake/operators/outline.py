"""Outlines, drafts, digests and the gates over finished artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions import reading
from paperlake.functions.text import blank

# fixed values: the section names of an outline, in its order
BUCKETS = ["abstract", "intro", "method", "experiments", "conclusion"]


def subheadings(text: Column, most: int = 4) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\s*(?:#{2,4}\s+|\d+\.\d+\s+)(\S[^\n]{2,80})$"), F.lit(1))
    return F.slice(F.array_distinct(F.transform(found, F.trim)), 1, most)


def outline(parts: DataFrame, chunks: DataFrame, key: str = "paper_id") -> DataFrame:
    """(key, ord, h1, h3, chunks, status) a section name; downgraded papers have one section
    that needs review."""
    place = F.array_position(F.lit(BUCKETS), F.col("name"))
    ids = chunks.groupBy(key, "sec").agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))
    rows = parts.join(ids, [key, "sec"], "left").withColumn("h1", F.when(F.col("downgrade"), F.lit("full")).when(place > 0, F.col("name")).otherwise(F.lit("other")))
    g = rows.groupBy(key, "h1").agg(F.min(F.when(place > 0, place).otherwise(F.lit(99))).alias("ord"), F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("o"), subheadings(F.col("text")).alias("h")))), lambda s: s["h"]))).alias("h3"), F.array_sort(F.flatten(F.collect_list(F.coalesce("ids", F.array().cast("array<string>"))))).alias("chunks"), F.bool_or("downgrade").alias("down"))
    return g.select(key, "ord", "h1", F.slice("h3", 1, 4).alias("h3"), "chunks", F.when(F.col("down"), "NEEDS_REVIEW").otherwise("PLANNED").alias("status"))


def drafts(outlines: DataFrame, chunks: DataFrame, key: str = "paper_id", most: int = 220) -> DataFrame:
    """(key, ord, text): each section's first chunk, quoted up to ``most`` characters and cited."""
    first = outlines.select(key, "ord", "h1", F.get("chunks", F.lit(0)).alias("chunk_id")).join(chunks.select(key, "chunk_id", "sec", F.col("text").alias("t")), [key, "chunk_id"])
    return first.select(key, "ord", F.concat(F.lit("## "), F.col("h1"), F.lit("\n"), F.left(F.regexp_replace("t", r"\s+", " "), F.lit(most)), F.lit(" [Ref: "), F.col(key).cast("string"), F.lit(", Sec "), F.col("sec"), F.lit("]")).alias("text"))


def citation_chain(chunks: DataFrame, key: str = "paper_id", most: int = 2400) -> DataFrame:
    """(key, chain): a paper's chunks with their ids, 220 characters of each with a text, reduced
    evenly to ``most``."""
    body = F.trim(F.regexp_replace(blank(F.col("text")), r"\s+", " "))
    line = F.concat(F.lit("[Source: "), F.trim("chunk_id"), F.lit("] "), F.left(body, F.lit(220)))
    rows = chunks.select(key, "chunk_id", line.alias("line"), (body != "").alias("has"))
    lines = F.transform(F.array_sort(F.collect_list(F.when(F.col("has") & (F.trim("chunk_id") != ""), F.struct("chunk_id", "line")))), lambda s: s["line"])
    return rows.groupBy(key).agg(lines.alias("lines")).select(key, reading.even_reduced(F.col("lines"), most).alias("chain"))


def digest(docs: DataFrame, key: str, text: str = "text", most: int = 1200, must_have: Column | None = None) -> DataFrame:
    """(key, digest), a row for each of ``docs``: see ``reading.digested``."""
    return docs.select(key, reading.digested(F.col(text), most, must_have).alias("digest"))


def artefact_status(statuses: DataFrame, wanted: list[str], key: str = "paper_id") -> DataFrame:
    """(key, status) over artefacts (key, artefact, status): clean only if every wanted one is
    there and clean."""
    g = statuses.groupBy(key).agg(F.bool_or(F.col("status") == "DIRTY").alias("bad"), F.size(F.collect_set(F.when((F.col("status") == "CLEAN") & F.col("artefact").isin(wanted), F.col("artefact")))).alias("good"), F.bool_and(F.col("status") == "CLEAN").alias("clean"))
    return g.select(key, F.when(F.col("bad"), "DIRTY").when(F.col("clean") & (F.col("good") == len(set(wanted))), "CLEAN").otherwise("NEEDS_REVIEW").alias("status"))


def enforced(status: Column, calibrated: Column) -> Column:
    """Without a calibrated scorer nothing is clean."""
    return F.when((status == "CLEAN") & ~F.coalesce(calibrated, F.lit(False)), F.lit("NEEDS_REVIEW")).otherwise(status)


def release(gates: DataFrame, wanted: list[str]) -> DataFrame:
    """One row (passed, missing, failed) of gates (gate, passed): missing evidence fails."""
    g = gates.agg(F.array_sort(F.collect_set("gate")).alias("seen"), F.array_sort(F.collect_set(F.when(~F.coalesce("passed", F.lit(False)), F.col("gate")))).alias("failed"))
    missing = F.array_except(F.lit(sorted(wanted)), F.col("seen"))
    return g.select((F.size(missing) + F.size("failed") == 0).alias("passed"), missing.alias("missing"), "failed")
