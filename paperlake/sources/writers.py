"""Sinks: per-paper artefacts, snapshots, ledgers, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: how much of a text an artefact keeps
KEPT = {"section": 3000, "chunk": 1500, "pass": 2000, "truth": 1500, "snapshot": 2000}


def snapshot(df: DataFrame, path: str, key: str = "paper_id") -> None:
    """Replaces the partitions of the papers in ``df`` and leaves others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def artefacts(df: DataFrame, path: str, kind: str, text: str = "text", key: str = "paper_id") -> None:
    df.withColumn(text, F.left(text, F.lit(KEPT[kind]))).write.mode("overwrite").partitionBy(key).json(path)


def ledger_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A ledger with the named columns alone, so nothing private is written with them."""
    df.select(*columns).write.mode("overwrite").option("header", "true").csv(path)


def markdown_table(rows: Column) -> Column:
    """An array of arrays of cells as a Markdown table, short rows filled up."""
    width = F.aggregate(F.transform(rows, F.size), F.lit(0), lambda a, n: F.greatest(a, n))
    filled = F.transform(rows, lambda r: F.concat(F.transform(r, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\||\n", " ")), F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = line(F.array_repeat(F.lit("---"), width.cast("int")))
    return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.concat(F.array(line(F.get(filled, F.lit(0))), rule), F.transform(F.slice(filled, 2, 1 << 30), line)), "\n"))


def outline_markdown(sections: Column) -> Column:
    """An array of structs (h1, h2, h3 ARRAY) as headings."""
    return F.array_join(F.transform(sections, lambda s: F.concat_ws("\n", F.concat(F.lit("# "), s["h1"]), F.concat(F.lit("## "), s["h2"]), F.array_join(F.transform(s["h3"], lambda h: F.concat(F.lit("### "), h)), "\n"))), "\n\n")
