"""The end of a run: ordered steps, each by itself, and what became of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.operators.common import kept

Step = Callable[[dict[str, DataFrame]], DataFrame]


def finalized(spark: SparkSession, steps: list[tuple[str, Step]], given: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables by step, outcomes (no, step, rows, error)). Each step gets the tables of the
    steps before it, by name, beside those ``given``; its table is stored before the next one
    begins. One that fails leaves its error (120 characters) and no table, and the others go
    on; a step that needs its table fails too, by name."""
    done, log = dict(given or {}), []
    for no, (name, step) in enumerate(steps, 1):
        try:
            done[name] = kept(step(done), name)
            log.append((no, name, done[name].count(), None))
        except Exception as e:  # steps stand for themselves, as a half-finished run is worth keeping
            log.append((no, name, None, (f"needs {e}" if isinstance(e, KeyError) else str(e))[:120]))
    return done, spark.createDataFrame(log, "no int, step string, rows long, error string")


def field_due(notes: DataFrame, at: int, papers: int = 3, paper: str = "paper_id") -> DataFrame:
    """One row (papers, due): whether ``papers`` more papers have notes than the ``at`` of the last
    reflection on the field; its own notes don't count."""
    n = notes.where(F.col(paper) != "__field__").agg(F.count_distinct(paper).alias("papers"))
    return n.select("papers", (F.col("papers") >= F.greatest(F.lit(papers), F.lit(at + papers))).alias("due"))
