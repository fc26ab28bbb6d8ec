"""Budgets, ledgers, signatures and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: token limits of the four passes and of a whole run
PASS_LIMITS = [2500, 3500, 4000, 2000]
TEXT, TEXT_CACHED, VISION, TOTAL, HEADROOM = 12000, 2000, 6000, 18000, 0.85


def check(usage: DataFrame) -> DataFrame:
    """(run_id, text, vision, total, reasons, warnings, passed) of usage (run_id, stage, kind,
    tokens, cached): kind is pass1 to pass4, text or vision. Warnings start at 85 %."""
    is_text = F.col("kind") != "vision"
    sums = [F.sum(F.when(F.col("kind") == f"pass{i + 1}", F.col("tokens")).otherwise(0)).alias(f"pass{i + 1}") for i in range(4)]
    one = usage.groupBy("run_id").agg(F.sum(F.when(is_text, F.col("tokens")).otherwise(0)).alias("text"), F.sum(F.when(is_text, 0).otherwise(F.col("tokens"))).alias("vision"), F.sum("tokens").alias("total"), F.bool_or("cached").alias("cached"), *sums)
    limits = [(f"pass{i + 1}", F.lit(n)) for i, n in enumerate(PASS_LIMITS)] + [("text", F.when(F.col("cached"), TEXT_CACHED).otherwise(TEXT)), ("vision", F.lit(VISION)), ("total", F.lit(TOTAL))]
    named = lambda test: F.filter(F.array(*[F.when(test(F.col(c), n), F.lit(c)) for c, n in limits]), lambda x: x.isNotNull())
    rows = one.withColumn("reasons", named(lambda c, n: c > n)).withColumn("warnings", named(lambda c, n: (c > n * HEADROOM) & (c <= n)))
    return rows.select("run_id", "text", "vision", "total", "reasons", "warnings", (F.size("reasons") == 0).alias("passed"))


def ledger(usage: DataFrame) -> DataFrame:
    """(run_id, by_stage MAP, total)."""
    s = usage.groupBy("run_id", "stage").agg(F.sum("tokens").alias("n"))
    return s.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "n")))).alias("by_stage"), F.sum("n").alias("total"))


def spent(used: DataFrame, estimated: DataFrame) -> DataFrame:
    """(run_id, stage, tokens, measured): a run's tokens as its model counted them, by stages with
    any; estimates (run_id, stage, tokens) for runs of which nothing was counted."""
    by = used.groupBy("run_id", "stage").agg(F.sum("tokens").alias("tokens")).where("tokens > 0").withColumn("measured", F.lit(True))
    rest = estimated.join(by.select("run_id").distinct(), "run_id", "left_anti").groupBy("run_id", "stage").agg(F.sum("tokens").alias("tokens"))
    return by.unionByName(rest.withColumn("measured", F.lit(False)))


def markers(runs: DataFrame, artefacts: DataFrame, schema: int = 1) -> DataFrame:
    """(paper_id, marker_schema, source_sha256, run_signature, artifact_signature, task) of
    finished ``runs`` (paper_id, source_sha256, run_signature, task): the signature is that of
    a paper's artefacts (paper_id, name, sha256) in the order of their names. Runs without
    artefacts get no marker."""
    one = F.concat_ws(":", "name", "sha256")
    signed = artefacts.groupBy("paper_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), "\n"), 256).alias("artifact_signature"))
    return runs.join(signed, "paper_id").select("paper_id", F.lit(schema).alias("marker_schema"), "source_sha256", "run_signature", "artifact_signature", "task")


def signature(*columns: str):
    """SHA-256 of the columns as JSON in alphabetical order; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def to_run(inputs: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs of which no run has the same keys and signatures."""
    return inputs.join(runs.select(*keys).distinct(), keys, "left_anti")


def outcomes(ledger_rows: DataFrame) -> DataFrame:
    n = lambda column, value: F.count_if(F.col(column) == value).alias(value)
    return ledger_rows.agg(*[n("state", v) for v in ("done", "failed", "skipped")], *[n("quality", v) for v in ("passed", "unverified")])


def versions(rows: DataFrame) -> DataFrame:
    """(key, version, parent, content_sha) of rows (key, ts, content) in order of time, where a
    content equal to the one before makes no new version."""
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("ts", "content_sha")
    hashed = rows.withColumn("content_sha", F.sha2(F.coalesce("content", F.lit("")), 256))
    new = hashed.withColumn("_before", F.lag("content_sha").over(w)).where(~F.col("content_sha").eqNullSafe(F.col("_before")))
    numbered = new.withColumn("version", F.row_number().over(w))
    return numbered.select("key", "version", F.nullif(F.col("version") - 1, F.lit(0)).alias("parent"), "content_sha")
