"""Evaluation: retrieval metrics, AUC, threshold calibration, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.functions.text import text_score
from paperlake.operators import ordered
from paperlake.operators.common import micro


def retrieval_metrics(ranked: DataFrame, positives: DataFrame, k: int, query: str = "query_id", key: str = "key", n: DataFrame | None = None) -> DataFrame:
    """(query, recall, mrr, ndcg) of ranked (query, rank, key) against positives (query, key).
    Queries are those of ``positives`` and of ``ranked``; without positives recall and ndcg
    are 1. ``n`` (query, n): how many different positives each query has, where this is known
    without making them; then ``positives`` may hold those of the ranked lists alone."""
    pos = positives.select(query, key).distinct()
    n = pos.groupBy(query).agg(F.count("*").alias("n")) if n is None else n.where("n > 0").select(query, "n")
    hits = ranked.join(pos, [query, key]).groupBy(query).agg(F.count_if(F.col("rank") <= k).alias("h"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    rows = ranked.select(query).union(n.select(query)).distinct().join(n, query, "left").join(hits, query, "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    none = F.col("n").isNull()
    return rows.select(query, F.when(none, 1.0).otherwise(F.coalesce("h", F.lit(0)) / F.col("n")).alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(none, 1.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def _by_score(scored: DataFrame, score: str, label: str) -> DataFrame:
    """(value, p, q, and their running sums and totals): positives and negatives of each score."""
    one = F.col(label).cast("long")
    return ordered.running(scored.where(F.col(label).isNotNull()), score, {"p": F.sum(one), "q": F.sum(1 - one)})


def roc_auc(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """One row (positives, negatives, auc): the Mann-Whitney statistic, ties a half. Scores are
    scanned in ranges."""
    by = _by_score(scored, score, label)
    rows = by.select("p", "q", (F.col("p") * (F.col("to_q") - F.col("q") / 2.0)).alias("u"))
    return rows.agg(F.sum("p").alias("positives"), F.sum("q").alias("negatives"), F.sum("u").alias("u")).select("positives", "negatives", F.try_divide("u", F.col("positives") * F.col("negatives")).alias("auc"))


def thresholds(scored: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, recall, fpr) for every score seen, and 1.0: at or above counts as positive."""
    rows = scored.select(F.col(score).cast("double").alias("s"), F.col(label).cast("long").alias("l"))
    one = rows.sparkSession.range(1).select(F.lit(1.0).alias("s"), F.lit(None).cast("long").alias("l"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    by = ordered.running(rows.unionByName(one), "s", {"p": zero(F.sum("l")), "q": zero(F.sum(1 - F.col("l")))})
    above = lambda c: F.try_divide(F.col(f"all_{c}") - F.col(f"to_{c}") + F.col(c), F.col(f"all_{c}"))
    return by.select(F.col("value").alias("threshold"), above("p").alias("recall"), above("q").alias("fpr"))


def calibrate(scored: DataFrame, max_fpr: float = 0.05, least: int = 50, each: int = 20, min_recall: float = 0.8, min_auc: float = 0.8, score: str = "score", label: str = "label") -> DataFrame:
    """One row: the threshold of the highest recall (then lowest FPR, then lowest threshold)
    with an FPR of ``max_fpr`` at most, the 95th percentile of negatives under it as the review
    line, and whether sample, recall and AUC suffice."""
    best = thresholds(scored, score, label).where(F.col("fpr") <= max_fpr).agg(F.max_by(F.struct("threshold", "recall", "fpr"), F.struct("recall", -F.col("fpr"), -F.col("threshold"))).alias("b"))
    p95 = nearest_rank(scored.where(F.col(label) == 0), score, 0.95).agg(F.max("p95").alias("neg_p95"))
    row = roc_auc(scored, score, label).crossJoin(best).crossJoin(p95)
    enough = (F.col("positives") + F.col("negatives") >= least) & (F.col("positives") >= each) & (F.col("negatives") >= each)
    good = enough & (F.col("b.recall") >= min_recall) & (F.col("b.fpr") <= max_fpr) & (F.col("auc") >= min_auc)
    return row.select("positives", "negatives", "auc", F.col("b.threshold").alias("pass_th"), F.least("neg_p95", F.col("b.threshold")).alias("review_th"), F.col("b.recall").alias("recall"), F.col("b.fpr").alias("fpr"), F.coalesce(good, F.lit(False)).alias("calibrated"))


def nearest_rank(df: DataFrame, value: str, p: float, group: list[str] | None = None) -> DataFrame:
    """The value at place round((n - 1) * p), halves to even."""
    found = ordered.at_rank(df, value, lambda n: F.bround((n - 1) * F.lit(float(p)), 0).cast("long"), group)
    return found.withColumnRenamed("value", f"p{round(p * 100)}")


def upper_rank(df: DataFrame, value: str, p: float, group: list[str] | None = None) -> DataFrame:
    """The least value that a share of ``p`` of all is not above: place ceil(p * n) - 1."""
    found = ordered.at_rank(df, value, lambda n: F.greatest(F.ceil(n * F.lit(float(p))).cast("long") - 1, F.lit(0)), group)
    return found.withColumnRenamed("value", f"p{round(p * 100)}")


def cell_scores(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(table_id, score) of cells (table_id, row, col, value): the share of coordinates in
    either table with equal values, so invented cells and tables count against it."""
    norm = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    g = gold.select("table_id", "row", "col", norm(F.col("value")).alias("g"))
    f = found.select("table_id", "row", "col", norm(F.col("value")).alias("f"))
    return g.join(f, ["table_id", "row", "col"], "full").groupBy("table_id").agg(F.avg(F.coalesce(F.col("g") == F.col("f"), F.lit(False)).cast("double")).alias("score"))


def text_gate(gold: DataFrame, found: DataFrame, least: float = 0.98) -> DataFrame:
    """One row: documents, missing ones (they score 0), mean text score and whether it passes;
    the gate uses the unrounded mean."""
    rows = gold.select("id", F.col("text").alias("g")).join(found.select("id", F.col("text").alias("f")), "id", "left")
    return rows.agg(F.count("*").alias("documents"), F.count_if(F.col("f").isNull()).alias("missing"), F.avg(F.coalesce(text_score(F.col("g"), F.col("f")), F.lit(0.0))).alias("score")).withColumn("passed", (F.col("missing") == 0) & (F.col("score") >= least))


def alias_gate(gold: DataFrame, found: DataFrame, generic: list[str], types: list[str], least: float = 0.97, most_generic: float = 0.01, cases: int = 50) -> DataFrame:
    """One row for gold (mention, canonical, type) and found (mention, canonical, type)."""
    rows = gold.select("mention", F.col("canonical").alias("g"), F.col("type").alias("gt")).join(found.select("mention", F.col("canonical").alias("f"), F.col("type").alias("ft")), "mention", "left")
    one = rows.agg(F.count("*").alias("cases"), F.avg(F.coalesce((F.col("g") == F.col("f")) & (F.col("gt") == F.col("ft")), F.lit(False)).cast("double")).alias("accuracy"), F.avg(F.coalesce(F.lower("f").isin(generic), F.lit(False)).cast("double")).alias("generic_rate"), F.count_if(F.col("ft").isNotNull() & ~F.col("ft").isin(types)).alias("outside"))
    return one.withColumn("passed", (F.col("cases") >= cases) & (F.col("accuracy") >= least) & (F.col("generic_rate") < most_generic) & (F.col("outside") == 0))


def flag_gate(gold: DataFrame, found: DataFrame, least_recall: float = 0.9, most_fpr: float = 0.1, positives: int = 20, negatives: int = 10) -> DataFrame:
    """One row for gold (id, expected) and found (id, flagged); a missing answer is a miss for
    positives and an alarm for negatives."""
    rows = gold.join(found.select("id", "flagged"), "id", "left")
    hit = F.coalesce("flagged", ~F.col("expected"))
    one = rows.agg(F.count_if("expected").alias("positives"), F.count_if(~F.col("expected")).alias("negatives"), F.count_if(F.col("expected") & hit).alias("tp"), F.count_if(~F.col("expected") & hit).alias("fp"))
    one = one.select("positives", "negatives", F.try_divide("tp", "positives").alias("recall"), F.try_divide("fp", "negatives").alias("fpr"))
    return one.withColumn("passed", F.coalesce((F.col("positives") >= positives) & (F.col("negatives") >= negatives) & (F.col("recall") >= least_recall) & (F.col("fpr") <= most_fpr), F.lit(False)))


def review_gate(scores: DataFrame, least: float = 4.0, spread: int = 2) -> DataFrame:
    """(case_id, mean, disagreement, passed) of human scores (case_id, reviewer_id, dimension,
    score)."""
    by = scores.groupBy("case_id", "dimension").agg(F.avg("score").alias("m"), (F.max("score") - F.min("score")).alias("d"), F.countDistinct("reviewer_id").alias("r"))
    rows = by.groupBy("case_id").agg(F.avg("m").alias("mean"), F.max("d").alias("disagreement"), F.min("r").alias("r"))
    return rows.select("case_id", micro(F.col("mean")).alias("mean_micro"), "disagreement", ((F.col("mean") >= least) & (F.col("disagreement") <= spread) & (F.col("r") >= 2)).alias("passed"))
