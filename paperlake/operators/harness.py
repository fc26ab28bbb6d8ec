"""The retrieval harness: cases, positives, rank variants; captions; records of gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.operators import evaluate
from paperlake.operators.ask import expand_each
from paperlake.operators.common import top
from paperlake.operators.memory import retrievable


def sampled(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in an order that key and seed decide (not that of any other generator)."""
    order = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    return rows.orderBy(order, key).limit(n)


def questions(rows: DataFrame, langs: list[str] | None = None, n: int = 0) -> DataFrame:
    """Rows (note_id, q, pos, lang) that have a question and positives, of ``langs`` if given,
    the first ``n`` by id if not 0."""
    rows = rows.where(F.coalesce(F.col("q") != "", F.lit(False)) & (F.size("pos") > 0))
    rows = rows.where(F.col("lang").isin(langs)) if langs else rows
    return rows.orderBy("note_id").limit(n) if n else rows


def positives(notes: DataFrame, note_links: DataFrame) -> DataFrame:
    """(id, pos): a note itself, what its links and its typed links either way lead to but for
    contradictions; only notes that can be found and are no entities, on both sides."""
    valid = notes.where(retrievable() & (F.col("kind") != "entity")).select("id")
    typed = note_links.where("rel <> 'contradicts'")
    rows = notes.select("id", F.col("id").alias("pos")).unionByName(notes.select("id", F.explode("links").alias("pos"))).unionByName(typed.select(F.col("src").alias("id"), F.col("dst").alias("pos"))).unionByName(typed.select(F.col("dst").alias("id"), F.col("src").alias("pos")))
    return rows.distinct().join(valid, "id", "left_semi").join(valid.select(F.col("id").alias("pos")), "pos", "left_semi").select("id", "pos")


def compared(ranked: DataFrame, positives_: DataFrame, k: int = 5, query: str = "query", key: str = "id", n: DataFrame | None = None) -> DataFrame:
    """(variant, cases, recall, mrr, ndcg): means, four digits, over the queries that have
    positives, of ranked lists (variant, query, rank, key). A query that a variant finds
    nothing for counts as 0. ``n`` (query, n) as in ``retrieval_metrics``."""
    n = positives_.select(query, key).distinct().groupBy(query).agg(F.count("*").alias("n")) if n is None else n.where("n > 0")
    wide = n.crossJoin(F.broadcast(ranked.select("variant").distinct())).select(F.struct("variant", query).alias("c"), "n")
    lists = ranked.select(F.struct("variant", query).alias("c"), "rank", key)
    # positives meet the lists alone; of the others only the number counts
    pos = ranked.select("variant", query, key).join(positives_.select(query, key), [query, key]).select(F.struct("variant", query).alias("c"), key)
    m = evaluate.retrieval_metrics(lists.join(wide, "c", "left_semi"), pos, k, "c", key, wide)
    mean = lambda c: F.round(F.avg(F.round(c, 9)), 4).alias(c)
    return m.groupBy(F.col("c.variant").alias("variant")).agg(F.count("*").alias("cases"), mean("recall"), mean("mrr"), mean("ndcg"))


def with_graph(hits: DataFrame, edge: DataFrame, query: str = "query", key: str = "id", extra: int = 8) -> DataFrame:
    """(query, rank, key): ranked ``hits`` (query, rank, key, score_micro), and behind them the
    ``extra`` nodes that two steps over ``edge`` from all of them reach with most weight."""
    seeds = hits.select(query, F.col(key).alias("node"), F.when(F.col("score_micro") == 0, 0.1).otherwise(F.col("score_micro") / 1e6).alias("seed"))
    found = expand_each(edge, seeds, query).join(seeds.select(query, "node"), [query, "node"], "left_anti")
    found = top(found.withColumn("x", F.floor(F.col("score") * 1e9 + 0.5)), [query], [F.desc("x"), F.asc("node")], extra, "k")
    n = hits.groupBy(query).agg(F.count("*").alias("n"))
    more = found.join(n, query).select(query, (F.col("n") + F.col("k")).cast("int").alias("rank"), F.col("node").alias(key))
    return hits.select(query, "rank", key).unionByName(more)


def same_context(a: Column, b: Column, least: int = 20) -> Column:
    """Equal but for case and white space, or the shorter has ``least`` characters and stands
    in the longer."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    x, y = plain(a), plain(b)
    short, long = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return (x == y) | ((F.length(short) >= least) & F.contains(long, short))


def caption_scores(golden: DataFrame, found: DataFrame) -> DataFrame:
    """(paper_id, matched, total, score): golden captions (paper_id, item, context) whose found
    one has the same context, over all items of either side, so that invented ones count
    against; a repeated item counts by its best. Papers of neither side have no row."""
    # equal contexts of an item count once, so they meet before the join
    g = golden.select("paper_id", "item", F.col("context").alias("_g")).distinct()
    f = found.select("paper_id", "item", F.col("context").alias("_f")).distinct()
    rows = g.join(f, ["paper_id", "item"], "full")
    good = F.col("_g").isNotNull() & F.col("_f").isNotNull() & same_context(F.col("_g"), F.col("_f"))
    by = rows.groupBy("paper_id", "item").agg(F.bool_or(F.coalesce(good, F.lit(False))).alias("ok"))
    n = by.groupBy("paper_id").agg(F.count_if("ok").alias("matched"), F.count("*").alias("total"))
    return n.withColumn("score", F.col("matched") / F.col("total"))


def case_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON in alphabetical order; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def recorded(rows: DataFrame, min_rows: int = 50, each: int = 20) -> DataFrame:
    """Adds problems and valid to calibration records (positives, negatives, pass_th, review_th,
    recall, fpr, auc, calibrated): what is missing, out of 0 to 1, or short of its gate."""
    unit = lambda c: F.col(c).isNull() | (F.col(c) < 0) | (F.col(c) > 1)
    short = F.coalesce((F.col("positives") + F.col("negatives") < min_rows) | (F.col("positives") < each) | (F.col("negatives") < each), F.lit(True))
    tests = [*[(c, unit(c)) for c in ("pass_th", "review_th", "recall", "fpr", "auc")], ("sample", short), ("order", F.col("review_th") > F.col("pass_th")), ("fpr_gate", F.col("fpr") > 0.05), ("recall_gate", F.col("recall") < 0.8), ("auc_gate", F.col("auc") < 0.8), ("calibrated", ~F.coalesce("calibrated", F.lit(False)))]
    problems = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests]), lambda x: x.isNotNull())
    return rows.withColumn("problems", problems).withColumn("valid", F.size("problems") == 0)


def overlap(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1); 0 where none has an area."""
    side = lambda i: F.greatest(F.lit(0.0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    area = lambda r: F.greatest(F.lit(0.0), r[2] - r[0]) * F.greatest(F.lit(0.0), r[3] - r[1])
    both = side(0) * side(1)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))
