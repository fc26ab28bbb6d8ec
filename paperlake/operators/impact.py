"""Exact top-k over stored postings that are ordered and bounded, so few of them are read.

A score is the sum over common terms of the query's weight times the posting's impact (none
negative). Terms have one order, rare ones first. For a document that meets a query first at a
term, what this and all later terms can add is bounded in two ways: by the product of the
norms of what query and document have from there on, and by the impact here and the largest
impacts of the query's later terms. Postings of a term are stored in blocks that fall by one
of these, each with its largest values, so blocks and then postings under a query's threshold
are left out; nothing else is, so results are those of all postings.

A first look at few blocks and the exact scores of the best documents in them give the
threshold: the k-th best score found so far, which the k-th best of all can't be below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.operators.common import BROADCAST_ROWS, kept, micro, small, top

#: Postings in a block, and documents that share the blocks of a term, about: a frequent term's
#: postings are cut by a hash of the document, so no task orders all of them.
BLOCK, SHARD = 128, 1 << 16
#: Scores are ranked in millionths; bounds give way by more than their rounding.
SLACK = 2e-6


@dataclass
class Impacts:
    """``rows`` (key, term, df, x) and ``blocks`` (term, no, n, most_x, most_s, entries of key,
    x and s: the norm of the document's impacts from the term on) in the shared folder."""

    key: str
    rows: DataFrame
    blocks: DataFrame


def stored_impacts(rows: DataFrame, key: str, documents: int, by: str = "s", only: DataFrame | None = None) -> Impacts:
    """Of ``rows`` (key, term, df, x), blocks falling by s or x. ``only`` (term): the terms that
    will be asked for, if no others will; the others bound nothing then."""
    rows = rows.select(key, "term", "df", "x")
    if only is not None:
        rows = rows.join(small(only), "term", "left_semi")
    w = Window.partitionBy(key).orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    rows = kept(rows.withColumn("s", F.sqrt(F.sum(F.col("x") * F.col("x")).over(w))), "impacts")
    shards = max(1, -(-documents // SHARD))
    part = F.pmod(F.xxhash64(key), F.lit(shards))
    no = F.floor((F.row_number().over(Window.partitionBy("term", "_part").orderBy(F.desc(by), key)) - 1) / BLOCK)
    cut = rows.withColumn("_part", part).withColumn("no", no.cast("int"))
    blocks = cut.groupBy("term", "_part", "no").agg(F.count("*").alias("n"), F.max("x").alias("most_x"), F.max("s").alias("most_s"), F.collect_list(F.struct(key, "x", "s")).alias("entries"))
    return Impacts(key, rows, kept(blocks.drop("_part"), "blocks"))


@dataclass
class Asked:
    """``rows`` (query, term, df, qw, norm: of this and later weights, norm_after, rest: what
    later terms can add at most) of terms that some document has, in the shared folder, and how
    many rows and queries there are."""

    query: str
    rows: DataFrame
    n: int
    queries: int

    def near(self, df: DataFrame, each: int | None = None) -> DataFrame:
        """``df``, of as many rows as there are here or of ``each`` for a query at most, with a
        broadcast hint if these are few."""
        return F.broadcast(df) if (self.n if each is None else each * self.queries) <= BROADCAST_ROWS else df


def weighed(asked: DataFrame, at: Impacts, query: str) -> Asked:
    """Of query terms (query, term, qw)."""
    most = at.rows.groupBy("term").agg(F.first("df").alias("df"), F.max("x").alias("most"))
    w = Window.partitionBy(query).orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, -1)
    rows = asked.select(query, "term", "qw").join(most, "term")
    sums = [F.coalesce(F.sum(x).over(w), F.lit(0.0)).alias(n) for x, n in ((F.col("qw") * F.col("qw"), "_after"), (F.col("qw") * F.col("most"), "rest"))]
    rows = rows.select(query, "term", "df", "qw", *sums).select(query, "term", "df", "qw", F.sqrt(F.col("_after") + F.col("qw") * F.col("qw")).alias("norm"), F.sqrt("_after").alias("norm_after"), "rest")
    rows = kept(rows, "asked")
    size = rows.agg(F.count("*").alias("n"), F.count_distinct(query).alias("queries")).first()
    return Asked(query, rows, size["n"], size["queries"])


def _exact(pairs: DataFrame, at: Impacts, asked: Asked) -> DataFrame:
    """(query, key, score) of ``pairs`` (query, key) from all their common terms."""
    hits = at.rows.select(at.key, "term", "x").join(pairs, at.key).join(asked.near(asked.rows.select(asked.query, "term", "qw")), [asked.query, "term"])
    return hits.groupBy(asked.query, at.key).agg(F.sum(F.col("qw") * F.col("x")).alias("score"))


def thresholds(at: Impacts, asked: Asked, k: int, looks: int = 64) -> DataFrame:
    """(query, least) in the shared folder, for queries that meet ``k`` documents or more in
    their first ``looks`` blocks (and 8 for each of ``k``), rare terms first: the k-th best
    exact score among the best of them."""
    query, wide = asked.query, looks + 8 * k
    heads = at.blocks.select("term", "no", "most_x", "most_s").join(asked.near(asked.rows), "term")
    order = [F.asc("df"), F.asc("term"), F.asc("no"), F.desc("most_s"), F.desc("most_x")]
    first = top(heads, [query], order, wide).select(query, "term", "no", "qw").distinct()
    seen = at.blocks.join(asked.near(first, wide), ["term", "no"]).select(query, "qw", F.explode("entries").alias("e"))
    partial = seen.groupBy(query, F.col(f"e.{at.key}").alias(at.key)).agg(F.sum(F.col("qw") * F.col("e.x")).alias("p"))
    best = top(partial, [query], [F.desc("p"), F.asc(at.key)], 4 * k).select(query, at.key)
    found = top(_exact(asked.near(best, 4 * k), at, asked), [query], [F.desc("score"), F.asc(at.key)], k)
    return kept(found.where(F.col("rank") == k).select(query, (F.col("score") - SLACK).alias("least")), "least")


def read_postings(at: Impacts, asked: Asked, least: DataFrame, share: float = 0.7) -> DataFrame:
    """The postings that can matter: (query, key, term, qw, x, s, bound, least, ...) down to
    ``share`` of each query's threshold; queries without one take all."""
    query = asked.query
    near = asked.rows.join(asked.near(least, 1), query, "left").withColumn("least", F.coalesce("least", F.lit(-1.0)))
    bound = lambda s, x: F.least(F.col("norm") * s, F.col("qw") * x + F.col("rest"))
    rows = at.blocks.join(asked.near(near), "term").where(bound(F.col("most_s"), F.col("most_x")) >= share * F.col("least"))
    rows = rows.select(query, "term", "qw", "norm", "norm_after", "rest", "least", F.explode("entries").alias("e")).select("*", f"e.{at.key}", "e.x", "e.s").drop("e")
    return rows.withColumn("bound", bound(F.col("s"), F.col("x"))).where(F.col("bound") >= share * F.col("least"))


def candidates(at: Impacts, asked: Asked, k: int, share: float = 0.7) -> DataFrame:
    """(query, key) that may be among the ``k`` best: what a document gets from postings that
    were read, and can get after the last of them, reaches the threshold."""
    read = read_postings(at, asked, thresholds(at, asked, k), share)
    left = F.least(F.col("norm_after") * F.sqrt(F.greatest(F.lit(0.0), F.col("s") * F.col("s") - F.col("x") * F.col("x"))), F.col("rest"))
    g = read.groupBy(asked.query, at.key).agg(F.sum(F.col("qw") * F.col("x")).alias("p"), F.min(left).alias("left"), F.max("bound").alias("bound"), F.first("least").alias("least"))
    # postings that weren't read add less than the share
    more = F.when(F.col("least") > 0, F.least("left", share * F.col("least"))).otherwise(F.col("left"))
    return g.where((F.col("bound") >= F.col("least")) & (F.col("p") + more + SLACK >= F.col("least"))).select(asked.query, at.key)


def topk(at: Impacts, asked: DataFrame, k: int, query: str, share: float = 0.7) -> DataFrame:
    """(query, rank, key, score_micro) of the ``k`` best documents of each query; ``asked``:
    (query, term, qw). Documents without a common term are not listed."""
    a = weighed(asked, at, query)
    scored = _exact(small(kept(candidates(at, a, k, share), "may")), at, a).select(query, at.key, micro(F.col("score")).alias("score_micro"))
    return top(scored, [query], [F.desc("score_micro"), F.asc(at.key)], k).select(query, "rank", at.key, "score_micro")
