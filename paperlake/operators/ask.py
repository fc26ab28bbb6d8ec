"""Questions to the memory: query variants, fusion, graph extras, rerank, diversity, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions.text import mentions
from paperlake.operators import ranking
from paperlake.operators.common import kept, small, top
from paperlake.operators.memory import retrievable, trusted


def reordered(candidates: DataFrame, listed: DataFrame, query: str = "query", key: str = "id") -> DataFrame:
    """(query, key, position from 0): what a model ``listed`` (query, key, place) first, in its
    order; then the other candidates (query, key, position) in theirs. Unknown ids go."""
    first = listed.groupBy(query, key).agg(F.min("place").alias("_p"))
    w = Window.partitionBy(query).orderBy(F.col("_p").asc_nulls_last(), "position", key)
    return candidates.join(first, [query, key], "left").withColumn("position", F.row_number().over(w) - 1).drop("_p")


def expand_each(edge: DataFrame, seeds: DataFrame, query: str = "query", steps: int = 2, damping: float = 0.85) -> DataFrame:
    """(query, node, score): ``graph.expand`` for every query at once; seeds (query, node, seed)
    keep the scores they have. Each step is a join and a grouped sum by query and node."""
    deg = edge.groupBy("src").agg(F.count("*").alias("deg"))
    share = kept(edge.groupBy("src", "dst").agg(F.count("*").alias("m")).join(deg, "src").select("src", "dst", (F.col("m") / F.col("deg")).alias("share")), "shares")
    score = seeds.select(query, "node", F.col("seed").alias("score"))
    for _ in range(steps):
        moved = score.join(share, F.col("node") == F.col("src")).select(query, F.col("dst").alias("node"), (damping * 0.5 * F.col("score") * F.col("share")).alias("score"))
        stays = score.select(query, "node", (damping * 0.5 * F.col("score")).alias("score"))
        back = seeds.select(query, "node", ((1 - damping) * F.col("seed")).alias("score"))
        score = moved.unionByName(stays).unionByName(back).groupBy(query, "node").agg(F.sum("score").alias("score"))
    return score


def neighbours(picked: DataFrame, notes: DataFrame, query: str = "query", most: int = 30) -> DataFrame:
    """(query, id, rank): what the ``links`` of picked notes (query, id) lead to and is not
    picked itself, of notes that can be found and are no entities; the first by id."""
    links = picked.join(notes.select("id", "links"), "id").select(query, F.explode("links").alias("id")).distinct()
    rows = links.join(picked.select(query, "id"), [query, "id"], "left_anti")
    rows = rows.join(notes.where(retrievable() & (F.col("kind") != "entity")).select("id"), "id", "left_semi")
    return top(rows, [query], [F.asc("id")], most).select(query, "id", "rank")


def recall(hits: DataFrame, notes: DataFrame, query: str = "query", k: int = 5, most: int = 30) -> DataFrame:
    """(query, role, rank, id): the ``k`` first hits (query, rank, id) as seeds, and their
    ``neighbours``."""
    seeds = hits.where(F.col("rank") <= k).select(query, F.lit("seed").alias("role"), "rank", "id")
    near = neighbours(seeds, notes, query, most).select(query, F.lit("neighbour").alias("role"), "rank", "id")
    return seeds.unionByName(near)


def ask(hits: DataFrame, notes: DataFrame, edge: DataFrame, query: str = "query", k: int = 6, listed: DataFrame | None = None) -> DataFrame:
    """(query, rank, id, via): the notes an answer rests on. ``hits``: (query, variant, rank, id,
    score), the 12 first of each of at most four wordings of a question. Trusted hits are
    fused; the 12 best without entities get up to six notes that the graph reaches with over
    .02; then a model's order (``listed``), diversity and the neighbours of what was picked."""
    good = hits.where((F.col("rank") <= 12) & (F.col("variant") < 4)).join(notes.where(trusted()).select("id", "kind"), "id")
    # ranks without what can't be trusted
    own = Window.partitionBy(query, "variant").orderBy("rank", "id")
    lists = good.withColumn("rank", F.row_number().over(own)).withColumn("weight", F.lit(1.0))
    fused = ranking.rrf(lists, query, "id").withColumn("rrf", F.floor(F.col("rrf") * 1e9 + 0.5))
    best = top(fused, [query], [F.desc("rrf"), F.asc("id")], 12).join(notes.select("id", "kind"), "id").where("kind <> 'entity'")
    scores = good.groupBy(query, "id").agg(F.max_by("score", "variant").alias("score"))
    best = kept(best.join(scores, [query, "id"]).select(query, "id", "rank", F.when(F.coalesce("score", F.lit(0.0)) == 0, 0.1).otherwise(F.col("score")).alias("score")), "best")
    reached = expand_each(edge, best.select(query, F.col("id").alias("node"), F.col("score").alias("seed")), query)
    extra = reached.withColumnRenamed("node", "id").where("score > 0.02").join(best.select(query, "id"), [query, "id"], "left_anti").withColumn("micro", F.floor(F.col("score") * 1e9 + 0.5))
    extra = top(extra, [query], [F.desc("micro"), F.asc("id")], 6).join(notes.where(retrievable() & (F.col("kind") != "entity")).select("id"), "id", "left_semi")
    rows = best.select(query, "id", F.lit("search").alias("via"), "rank").unionByName(extra.select(query, "id", F.lit("graph").alias("via"), (F.col("rank") + 100).alias("rank")))
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy(query).orderBy("rank", "id")) - 1).drop("rank")
    if listed is not None:
        rows = reordered(rows, listed, query)
    rows = kept(rows.join(notes.select("id", "keywords"), "id").select(query, "id", "via", "position", "keywords"), "pool")
    picked = kept(ranking.mmr(rows, query, "id", k), "picked")
    near = neighbours(picked, notes, query, 20)
    every = picked.select(query, "id", F.col("rank")).unionByName(near.select(query, "id", (F.col("rank") + 1000).alias("rank")))
    every = every.join(notes.where((F.col("kind") != "entity") & (F.col("status") == "active")).select("id"), "id", "left_semi").join(rows.select(query, "id", "via"), [query, "id"], "left")
    return top(every.withColumnRenamed("rank", "place"), [query], [F.asc("place")], k + 5).select(query, "rank", "id", F.coalesce("via", F.lit("link")).alias("via"))


def offline_digest(found: DataFrame, notes: DataFrame, query: str = "query", k: int = 6) -> DataFrame:
    """(query, n, digest): the first ``k`` notes as lines, for answers without a model."""
    line = F.concat(F.lit("- ["), F.col("id").cast("string"), F.lit("]（"), F.col("paper_id").cast("string"), F.lit(" · "), F.col("kind"), F.lit("）"), F.left("content", F.lit(140)))
    rows = found.join(notes.select("id", "paper_id", "kind", "content"), "id")
    g = rows.groupBy(query).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", line.alias("line"))))), lambda s: s["line"]).alias("lines"))
    return g.select(query, "n", F.array_join("lines", "\n").alias("digest"))


def known_terms(concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(term): concepts (concept), aliases and canonical names (alias, canonical), lower-cased."""
    names = concepts.select(F.lower("concept").alias("term")).unionByName(aliases.select(F.explode(F.array(F.lower("alias"), F.lower("canonical"))).alias("term")))
    return names.where("term is not null").distinct()


def query_bumps(queries: DataFrame, known: DataFrame, query: str = "query", text: str = "text") -> DataFrame:
    """(query, term): the known terms of two characters or more that a question mentions by
    themselves. Terms are broadcast if they are few; a question is short."""
    terms = small(kept(known.where(F.length("term") >= 2), "terms"))
    return queries.join(terms, mentions(F.coalesce(F.col(text), F.lit("")), F.col("term"))).select(query, "term")


def added_alias(aliases: DataFrame, new: DataFrame) -> DataFrame:
    """(alias, canonical) with ``new`` ones, the later for an alias; blank names, and those that
    equal their canonical one but for case, aren't taken."""
    good = new.select(F.trim("alias").alias("alias"), F.trim("canonical").alias("canonical"), "no").where("alias <> '' and canonical <> '' and lower(alias) <> lower(canonical)")
    both = aliases.select("alias", "canonical", F.lit(-1).cast("long").alias("no")).unionByName(good.withColumn("no", F.col("no").cast("long")))
    return both.groupBy("alias").agg(F.max_by("canonical", "no").alias("canonical"))
