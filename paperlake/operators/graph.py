"""Note graph: edges, two-step personalised PageRank, neighbours, components, shared concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlake.operators.common import kept, tidied, top


def edges(notes: DataFrame, note_links: DataFrame) -> DataFrame:
    """(src, dst) of a multigraph: ``links`` arrays one way, typed links both ways; parallel
    edges stay and count."""
    own = notes.select(F.col("id").alias("src"), F.explode("links").alias("dst"))
    return own.unionByName(note_links.select("src", "dst")).unionByName(note_links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def expand(edge: DataFrame, seeds: DataFrame, steps: int = 2, damping: float = 0.85) -> DataFrame:
    """Lazy personalised PageRank from ``seeds`` (node, seed: shares that add up to 1), a fixed
    number of steps: (node, score). Each step is a join and a grouped sum by node; a
    checkpoint cuts the plan from the third step on."""
    out = edge.groupBy("src").agg(F.count("*").alias("deg"))
    steps_of = edge.groupBy("src", "dst").agg(F.count("*").alias("m")).join(out, "src").select("src", "dst", (F.col("m") / F.col("deg")).alias("share"))
    score = seeds.select("node", F.col("seed").alias("score"))
    for i in range(steps):
        if i >= 2:
            score = score.checkpoint()
        moved = score.join(steps_of, score["node"] == steps_of["src"]).select(F.col("dst").alias("node"), (damping * 0.5 * F.col("score") * F.col("share")).alias("score"))
        stays = score.select("node", (damping * 0.5 * F.col("score")).alias("score"))
        back = seeds.select("node", ((1 - damping) * F.col("seed")).alias("score"))
        score = moved.unionByName(stays).unionByName(back).groupBy("node").agg(F.sum("score").alias("score"))
    return score


def neighbours(edge: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes one step from ``seeds`` (node) that are no seeds."""
    near = edge.join(seeds.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
    return near.join(seeds.select("node"), "node", "left_anti")


def components(edge: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edge`` (src, dst). Star
    contractions (grouped minima and equi-joins) until nothing changes, each round written by
    ``checkpoint`` to the shared folder."""
    if edge.sparkSession.sparkContext.getCheckpointDir() is None:
        raise ValueError("components need spark.checkpoint.dir")
    # loops stay here, for nodes that have nothing else; ``edge`` isn't computed again
    every = edge.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct().checkpoint()
    e, last = every.where("u <> v"), None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        e = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == last:
            nodes = every.select(F.explode(F.array("u", "v")).alias("node")).distinct()
            return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        last = now
        tidied(edge.sparkSession)
    raise RuntimeError("components did not converge")


def spanning_forest(edge: DataFrame, rounds: int = 40) -> DataFrame:
    """(a, b, weight): a maximum spanning forest of the undirected ``edge`` (src, dst, weight),
    in Boruvka's rounds. Each component takes its heaviest edge to another one by a grouped
    minimum over a total order (weight falling, then both ends), so there is no cycle but of two
    that take the same edge; then each finds the end of its chain of components by doubling.
    Rounds halve the components at least and end in a checkpoint; of parallel edges between two
    components the best is kept, so the table shrinks. Loops and null ends don't count; null
    weights come last."""
    if edge.sparkSession.sparkContext.getCheckpointDir() is None:
        raise ValueError("a spanning forest needs spark.checkpoint.dir")
    place = F.struct((-F.coalesce(F.col("weight").cast("double"), F.lit(float("-inf")))).alias("w"), "a", "b")
    rows = edge.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight").where("a < b")
    e = rows.select(F.col("a").alias("u"), F.col("b").alias("v"), place.alias("o")).groupBy("u", "v").agg(F.min("o").alias("o")).checkpoint()
    taken = []
    for _ in range(rounds):
        if e.isEmpty():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "o"))
        best = both.groupBy("u").agg(F.min(F.struct("o", "v")).alias("m")).select("u", "m.o", "m.v").checkpoint()
        taken.append(best.select("o").distinct())
        # of two that take each other the smaller is the root
        back = best.select(F.col("u").alias("v"), F.col("v").alias("w"))
        up = best.join(back, "v", "left").select("u", F.when((F.col("w") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("p")).checkpoint()
        while True:
            further = up.join(up.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("p").alias("was"), F.col("q").alias("p")).checkpoint()
            done = further.where("was <> p").isEmpty()
            up = further.select("u", "p")
            if done:
                break
        e = e.join(up.withColumnRenamed("p", "x"), "u").join(up.select(F.col("u").alias("v"), F.col("p").alias("y")), "v").where("x <> y")
        e = e.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"), "o").groupBy("u", "v").agg(F.min("o").alias("o")).checkpoint()
    else:
        raise RuntimeError("the forest did not converge")
    if not taken:
        return edge.sparkSession.createDataFrame([], rows.schema)
    out = taken[0]
    for more in taken[1:]:
        out = out.union(more)
    kind = rows.schema["weight"].dataType
    return out.select("o.a", "o.b", F.when(F.col("o.w") < float("inf"), -F.col("o.w")).cast(kind).alias("weight"))


def clusters(forest: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(node, cluster) for all ``nodes`` (node): those that edges of a weight of ``least`` or
    more join are one cluster, named by its smallest node. The forest of a graph gives the same
    clusters as all its edges, at any ``least``."""
    c = components(forest.where(F.col("weight") >= least).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return nodes.select("node").distinct().join(c, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))


def shared_concepts(concepts: DataFrame, least: int = 2, paper: str = "paper_id", concept: str = "concept") -> DataFrame:
    """(a, b, weight): pairs of papers with ``least`` or more common concepts. The pairs come
    from an equi-join on the concept, never from all pairs of papers."""
    one = concepts.select(paper, F.lower(concept).alias("c")).distinct()
    pairs = one.alias("x").join(one.alias("y"), (F.col("x.c") == F.col("y.c")) & (F.col(f"x.{paper}") < F.col(f"y.{paper}")))
    return pairs.groupBy(F.col(f"x.{paper}").alias("a"), F.col(f"y.{paper}").alias("b")).agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def concept_papers(concepts: DataFrame, limit: int = 50, paper: str = "paper_id", concept: str = "concept") -> DataFrame:
    """Concepts of two papers or more, the most common first."""
    n = concepts.select(paper, concept).distinct().groupBy(concept).agg(F.count("*").alias("papers")).where("papers >= 2")
    return n.orderBy(F.desc("papers"), concept).limit(limit)


def should_link(a, b, least: float = 0.28):
    """Lower-cased keyword arrays: a common ASCII word of five characters, or two common words,
    or a Jaccard index of ``least``."""
    from paperlake.functions.text import jaccard

    common = F.array_intersect(a, b)
    long = F.exists(common, lambda w: (F.length(w) >= 5) & ~w.rlike(r"[^\x00-\x7f]"))
    return long | (F.size(common) >= 2) | (jaccard(a, b) >= least)


def link_candidates(notes: DataFrame, most: int = 12, terms: int = 6) -> DataFrame:
    """(id, other): earlier notes that share one of a note's first keywords, ``most`` for each
    note by id; only those that can be found and are no entities, where the table says so
    (status, invalid_at, kind). A note of two keywords or more that meets none gets the
    ``most`` newest before it.

    Blocking is an equi-join on the keyword; as the smallest ids count, ``most`` notes of a
    keyword are all it can give to any note, however many hold it. The newest before a note
    are those of the same block of ids or the one before, blocks being of ``most`` notes."""
    from paperlake.operators.memory import retrievable

    found = notes
    if {"status", "invalid_at"} <= set(notes.columns):
        found = found.where(retrievable())
    if "kind" in notes.columns:
        found = found.where("kind <> 'entity'")
    first = notes.select("id", F.explode(F.slice("keywords", 1, terms)).alias("w")).withColumn("w", F.lower("w")).distinct()
    every = found.select(F.col("id").alias("other"), F.explode("keywords").alias("w")).withColumn("w", F.lower("w")).distinct()
    every = top(every, ["w"], [F.asc("other")], most).drop("rank")
    pairs = first.join(every, "w").where("other < id").select("id", "other").distinct()
    met = top(pairs, ["id"], [F.asc("other")], most).drop("rank")
    alone = notes.where(F.size("keywords") >= 2).select("id").join(met.select("id"), "id", "left_anti")
    return met.unionByName(newest_before(alone, notes.select(F.col("id").alias("other")), most))


def newest_before(asking: DataFrame, notes: DataFrame, most: int) -> DataFrame:
    """(id, other): for each of ``asking`` (id), which are notes, the ``most`` largest of
    ``notes`` (other) under it. Notes are numbered in order (``ordered.running``), so each asks
    for the ``most`` numbers before its own and no range is read twice."""
    from paperlake.operators import ordered

    numbered = kept(ordered.running(notes.select("other").distinct(), "other", {"c": F.count("*")}).select(F.col("value").alias("other"), F.col("to_c").alias("no")), "numbered")
    own = asking.join(numbered, F.col("id") == F.col("other")).where("no > 1")
    wanted = own.select("id", F.explode(F.sequence(F.greatest(F.col("no") - most, F.lit(1)), F.col("no") - 1)).alias("no"))
    return wanted.join(numbered, "no").select("id", "other")


def link_notes(notes: DataFrame, candidates: DataFrame, forward: int = 6, backward: int = 24, least: float = 0.28) -> DataFrame:
    """(src, dst): accepted links, ``forward`` a note by candidate order, and at most
    ``backward`` notes that link to one."""
    low = lambda c: F.transform(c, F.lower)
    k = notes.select("id", low(F.col("keywords")).alias("k"))
    pairs = candidates.join(k, "id").join(k.select(F.col("id").alias("other"), F.col("k").alias("l")), "other")
    kept = top(pairs.where(should_link(F.col("k"), F.col("l"), least)), ["id"], [F.asc("other")], forward).drop("rank")
    return top(kept, ["other"], [F.asc("id")], backward).select(F.col("id").alias("src"), F.col("other").alias("dst"))
