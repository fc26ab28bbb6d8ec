"""What plans broadcast is known to be small: Spark's own sizes don't count what an explode adds."""

from pyspark.sql import functions as F

from paperlake.llm import common, simhash


def broadcasts(df):
    """What a plan broadcasts, each as the lines of its part of the plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda s: len(s) - len(s.lstrip(" :+-"))
    out = []
    for i, s in enumerate(lines):
        if "BroadcastExchange" in s:
            below = lines[i + 1 :]
            n = next((k for k, x in enumerate(below) if depth(x) <= depth(s)), len(below))
            out.append("\n".join(below[:n]))
    return out


def test_links_do_not_broadcast_exploded_keys(spark):
    """Spark takes an index to be as large as its fingerprints, so in a session with its usual
    threshold it sent 64 keys of each to the driver."""
    prints = spark.range(300).select(F.xxhash64("id").alias("simhash"))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) == 10 << 20
    assert broadcasts(prints.join(prints, "simhash"))
    for hot in (1, 2048):
        assert not [b for b in broadcasts(simhash.links(prints, hot=hot)) if "Generate" in b]


def test_components_broadcast_by_count(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    want = {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}
    for few in (100_000, 0):
        plans, real = [], common.saved
        monkeypatch.setattr(common, "FEW_EDGES", few)
        with monkeypatch.context() as m:
            m.setattr(common, "saved", lambda df: plans.append(broadcasts(df)) or real(df))
            assert {tuple(r) for r in common.components(edges).collect()} == want
        assert all(plans[1:]) if few else not any(plans)


def test_near_copies_do_not_broadcast_exploded_rows(spark, monkeypatch):
    """Of the cells, shingles and pairs that the search for near copies makes, none is broadcast
    but what was counted."""
    import random

    rng, texts = random.Random(5), []
    for _ in range(3):
        words = [f"w{rng.randrange(10_000)}" for _ in range(80)]
        texts += [" ".join([*words[:i], "x", *words[i + 1 :]]) for i in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plans, saved, stored = [], simhash.saved, simhash.stored
    monkeypatch.setattr(simhash, "saved", lambda df: plans.append(broadcasts(df)) or saved(df))
    monkeypatch.setattr(simhash, "stored", lambda df, name: plans.append(broadcasts(df)) or stored(df, name))
    nodes = simhash.stored(simhash.with_segments(docs), "segments").select("node", "segs")
    simhash.candidates(nodes, simhash._cells(nodes))
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    sets = simhash.stored(simhash.with_shingles(docs.withColumnRenamed("doc_id", "node"), 5), "shingles")
    simhash.saved(simhash.verified(pairs, sets))
    simhash.saved(simhash.prefixes(sets))
    found = [b for p in plans for b in p]
    assert not [b for b in found if "Generate" in b or "FileScan" in b or "Aggregate" in b]
