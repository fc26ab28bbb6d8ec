"""Golden cases of functions and operators that the driver tables cannot show."""

import pytest
from pyspark.sql import functions as F

from paperlake.functions import text as X
from paperlake.operators import budget, documents, entities, evaluate, graph, lexical, memory, ranking, vectors, verify
from paperlake.plans.tables import ensure_checkpoints
from paperlake.sources import readers, writers
from paperlake.streaming import ingest


def one(spark, expr, *values, names="abcdef"):
    schema = ", ".join(f"{n} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for n, v in zip(names, values))
    return spark.createDataFrame([tuple(values)], schema).select(expr).first()[0]


def test_text_functions(spark):
    c = F.col("a")
    assert one(spark, X.sanitize(c), "ﬁne “x”​ a\x00b\n\n\n\nc    d…") == 'fine "x" ab\n\nc  d...'
    assert one(spark, X.sentences(c), "See Sec 3.2 for settings, e.g. this. Next one! 好的。完") == ["See Sec 3.2 for settings, e.g. this.", "Next one!", "好的。", "完"]
    assert one(spark, F.length(X.protect(c)), "e.g. 3.14 Fig. 2") == len("e.g. 3.14 Fig. 2")
    assert one(spark, X.tokens(c), "FlashAttention-v2 损伤_x A.b") == ["flashattention-v2", "损伤_x", "a", "b"]
    assert one(spark, X.expanded(c), "FlashAttention-v2 x 损伤度") == ["FlashAttention-v", "2", "损伤", "伤度", "损", "伤", "度"]
    assert one(spark, X.lexical_similarity(c, F.col("b")), "ImageNet-1k", "ImageNet 1k") == 1.0
    assert one(spark, X.dedup_key(c), "Flash-Attention V2") == "flashattentionv2"
    assert one(spark, X.mentions(c, F.col("b")), "complete", "LET") is False and one(spark, X.mentions(c, F.col("b")), "the LET.", "LET") is True and one(spark, X.mentions(c, F.col("b")), "高阈值法", "阈值") is True
    for raw, want in (("Sec 3.2", "3.2"), ("sec. A . 1", "A.1"), ("附录B.2", "B.2"), ("Appendix C", "C"), ("A.1", "A.1"), ("4", "4"), ("Intro", "intro")):
        assert one(spark, X.normal_section(c), raw) == want
    assert [one(spark, X.normal_item(c), v) for v in ("Figure 2", "表3", "Tab 7", "Other")] == ["fig2", "tab3", "tab7", "other"]
    assert one(spark, X.location(c), "Sec 3.2，Fig 2；Tab 1").asDict() == {"sec": "3.2", "items": ["fig2", "tab1"], "many": True}
    assert [one(spark, X.estimated_tokens(c), v) for v in ("", "a", "a" * 35, None)] == [0, 1, 10, 0]
    assert one(spark, X.text_score(c, F.col("b")), "aaaaab", "baaaaa") == pytest.approx(2 / 3)
    assert one(spark, X.safe_name(c), "..my paper/..(1).pdf") == "my_paper_._1_.pdf"
    assert one(spark, X.draft_language(c), "中文文本 only one") == "zh" and one(spark, X.draft_language(c), "english 中") == "en"
    assert one(spark, X.uncited_paragraphs(c), "x" * 201 + "\n\n# " + "y" * 300 + "\n\n" + "z" * 300 + " [Ref: A, Sec 1]") == ["x" * 160]
    assert one(spark, X.masked(c), "sk-1234567890") == "sk-1****7890"
    assert one(spark, X.vision_tokens(c, F.col("b")), 1024, 512) == 1200


def test_scores(spark):
    assert [one(spark, lexical.trust(F.col("a")), v) for v in (0.0, 0.58, 0.6, 0.8, 1.0)] == pytest.approx([0, 0, 0, 0.5, 1])
    assert one(spark, ranking.recency(F.lit(0.0), F.lit(100.0), F.col("a")), 100.0 + 7 * 86400) == pytest.approx(0.5)
    assert one(spark, ranking.importance(F.col("a"), F.col("b")), "局限", "has 3") == 0.95
    assert one(spark, ranking.final_score(F.col("a"), F.lit(0.3), F.lit(0.1)), 0.95) > one(spark, ranking.final_score(F.col("a"), F.lit(0.95), F.lit(1.0)), 0.70)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0])], "i int, v array<double>")
    assert [r[0] for r in df.orderBy("i").select(vectors.cosine("v", F.array(F.lit(2.0), F.lit(0.0)))).collect()] == [1.0, 0.0, 0.0]


def test_graph(spark):
    ensure_checkpoints(spark)
    e = spark.createDataFrame([("A", "B"), ("B", "A"), ("B", "C"), ("C", "B")], "src string, dst string")
    seed = spark.createDataFrame([("A", 1.0)], "node string, seed double")
    s1 = {r["node"]: r["score"] for r in graph.expand(e, seed, 1).collect()}
    s2 = {r["node"]: r["score"] for r in graph.expand(e, seed, 2).collect()}
    assert s1.get("C", 0) < 0.02 < s2["C"] < s2["B"]
    c = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (7, 60)], "src long, dst long")).collect()}
    assert c == {**{i: 0 for i in range(41)}, 60: 0, 100: 100}
    notes = spark.createDataFrame([(i, ["alpha", f"w{i}"]) for i in range(1, 12)], "id long, keywords array<string>")
    links = graph.link_notes(notes, graph.link_candidates(notes))
    assert links.groupBy("src").count().agg(F.max("count")).first()[0] == 6


def test_entities(spark):
    a = entities.alias_table(spark)
    items = spark.createDataFrame([(1, 0, "FlashAttention 2", "Algorithm/Model"), (1, 1, "model", "Algorithm/Model"), (1, 2, "X", "Author")], "batch int, ord int, name string, type string")
    assert [(r["canonical"], r["verdict"]) for r in entities.sanitize_entities(items, a).orderBy("ord").collect()] == [("FlashAttention-v2", "kept"), ("model", "generic"), ("X", "schema")]
    kept = spark.createDataFrame([(1, 0, "ImageNet 1k"), (1, 1, "ImageNet-1k"), (1, 2, "Other")], "batch int, ord int, canonical string")
    assert [r["into"] for r in entities.merge_similar(kept).orderBy("ord").collect()] == ["ImageNet 1k", "ImageNet 1k", "Other"]
    p = spark.createDataFrame([("graph-policy-v1", None, {"a": "b"}, ["x"]), ("graph-policy-v1", "2024-01-05T00:00:00Z", {"a": "b"}, ["x"])], "schema string, reviewed_at string, aliases map<string,string>, blacklist array<string>")
    assert [r["review_due"] for r in entities.policy_state(p, "2024-01-08T00:00:00Z").collect()] == [True, False]


def test_verification(spark):
    drafts = spark.createDataFrame([("d", "The method is robust in all settings we tried. [Ref: P_01, Sec 3.2]. Next.")], "draft_id string, text string")
    got = verify.claims(drafts, verify.citations(drafts)).first()
    assert "robust in all settings" in got["claim"] and "Ref" not in got["claim"]
    fine = F.col("a")
    assert one(spark, verify.lexical_support(verify.support_words(fine), F.col("b")), "DBSCAN clusters tracks", "we run dbscan on tracks") is True
    assert one(spark, verify.lexical_support(verify.support_words(fine), F.col("b")), "DBSCAN clusters tracks", "nothing") is False
    cl = spark.createDataFrame([(1, "s", "apple banana")], "claim_id int, seckey string, claim string")
    ch = spark.createDataFrame([("s", i, t) for i, t in enumerate(["car engine", "apple orange banana", "apple pie", "x"])], "seckey string, ord int, chunk string")
    best = verify.best_chunks(cl, ch, X.lexical_similarity(F.col("claim"), F.col("chunk")))
    assert [r["ord"] for r in best.orderBy("rank").collect()] == [1, 2]


def test_memory(spark):
    notes = spark.createDataFrame([(1, "p", "k", "same text", [2, 99], "active", None), (2, "p", "k", "same text", [1], "candidate", None), (3, "q", "k", "other", [], "active", 5.0)], "id long, paper_id string, kind string, content string, links array<long>, status string, invalid_at double")
    assert [r["id"] for r in notes.where(memory.retrievable()).collect()] == [1]
    assert {(r["id"], r["kept"]) for r in memory.consolidated(notes).collect()} == {(1, 1), (2, 1)}
    links = spark.createDataFrame([(1, 2, "supports"), (1, 99, "extends")], "src long, dst long, rel string")
    vecs = spark.createDataFrame([(1,), (99,)], "owner_id long")
    live, typed, owned, lost = memory.collect_garbage(notes, links, vecs)
    assert lost.first().asDict() == {"links": 1, "note_links": 1, "vectors": 1} and {r["id"]: r["links"] for r in live.collect()} == {1: [2], 2: [1], 3: []}
    judged = spark.createDataFrame([(2, "same text", "candidate", "active"), (1, "stale", "active", "rejected")], "id long, content string, old_status string, new_status string")
    assert {r["id"]: r["status"] for r in memory.applied(notes, judged).collect()} == {1: "active", 2: "active", 3: "active"}
    new = memory.notes_of(spark.createDataFrame([(1, "p", "k", "  DBSCAN finds clusters of DBSCAN \x00"), (2, "p", "k", "tiny")], "id long, paper_id string, kind string, content string")).collect()
    assert len(new) == 1 and new[0]["keywords"][0] == "DBSCAN"


def test_evaluation(spark):
    s = spark.createDataFrame([(0.9, 1)] * 25 + [(0.1, 0)] * 25, "score double, label int")
    row = evaluate.calibrate(s).first()
    assert (row["auc"], row["pass_th"], row["recall"], row["fpr"], row["calibrated"]) == (1.0, 0.9, 1.0, 0.0, True)
    flat = evaluate.calibrate(s.withColumn("score", F.lit(0.5))).first()
    assert flat["auc"] == 0.5 and not flat["calibrated"]
    gold = spark.createDataFrame([("A", "abc"), ("B", "x")], "id string, text string")
    gate = evaluate.text_gate(gold, gold.limit(1)).first()
    assert gate["missing"] == 1 and gate["score"] == 0.5 and not gate["passed"]
    ranked = spark.createDataFrame([("q", i + 1, k) for i, k in enumerate("abcd")], "query_id string, rank int, key string")
    m = evaluate.retrieval_metrics(ranked, spark.createDataFrame([("q", "b"), ("q", "d")], "query_id string, key string"), 4).first()
    from math import log2

    assert m["recall"] == 1.0 and m["mrr"] == 0.5 and m["ndcg"] == pytest.approx((1 / log2(3) + 1 / log2(5)) / (1 + 1 / log2(3)))
    r = spark.createDataFrame([("c", "r1", "x", 5), ("c", "r2", "x", 4)], "case_id string, reviewer_id string, dimension string, score int")
    assert evaluate.review_gate(r).first()["passed"]


def test_budget(spark):
    u = spark.createDataFrame([("a", "s", "pass1", 2400, False), ("a", "s", "vision", 6100, False), ("b", "s", "text", 10, False)], "run_id string, stage string, kind string, tokens long, cached boolean")
    got = {r["run_id"]: r for r in budget.check(u).collect()}
    assert got["a"]["reasons"] == ["vision"] and got["a"]["warnings"] == ["pass1"] and got["b"]["passed"]
    assert {r["run_id"]: r["by_stage"] for r in budget.ledger(u).collect()}["a"] == {"s": 8500}


def test_chunks():
    text = " ".join(f"Sentence number {i} says something of no weight, e.g. this." for i in range(200))
    parts = documents.packed(text)
    assert all(len(p) <= 1200 for p in parts) and len(parts) > 5
    for i in range(200):
        assert any(f"Sentence number {i} says" in p for p in parts)
    shared = [p.split("\n\n")[0] for p in parts[1:]]
    assert all(s in q for s, q in zip(shared, parts))
    table = "intro text.\n\n" + "\n".join(["| a | b |", "|---|---|", *["| x | y |"] * 200])
    assert any(p.count("| x | y |") == 200 for p in documents.packed(table))


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "x").mkdir(parents=True)
    (tmp_path / "in" / "a b.txt").write_text("Some ﬁne text here")
    (tmp_path / "in" / "x" / "a b.txt").write_text("Another text, same name")
    (tmp_path / "in" / "c.doc").write_text("unsupported kind")
    (tmp_path / "in" / "d.md").write_text("tiny")
    rows = readers.papers(spark, str(tmp_path / "in")).collect()
    assert {r["problem"] for r in rows} == {None, "suffix", "size"} and len({r["paper_id"] for r in rows}) == 4
    assert any(r["content"] == "Some fine text here" for r in rows)
    words = spark.createDataFrame([(1, 0, 1, 1, 1, 90.0, "Hello"), (1, 1, 1, 1, 1, 80.0, "world"), (1, 2, 1, 1, 2, -1.0, "again")], "page int, no int, block int, par int, line int, conf double, word string")
    page = readers.ocr_pages(words).first()
    assert page["text"] == "Hello world\nagain" and page["confidence"] == pytest.approx(0.85)
    lines = spark.createDataFrame([(1, 0, "Figure 2: a caption"), (1, 1, "Figure 2 shows"), (1, 2, "表3 数据")], "page int, no int, line string")
    assert {(r["item"], r["caption"]) for r in readers.captions(lines).collect()} == {("fig2", "Figure 2: a caption"), ("tab3", "表3 数据")}
    df = spark.createDataFrame([("p1", "t" * 5000)], "paper_id string, text string")
    writers.artefacts(df, str(tmp_path / "out"), "chunk")
    assert len(spark.read.json(str(tmp_path / "out")).first()["text"]) == 1500
    cells = spark.createDataFrame([([["a", "b"], ["c"]],)], "r array<array<string>>")
    assert cells.select(writers.markdown_table(F.col("r"))).first()[0] == "| a | b |\n| --- | --- |\n| c |  |"


def test_streaming(spark, tmp_path):
    src, out = str(tmp_path / "s"), str(tmp_path / "o")
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:01:00"), (2, "2024-01-01 00:02:00")], "id long, t string").select("id", F.to_timestamp("t").alias("ts"))
    df.write.parquet(src)
    run = lambda: ingest.drain(ingest.distinct_within(ingest.files(spark, src, df.schema), "ts", ["id"]), str(tmp_path / "c"), ingest.idempotent_sink(out))
    run()
    assert spark.read.parquet(out).count() == 2
    df.withColumn("id", F.col("id") + 1).write.mode("append").parquet(src)
    run()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    calls = spark.createDataFrame([("e", i, at, s) for i, (at, s) in enumerate([(0.0, 200), (1.0, 503), (50.0, 200), (122.0, 404), (123.0, 200)])], "endpoint string, call_id long, at double, status int")
    assert [r["allowed"] for r in ingest.breaker(calls).orderBy("call_id").collect()] == [True, True, False, True, True]


def test_captions_are_told_apart_by_page_and_paper(spark):
    lines = spark.createDataFrame([("p", 1, 0, "Figure 2 bare"), ("p", 1, 1, "Figure 2: good"), ("p", 2, 0, "Figure 2 bare here"), ("q", 1, 0, "Fig 2 of q")], "paper_id string, page int, no int, line string")
    assert {(r["paper_id"], r["page"], r["caption"]) for r in readers.captions(lines).collect()} == {("p", 1, "Figure 2: good"), ("p", 2, "Figure 2 bare here"), ("q", 1, "Fig 2 of q")}
    boxes = spark.createDataFrame([("p", 1, 0, 0.0, 0.0, 10.0, 10.0), ("q", 1, 0, 0.0, 0.0, 10.0, 10.0)], "paper_id string, page int, box_id int, x0 double, y0 double, x1 double, y1 double")
    caps = spark.createDataFrame([("p", 1, "fig1", 0.0, 12.0, 10.0, 14.0), ("q", 1, "fig9", 0.0, 90.0, 10.0, 92.0), ("q", 1, "fig8", 0.0, 20.0, 10.0, 22.0)], "paper_id string, page int, item string, x0 double, y0 double, x1 double, y1 double")
    assert {(r["paper_id"], r["item"]) for r in readers.nearest_captions(boxes, caps).collect()} == {("p", "fig1"), ("q", "fig8")}


def test_ocr_acceptance(spark):
    pages = spark.createDataFrame([("a", f"t{i}", 0.6) for i in range(9)] + [("a", "", 0.0)] + [("b", "t", 0.4)] + [("c", None, None), ("c", "t", 0.9)], "paper_id string, text string, confidence double")
    assert {r["paper_id"]: r["accepted"] for r in readers.ocr_accepted(pages).collect()} == {"a": True, "b": False, "c": False}


def test_links_leave_out_what_cannot_be_found(spark):
    rows = [(1, ["alpha"], "active", None, "claim"), (2, ["alpha"], "candidate", None, "claim"), (3, ["alpha"], "active", 1.0, "claim"), (4, ["alpha"], "active", None, "entity"), (5, ["alpha", "x"], "active", None, "claim"), (6, ["none", "at"], "active", None, "claim"), (7, ["one"], "active", None, "claim")]
    notes = spark.createDataFrame(rows, "id long, keywords array<string>, status string, invalid_at double, kind string")
    got = {(r["id"], r["other"]) for r in graph.link_candidates(notes, most=2).collect()}
    assert {g for g in got if g[0] == 5} == {(5, 1)} and {g for g in got if g[0] == 6} == {(6, 5), (6, 4)} and not [g for g in got if g[0] == 7]


def test_newest_before_equals_a_loop(spark):
    ids = list(range(0, 900, 3))
    got = graph.newest_before(spark.createDataFrame([(i,) for i in ids[::7]], "id long"), spark.createDataFrame([(i,) for i in ids], "other long"), 4)
    assert {(r["id"], r["other"]) for r in got.collect()} == {(i, o) for i in ids[::7] for o in [x for x in ids if x < i][-4:]}


def test_support_extracts_words_once(spark):
    """Repeats, ties and case in a claim, against a plain count; one extraction of its words."""
    words = verify.support_words(F.col("a"))
    assert str(words).count("regexp_extract_all") == str(X.keyword_tokens(F.col("a"))).count("regexp_extract_all")
    assert one(spark, words, "Beta alpha Beta gamma Alpha alpha 3.5 zeta eta theta iota kappa", "") == ["Beta", "alpha", "3.5", "Alpha", "eta", "gamma", "iota", "kappa"]
    assert one(spark, verify.lexical_support(words, F.col("b")), "Beta alpha gamma", "BETA only") is False
    assert one(spark, verify.lexical_support(words, F.col("b")), "Beta Beta gamma", "BETA only") is True
