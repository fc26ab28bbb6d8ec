"""The notes' life, questions, outlines and polishing against plain loops."""

import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from paperlake.functions import reading, terms
from paperlake.operators import ask, harness, lifecycle, polish, versions

NOTE = "id long, paper_id string, kind string, content string, status string, invalid_at double, created_at long, links array<long>, keywords array<string>"


def test_ask_equals_a_loop(spark):
    rng = random.Random(9)
    words = [f"k{i}" for i in range(9)]
    rows = []
    for i in range(40):
        status = rng.choice(["active", "active", "active", "contested", "candidate"])
        rows.append((i, f"p{i % 5}", rng.choice(["claim", "claim", "entity", "方法"]), f"content {i}", status, 1.0 if i % 17 == 16 else None, i, rng.sample(range(45), 3), rng.sample(words, 4)))
    by = {r[0]: r for r in rows}
    found = lambda i: i in by and by[i][4] in ("active", "contested") and by[i][5] is None
    trusted = lambda i: found(i) and by[i][4] == "active"
    hits = [(q, v, r + 1, i, 0.9 - 0.05 * r) for q in ("a", "b") for v in range(2) for r, i in enumerate(rng.sample([i for i in range(40) if found(i)], 12))]
    edge = [(r[0], d) for r in rows for d in r[7]] + [e for s, d in [(1, 2), (3, 9)] for e in ((s, d), (d, s))]
    got = {}
    for r in ask.ask(spark.createDataFrame(hits, "query string, variant int, rank int, id long, score double"), spark.createDataFrame(rows, NOTE), spark.createDataFrame(edge, "src long, dst long")).collect():
        got.setdefault(r["query"], []).append((r["rank"], r["id"], r["via"]))
    out = {}
    for s, d in edge:
        out.setdefault(s, []).append(d)
    for q in ("a", "b"):
        fused, score = {}, {}
        for v in range(2):
            own = [h for h in sorted(hits, key=lambda h: h[2]) if h[0] == q and h[1] == v and trusted(h[3])]
            for place, h in enumerate(own):
                fused[h[3]] = fused.get(h[3], 0) + 1 / (61 + place)
                score[h[3]] = h[4]
        best = [i for i in sorted(fused, key=lambda i: (-int(fused[i] * 1e9 + 0.5), i))[:12] if by[i][2] != "entity"]
        seeds = {i: score[i] for i in best}
        ppr = dict(seeds)
        for _ in range(2):
            new = {}
            for i, s in ppr.items():
                new[i] = new.get(i, 0) + 0.425 * s
                for d in out.get(i, []):
                    new[d] = new.get(d, 0) + 0.425 * s / len(out[i])
            for i, s in seeds.items():
                new[i] = new.get(i, 0) + 0.15 * s
            ppr = new
        extra = sorted(((i, s) for i, s in ppr.items() if i not in seeds and s > 0.02), key=lambda x: (-int(x[1] * 1e9 + 0.5), x[0]))[:6]
        pool = [(i, "search") for i in best] + [(i, "graph") for i, _ in extra if found(i) and by[i][2] != "entity"]
        left, taken = list(enumerate(pool)), []
        while left and len(taken) < 6:
            sim = lambda i: max((len({*by[i][8]} & {*by[t][8]}) / len({*by[i][8]} | {*by[t][8]}) for _, (t, _) in taken), default=0)
            gain = [0.7 / (1 + p) - 0.3 * sim(i) for p, (i, _) in left]
            taken.append(left.pop(gain.index(max(gain))))
        picked = [x for _, x in taken]
        links = sorted({d for i, _ in picked for d in by[i][7]} - {i for i, _ in picked})
        near = [d for d in links if found(d) and by[d][2] != "entity"][:20]
        via = dict(pool)
        final = [(i, via.get(i, "link")) for i in [i for i, _ in picked] + near if by[i][2] != "entity" and by[i][4] == "active"][:11]
        assert [(i, v) for _, i, v in sorted(got[q])] == final


def test_judged_notes(spark):
    md = spark.createDataFrame([("p", "x\n## Finding\nalpha beta gamma results\n## 一句话主张\nno\n## Empty\n\n## Second\nunknown words only here\n"), ("q", None)], "paper_id string, md string")
    claims = spark.createDataFrame([("p", 0, "alpha beta", "e", None), ("p", 1, "", "e", None)], "paper_id string, no int, claim string, evidence string, limitation string")
    names = spark.createDataFrame([("p", 0, "Alpha", "Algorithm/Model"), ("p", 1, "Nowhere", "Dataset")], "paper_id string, no int, name string, type string")
    made = lifecycle.reading_notes(md, claims, names)
    states = spark.createDataFrame([("p", "brief", "CLEAN"), ("p", "full", "DIRTY")], "paper_id string, artefact string, state string")
    source = spark.createDataFrame([("p", "the alpha beta gamma of all results")], "paper_id string, text string")
    rows = {(r["kind"], r["content"]): r for r in lifecycle.judged(made, states, source, True, "t").collect()}
    assert {k: r["status"] for k, r in rows.items()} == {("Finding", "alpha beta gamma results"): "active", ("Second", "unknown words only here"): "candidate", ("claim", "alpha beta | 证据: e | 局限: "): "candidate", ("entity", "Alpha（Algorithm/Model）"): "active", ("entity", "Nowhere（Dataset）"): "candidate"}
    assert "artifact-status:DIRTY" in rows["claim", "alpha beta | 证据: e | 局限: "]["tags"]
    assert all(r["status"] == "candidate" for r in lifecycle.judged(made, states, source, False, "t").collect() if r["kind"] == "entity")


def test_replaced_keeps_what_people_wrote(spark):
    schema = "id int, paper_id string, task string, tags array<string>"
    old = spark.createDataFrame([(1, "p", "t", [lifecycle.GENERATED]), (2, "p", "t", ["mine"]), (3, "p", "u", [lifecycle.GENERATED]), (4, "q", "t", [lifecycle.GENERATED]), (5, "p", "t", None)], schema)
    new = spark.createDataFrame([(9, "p", "t", [lifecycle.GENERATED])], schema)
    assert {r["id"] for r in lifecycle.replaced(old, new).collect()} == {2, 3, 4, 5, 9}
    assert {r["id"] for r in lifecycle.replaced(old, new.limit(0)).collect()} == {1, 2, 3, 4, 5}


def test_insights_need_evidence(spark):
    notes = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta")], "id long, content string")
    inputs = spark.createDataFrame([("p", 1), ("p", 2)], "scope string, id long")
    said = spark.createDataFrame([("p", 0, "alpha beta gamma", [1, 7]), ("p", 1, "zeta eta theta", [2]), ("p", 2, "alpha", []), ("p", 3, " ", [1])], "scope string, no int, insight string, evidence array<long>")
    made, links = lifecycle.insights(said, inputs, notes)
    assert {r["no"]: r["status"] for r in made.collect()} == {0: "active", 1: "candidate", 2: "candidate"}
    assert {(r["no"], r["dst"]) for r in links.collect()} == {(0, 1), (1, 2)}


def test_outline_diff_equals_difflib(spark):
    outlines = [{"sections": ["a", "b"], "version": "v1", "z": 1}, {"z": 1, "sections": ["a", "c"], "version": "v2"}, {"z": 1, "sections": ["a", "c"], "source": "x"}]
    df = spark.createDataFrame([("k", i, json.dumps(o)) for i, o in enumerate(outlines)] + [("bad", 0, "not json")], "key string, no int, o string")
    v = versions.appended(df.select("key", "no", versions.core("o").alias("content"), F.lit("s").alias("source")))
    rows = v.collect()
    assert [(r["key"], r["version"], r["parent"]) for r in rows] == [("k", 1, None), ("k", 2, 1)]
    again = versions.rolled_back(v, spark.createDataFrame([("k", 1), ("none", 1)], "key string, version int"))
    assert [(r["version"], r["parent"], r["source"]) for r in again.orderBy("version").collect()][-1] == (3, 2, "rollback:v1")
    got = versions.differences(v, spark.createDataFrame([("k", 1, 2)], "key string, old int, new int")).first()["diff"]
    plain = [json.dumps({k: x for k, x in o.items() if k not in versions.META}, ensure_ascii=False, indent=2, sort_keys=True).splitlines() for o in outlines[:2]]
    assert got == "\n".join(difflib.unified_diff(*plain, fromfile="v1", tofile="v2", lineterm=""))


def test_transitions(spark):
    section = lambda h1, h2, *claims: (h1, h2, list(claims))
    schema = "draft_id string, sections array<struct<h1:string,h2:string,claims:array<string>>>"
    outlines = spark.createDataFrame([("a", [section("Background", "x"), section("Ours", "y"), section("Ours", "ours", "We show that it is so")]), ("b", [section("A", "b"), section("C", "d")]), ("c", [section("背景", ""), section("方法", "细节")])], schema)
    drafts = spark.createDataFrame([("a", "top\n## background /x\none\n## Ours / y\ntwo\n## Ours / ours\nthree"), ("b", "## A / b\n## D / c\n"), ("c", "## 背景 / \n这里是中文内容。\n## 方法 / 细节\n更多中文"), ("d", "no headings")], "draft_id string, text string")
    rows = {r["draft_id"]: r for r in polish.with_transitions(drafts, outlines).collect()}
    assert rows["a"]["transitions"] == 2 and rows["b"]["transitions"] == 0 and rows["b"]["text"] == "## A / b\n## D / c\n" and rows["d"]["text"] == "no headings"
    assert rows["a"]["text"] == "top\n## background /x\none\n## Ours / y\nBuilding on the problem framing in Background (x), Ours (y) now develops the method and its underlying design rationale.\n\ntwo\n## Ours / ours\nBuilding on Ours (y), Ours advances the next stage of the argument.\n\nthree"
    assert "承接背景的问题界定，方法（细节）进一步展开方法设计及其理论依据。" in rows["c"]["text"]


def test_reading_functions(spark):
    text = "> quoted\n```\n- First point is here [Ref: p, Sec 1]. Second one is longer than that.\n\n2) Third."
    df = spark.createDataFrame([(text, "```json\n{\"a\": [1]}\n``` and [2]", "a focus")], "t string, j string, f string")
    row = df.select(reading.prose(F.col("t")).alias("p"), reading.first_sentences(F.col("t"), 1, 20).alias("s"), reading.json_of(F.col("j")).alias("j"), reading.cache_key(F.col("t"), F.lit(" ")).alias("k")).first()
    assert row["p"] == "First point is here [Ref: p, Sec 1]. Second one is longer than that. Third."
    assert row["s"] == "First point is here… [Ref: p, Sec 1]" and row["j"] == '{"a": [1]}' and row["k"] is None
    sentences = ["one two", "focus here", "one two", "a focus again", "rest"]
    got = spark.createDataFrame([(sentences,)], "s array<string>").select(reading.focus_rank(F.col("s"), F.lit("a focus")).alias("r"), reading.take_fitting(F.col("s"), 20, F.lit("text")).alias("t"), reading.take_fitting(F.col("s"), 3, F.lit("text")).alias("u")).first()
    assert got["r"] == ["a focus again", "focus here", "one two", "one two", "rest"] and got["t"] == "one two focus here" and got["u"] == "tex"


def test_records_and_contexts(spark):
    rows = spark.createDataFrame([(1, 30, 30, 0.8, 0.5, 0.9, 0.01, 0.95, True), (2, 30, 10, 0.4, 0.5, 0.7, 0.2, None, None)], "id int, positives int, negatives int, pass_th double, review_th double, recall double, fpr double, auc double, calibrated boolean")
    got = {r["id"]: (r["valid"], r["problems"]) for r in harness.recorded(rows).collect()}
    assert got == {1: (True, []), 2: (False, ["auc", "sample", "order", "fpr_gate", "recall_gate", "calibrated"])}
    pairs = [("A  b", "a B", True), ("x" * 20, "y" + "X" * 20, True), ("x" * 19, "y" + "x" * 19, False), (None, "", True)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert df.where(harness.same_context(F.col("a"), F.col("b")) != F.col("want")).count() == 0


@pytest.mark.parametrize("text, want", [("alpha", 1.0), ("other", 1.0)])
def test_questions_loader(spark, text, want):
    rows = spark.createDataFrame([(2, text, [1], "en"), (1, text, [], "en"), (3, "", [1], "zh"), (4, text, [2], "zh")], "note_id int, q string, pos array<int>, lang string")
    assert [r["note_id"] for r in harness.questions(rows).collect()] == [2, 4]
    assert [r["note_id"] for r in harness.questions(rows, ["zh"], 1).collect()] == [4]


def test_heading_key(spark):
    assert spark.range(1).select(terms.heading_key(F.lit("  A  b /  C ")).alias("k")).first()["k"] == "a b/c"


def test_reading_notes_deals_few_splits_to_all_cores(spark, sf_dir):
    from paperlake import plans

    plan = plans.QUERIES["reading_notes"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan
