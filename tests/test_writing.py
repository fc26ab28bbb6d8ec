from pyspark.sql import functions as F

import paperlake.plans as plans
from paperlake.functions import reading, terms
from paperlake.functions import text as X
from paperlake.operators import documents, outline


def test_terms(spark):
    df = spark.createDataFrame([("Bleu4 and xbleu4x, BLEU-4.", ["a", "b", "c", "d", "e"])], "t string, a array<string>")
    names = {"bleu4": "BLEU-4"}
    row = df.select(terms.unified(F.col("t"), names), terms.consistency(F.col("t"), names), terms.evenly(F.col("a"), 3), terms.evenly(F.col("a"), 9)).first()
    assert row[0] == "BLEU-4 and xbleu4x, BLEU-4." and row[1] == 0.5 and row[2] == ["a", "c", "e"] and row[3] == ["a", "b", "c", "d", "e"]


def test_release(spark):
    gates = spark.createDataFrame([("m1", True), ("m3", False)], "gate string, passed boolean")
    row = outline.release(gates, ["m1", "m2", "m3"]).first()
    assert (row["passed"], row["missing"], row["failed"]) == (False, ["m2"], ["m3"])
    s = spark.createDataFrame([("CLEAN", None), ("CLEAN", True), ("DIRTY", True)], "s string, c boolean")
    assert [r[0] for r in s.select(outline.enforced(F.col("s"), F.col("c"))).collect()] == ["NEEDS_REVIEW", "CLEAN", "DIRTY"]


def test_drafts_cite_their_sections(spark, sf_dir):
    rows = plans.QUERIES["outline_drafts"](spark, sf_dir).collect()
    assert len(rows) > 100 and {r["ord"] for r in rows} >= {1, 2, 5}


def _extract(text, sents, most, must=()):
    """Of a text and its sentences."""
    if must:
        best = sorted(sents, key=lambda s: -sum(w.lower() in s.lower() for w in must))[:6]
        sents = [s for s in sents if s in best]
    out = ""
    for s in sents:
        if len(out) + len(s) + 1 > most:
            break
        out += s + " "
    return out.rstrip(" ") or text[:most]


def _reduced(parts, split, most):
    parts = [p for p in parts if p.strip()]
    if len(parts) < 2:
        return parts[0][:most] if parts else ""
    room = max(1, (most + 1) // 2)
    if len(parts) > room:
        parts = [parts[round(i * (len(parts) - 1) / (room - 1))] for i in range(room)] if room > 1 else parts[:1]
    each = max(1, (most - (len(parts) - 1)) // len(parts))
    return " ".join(_extract(p, split(p), each) for p in parts)[:most]


def test_summaries_equal_a_loop(spark, sf_dir):
    """Every text has a row, and long sentences their beginning."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs += [(-1, None), (-2, ""), (-3, "x" * 601), (-4, "Short. " + "y" * 700 + ". Tail."), (-5, "One two. One two. Three propose four. " * 9), (-6, "No end " * 900), (-7, " \n ")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    cache = {}

    def split(t):
        if t not in cache:
            cache[t] = [r[0] for r in spark.createDataFrame([(t,)], "t string").select(F.explode(X.sentences(F.col("t")))).collect()]
        return cache[t]

    parts = {t[i : i + 3000] for _, t in docs if t for i in range(0, len(t), 3000)} | {t for _, t in docs if t}
    texts = spark.createDataFrame([(t,) for t in parts], "t string").select("t", X.sentences(F.col("t")).alias("s"))
    cache |= {r["t"]: r["s"] for r in texts.collect()}
    words = ["the", "propose", "der"]
    must = F.lit(words)
    got = {r["doc_id"]: r["summary"] for r in documents.extractive(df, "doc_id", must_have=must).collect()}
    assert got == {i: _extract(t or "", split(t or "") if t else [], 500, words) for i, t in docs}
    plain = {r["doc_id"]: r["summary"] for r in documents.extractive(df, "doc_id", most=90).collect()}
    assert plain == {i: _extract(t or "", split(t) if t else [], 90) for i, t in docs}
    long = sorted((len(t), i) for i, t in docs if t and 2400 < len(t) < 9000)[-3:]
    some = [d for d in docs if d[0] < 3 or d[0] in {i for _, i in long}]
    digests = {r["doc_id"]: r["digest"] for r in outline.digest(df.where(F.col("doc_id").isin([i for i, _ in some])), "doc_id", most=1200, must_have=must).collect()}
    want = {}
    for i, t in some:
        t = t or ""
        want[i] = _extract(t, split(t) if t else [], 1200, words) if len(t) <= 2400 else _reduced([_extract(t[k : k + 3000], split(t[k : k + 3000]), 500, words) for k in range(0, len(t), 3000)], split, 1200)
    assert digests == want and any(len(t or "") > 6000 for _, t in some)


def test_reduction_of_many_parts(spark):
    rows = [([f"part {i}." for i in range(n)],) for n in (0, 1, 3, 40)] + [([" ", "", None, "a"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "p array<string>").select(reading.even_reduced(F.col("p"), 20)).collect()]
    split = lambda p: [p]
    assert got == [_reduced([x or "" for x in r[0]], split, 20) for r in rows]


def test_chain_of_sources(spark):
    rows = [("p", "p_Sec1_C002", " b\n c "), ("p", "p_Sec1_C001", "a"), ("p", " ", "x"), ("p", "p_Sec1_C003", None), ("q", "q_1", " ")]
    df = spark.createDataFrame(rows, "paper_id string, chunk_id string, text string")
    assert {r["paper_id"]: r["chain"] for r in outline.citation_chain(df).collect()} == {"p": "[Source: p_Sec1_C001] a [Source: p_Sec1_C002] b c", "q": ""}
