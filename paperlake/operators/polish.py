"""Polishing of drafts: one name for one thing, transitions, contradictions, release rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions import terms
from paperlake.functions.text import draft_language, tokens
from paperlake.operators.common import top
from paperlake.operators.entities import contradictions


def _headed(drafts: DataFrame, text: str = "text") -> DataFrame:
    """(draft_id, head, parts): what stands before the first ``## `` line, and the others as
    structs (title, body), the body with its line feed."""
    parts = F.split(F.col(text), r"(?m)^(?=## .)")
    own = F.when(F.get(parts, F.lit(0)).startswith("## "), parts).otherwise(F.slice(parts, 2, 1 << 20))
    head = F.when(F.get(parts, F.lit(0)).startswith("## "), F.lit("")).otherwise(F.get(parts, F.lit(0)))
    title = lambda p: F.substring_index(p, "\n", 1)
    return drafts.withColumn("_head", head).withColumn("_parts", F.transform(own, lambda p: F.struct(title(p).alias("title"), F.substr(p, F.length(title(p)) + 1).alias("body"))))


def with_transitions(drafts: DataFrame, outlines: DataFrame) -> DataFrame:
    """(draft_id, text, transitions): drafts (draft_id, text) with a sentence before each section
    but the first, if their headings are the outline's (draft_id, sections: h1, h2, claims), one
    for one and in order; others stay as they are, with 0."""
    rows = _headed(drafts).join(outlines.select("draft_id", "sections"), "draft_id", "left")
    expected = F.transform("sections", lambda s: terms.heading_key(F.concat(F.coalesce(s["h1"], F.lit("")), F.lit(" / "), F.coalesce(s["h2"], F.lit("")))))
    actual = F.transform("_parts", lambda p: terms.heading_key(F.regexp_replace(p["title"], r"^##\s+", "")))
    fits = (F.size("sections") >= 2) & (actual == expected)
    language = draft_language(F.col("text"))
    between = lambda i: F.when(i > 0, F.concat(F.lit("\n"), terms.transition(F.get("sections", i - 1), F.get("sections", i), F.col("_language")), F.lit("\n"))).otherwise(F.lit(""))
    whole = F.concat(F.col("_head"), F.array_join(F.transform("_parts", lambda p, i: F.concat(p["title"], between(i), p["body"])), ""))
    rows = rows.withColumn("_language", language).withColumn("_fits", F.coalesce(fits, F.lit(False)))
    return rows.select("draft_id", F.when(F.col("_fits"), whole).otherwise(F.col("text")).alias("text"), F.when(F.col("_fits"), F.size("sections") - 1).otherwise(0).alias("transitions"))


def polished(drafts: DataFrame, outlines: DataFrame, relations: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(draft_id, text, terms_changed, consistency, transitions, expected, complete,
    contradictions): terms, then transitions, then what contradicts."""
    one = drafts.select("draft_id", terms.unified(F.col("text"), aliases).alias("text"), F.col("text").alias("_old"))
    moved = with_transitions(one.select("draft_id", "text"), outlines)
    clash = contradictions(moved.select("draft_id", "text"), relations).groupBy("draft_id").agg(F.count("*").alias("contradictions"))
    rows = moved.join(one.select("draft_id", (~F.col("text").eqNullSafe(F.col("_old"))).alias("terms_changed")), "draft_id").join(outlines.select("draft_id", F.greatest(F.size("sections") - 1, F.lit(0)).alias("expected")), "draft_id", "left").join(clash, "draft_id", "left")
    return rows.select("draft_id", "text", "terms_changed", terms.consistency(F.col("text"), aliases).alias("consistency"), "transitions", F.coalesce("expected", F.lit(0)).alias("expected"), (F.col("transitions") >= F.coalesce("expected", F.lit(0))).alias("complete"), F.coalesce("contradictions", F.lit(0)).alias("contradictions"))


def release_rows(drafts: DataFrame) -> DataFrame:
    """(draft_id, citation, status): what stands against a draft beside its citations. Columns:
    consistency, complete, contradictions, downgrade, review_missing, missing_chunks,
    invalid_chunks, paper_mismatch, duplicate_headings, bad_formulas, budget_ok,
    budget_verified; null speaks for the draft in none of them."""
    bad = lambda c: F.coalesce(F.col(c), F.lit(True))
    tests: list[tuple[str, str, Column]] = [
        ("[TERM_CONSISTENCY]", "UNVERIFIED", F.coalesce(F.col("consistency") < 0.99, F.lit(True))),
        ("[TRANSITION]", "UNVERIFIED", ~F.coalesce("complete", F.lit(False))),
        ("[CONTRADICTION]", "NEEDS_REVIEW", F.coalesce(F.col("contradictions") > 0, F.lit(True))),
        ("[LOW_CONFIDENCE_EXTRACTION]", "UNVERIFIED", bad("downgrade")),
        ("[REVIEW_NOT_GENERATED]", "UNVERIFIED", bad("review_missing")),
        ("[MISSING_SECTION_EVIDENCE]", "UNVERIFIED", F.coalesce(F.col("missing_chunks") > 0, F.lit(True))),
        ("[INVALID_CHUNK_REFERENCE]", "UNVERIFIED", F.coalesce(F.col("invalid_chunks") > 0, F.lit(True))),
        ("[OUTLINE_PAPER_MISMATCH]", "UNVERIFIED", bad("paper_mismatch")),
        ("[DUPLICATE_OUTLINE_HEADING]", "UNVERIFIED", bad("duplicate_headings")),
        ("[FORMULA]", "UNVERIFIED", bad("bad_formulas")),
        ("[BUDGET]", "UNVERIFIED", ~F.coalesce("budget_ok", F.lit(False))),
        ("[BUDGET_UNVERIFIED]", "NEEDS_REVIEW", ~F.coalesce("budget_verified", F.lit(False))),
    ]
    rows = F.filter(F.array(*[F.when(t, F.struct(F.lit(c).alias("citation"), F.lit(s).alias("status"))) for c, s, t in tests]), lambda x: x.isNotNull())
    return drafts.select("draft_id", F.explode(rows).alias("r")).select("draft_id", "r.citation", "r.status")


def evidence_within(chunks: DataFrame, claims: DataFrame, group: str = "paper_id", k: int = 4, cap: int = 1800) -> DataFrame:
    """(group, claim_id, rank, chunk_id, score_micro, text, sha256): the ``k`` chunks (group,
    chunk_id, text) of a claim's own paper (group, claim_id, text) of the highest TF-IDF cosine,
    with idf of that paper alone; chunks without a common word score 0 and come last by id. The
    text is cut at ``cap`` characters, the hash is that of the whole."""
    count = lambda df, key: df.select(group, key, F.explode(tokens(F.col("text"))).alias("term")).groupBy(group, key, "term").agg(F.count("*").alias("tf"))
    posts, n = count(chunks, "chunk_id"), chunks.groupBy(group).agg(F.count("*").alias("n"))
    idf = posts.groupBy(group, "term").agg(F.count("*").alias("df")).join(n, group).select(group, "term", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weights = posts.join(idf, [group, "term"]).withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    asked = count(claims, "claim_id").join(idf, [group, "term"], "left").withColumn("q", (1 + F.ln("tf")) * F.coalesce("idf", F.ln(F.lit(2.0)) + 1))
    norm = weights.groupBy(group, "chunk_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    own = asked.groupBy(group, "claim_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    dots = weights.join(asked.select(group, "claim_id", "term", "q"), [group, "term"]).groupBy(group, "claim_id", "chunk_id").agg(F.sum(F.col("w") * F.col("q")).alias("dot"))
    pairs = claims.select(group, "claim_id").join(chunks.select(group, "chunk_id"), group)
    scored = pairs.join(dots, [group, "claim_id", "chunk_id"], "left").join(norm, [group, "chunk_id"], "left").join(own, [group, "claim_id"], "left")
    value = F.coalesce(F.try_divide("dot", F.col("dn") * F.col("qn")), F.lit(0.0))
    best = top(scored.withColumn("score_micro", F.floor(value * 1e6 + 0.5).cast("long")), [group, "claim_id"], [F.desc("score_micro"), F.asc("chunk_id")], k)
    rows = best.select(group, "claim_id", "rank", "chunk_id", "score_micro").join(chunks.select(group, "chunk_id", F.col("text").alias("_t")), [group, "chunk_id"])
    return rows.select(group, "claim_id", "rank", "chunk_id", "score_micro", F.left("_t", F.lit(cap)).alias("text"), F.sha2("_t", 256).alias("sha256"))


def whole_batches(rows: DataFrame, by: list[str], valid: Column) -> DataFrame:
    """Rows of the batches in which every row is ``valid``: one bad row rejects its batch."""
    return rows.withColumn("_ok", F.bool_and(F.coalesce(valid, F.lit(False))).over(Window.partitionBy(*by))).where("_ok").drop("_ok")
