"""Citation and claim verification: a fail-closed gate over DataFrames."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.functions.text import blank, keyword_tokens, let, location, sentence_spans
from paperlake.operators.common import blocks, top

# fixed values: the shape of a citation
CITATION = r"(?i)[\[【]\s*ref\s*[:：]\s*([^,\]】，]+?)\s*[,，]\s*([^\]】]+?)\s*[\]】]"


def citations(drafts: DataFrame) -> DataFrame:
    """(draft_id, no, citation, ref, sec, item, many, start) of every inline citation."""
    hit = lambda g: F.regexp_extract_all(blank(F.col("text")), F.lit(CITATION), F.lit(g))
    rows = drafts.select("draft_id", "text", F.posexplode(F.arrays_zip(hit(0).alias("c"), hit(1).alias("r"), hit(2).alias("l"))).alias("no", "x"))
    loc = location(F.col("x.l"))
    # the k-th occurrence of an equal citation starts where k - 1 equal ones end
    same = F.size(F.filter(F.slice(hit(0), F.lit(1), F.col("no") + 1), lambda c: c == F.col("x.c")))
    before = F.call_function("substring_index", F.col("text"), F.col("x.c"), same)
    rows = rows.withColumn("l", loc)
    return rows.select("draft_id", "no", F.col("x.c").alias("citation"), F.trim("x.r").alias("ref"), F.col("l.sec").alias("sec"), F.get("l.items", F.lit(0)).alias("item"), F.col("l.many").alias("many"), F.length(before).alias("start"))


def claims(drafts: DataFrame, cited: DataFrame) -> DataFrame:
    """Adds ``claim``: the sentence of a citation without citations; with the sentence before
    it if under 20 characters are left."""
    spans = drafts.select("draft_id", sentence_spans(F.col("text")).alias("spans"))
    rows = cited.join(spans, "draft_id")
    s = F.col("spans")
    at = F.greatest(F.size(F.filter(s, lambda x: x["start"] <= F.col("start"))) - 1, F.lit(0))
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, CITATION, ""), r"^[ 。.!?；;:\n\t]+|[ 。.!?；;:\n\t]+$", "")
    rows = rows.withColumn("_at", at).withColumn("_own", bare(F.get(s, F.col("_at"))["sentence"]))
    before = bare(F.get(s, F.col("_at") - 1)["sentence"])
    claim = F.when((F.length("_own") < 20) & (F.col("_at") > 0), F.trim(F.concat_ws(" ", before, F.col("_own")))).otherwise(F.col("_own"))
    return rows.withColumn("claim", claim).drop("spans", "_at", "_own")


def existence(cited: DataFrame, truth: DataFrame, figures: DataFrame) -> DataFrame:
    """Adds ``key``, ``status`` and ``reason``: status is null where a score must decide.
    ``truth``: (key, text); ``figures``: (seckey, item)."""
    key = F.when(F.col("sec").isNotNull(), F.concat_ws("_", "ref", "sec")).when(F.col("item").isNotNull(), F.concat_ws("_", "ref", "item"))
    rows = cited.withColumn("key", key)
    exact = truth.select(F.col("key").alias("_k"), F.col("text").alias("source")).dropDuplicates(["_k"])
    low = truth.groupBy(F.lower("key").alias("_l")).agg(F.lit(True).alias("_low"))
    rows = rows.join(exact, rows["key"] == exact["_k"], "left").join(low, F.lower("key") == low["_l"], "left")
    listed = figures.select(F.lower("seckey").alias("_s"), F.lower("item").alias("_i")).distinct()
    in_sec = listed.withColumn("_in_sec", F.lit(True))
    rows = rows.join(in_sec, (F.lower("key") == F.col("_s")) & (F.lower("item") == F.col("_i")) & F.col("sec").isNotNull(), "left").drop("_s", "_i")
    paper = listed.select(F.regexp_replace("_s", "_[^_]*$", "").alias("_p"), "_i").distinct()
    rows = rows.join(paper.withColumn("_in_paper", F.lit(True)), (F.lower("ref") == F.col("_p")) & (F.lower("item") == F.col("_i")), "left").drop("_p", "_i")
    rows = rows.join(paper.select(F.col("_p")).distinct().withColumn("_any", F.lit(True)), F.lower("ref") == F.col("_p"), "left").drop("_p")
    both, alone = F.col("sec").isNotNull() & F.col("item").isNotNull(), F.col("sec").isNull()
    steps = [
        (F.col("many"), "UNVERIFIED", "several_items"),
        (F.col("key").isNull(), "UNVERIFIED", "unparsed_location"),
        (F.col("source").isNull() & F.col("_low").isNull(), "UNVERIFIED", "no_such_key"),
        (F.col("source").isNull(), "NEEDS_REVIEW", "case_drift"),
        (both & F.col("_in_sec").isNull(), "UNVERIFIED", "item_not_in_section"),
        (alone & F.col("_any").isNull(), "NEEDS_REVIEW", "no_item_list"),
        (alone & F.col("_in_paper").isNull(), "UNVERIFIED", "item_not_in_paper"),
    ]
    status, reason = F.lit(None).cast("string"), F.lit(None).cast("string")
    for when, s, r in reversed(steps):
        status, reason = F.when(when, F.lit(s)).otherwise(status), F.when(when, F.lit(r)).otherwise(reason)
    return rows.withColumn("status", status).withColumn("reason", reason).drop("_k", "_l", "_low", "_in_sec", "_in_paper", "_any")


def banded(rows: DataFrame, score: str | None, review: float = 0.35, passed: float = 0.82) -> DataFrame:
    """Decides rows of null status by their score (null: nothing scored them)."""
    s = F.col(score) if score else F.lit(None).cast("double")
    decided = F.when(s.isNull(), "NEEDS_REVIEW").when(s < review, "UNVERIFIED").when(s < passed, "NEEDS_REVIEW").otherwise("PASS")
    why = F.when(s.isNull(), "no_scorer").when(s < review, "low_score").when(s < passed, "middle_score").otherwise("supported")
    return rows.withColumn("reason", F.coalesce("reason", why)).withColumn("status", F.coalesce("status", decided))


def best_chunks(claims_: DataFrame, chunks: DataFrame, score: Column, keep: int = 2) -> DataFrame:
    """For each claim (claim_id, seckey, claim) the ``keep`` chunks (seckey, ord, chunk) of its
    section with the highest ``score`` (over claim and chunk), so a costly scorer runs on
    ``keep`` pairs a claim at most."""
    pairs = claims_.join(chunks, "seckey").withColumn("coarse", F.floor(score * 1e6 + 0.5).cast("long"))
    return top(pairs, ["claim_id"], [F.desc("coarse"), F.asc("ord")], keep)


def draft_status(drafts: DataFrame, reports: DataFrame) -> DataFrame:
    """(draft_id, status, n, duplicates): DIRTY if anything is unverified, else NEEDS_REVIEW if
    anything needs it, else CLEAN; NO_CITATION without rows."""
    counts = reports.groupBy("draft_id").agg(F.count("*").alias("n"), F.bool_or(F.col("status") == "UNVERIFIED").alias("bad"), F.bool_or(F.col("status") == "NEEDS_REVIEW").alias("open"))
    twice = reports.groupBy("draft_id", "citation").agg(F.count("*").alias("k")).where("k > 1").groupBy("draft_id").agg(F.count("*").alias("duplicates"))
    rows = drafts.select("draft_id").join(counts, "draft_id", "left").join(twice, "draft_id", "left")
    status = F.when(F.col("n").isNull(), "NO_CITATION").when(F.col("bad"), "DIRTY").when(F.col("open"), "NEEDS_REVIEW").otherwise("CLEAN")
    return rows.select("draft_id", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"))


def support_words(claim: Column, most: int = 8) -> Column:
    """The claim's top keywords: by frequency, then alphabetically."""

    def first(words: Column) -> Column:
        counted = F.transform(F.array_distinct(words), lambda w: F.struct((F.size(F.array_remove(words, w)) - F.size(words)).alias("n"), w.alias("w")))
        return F.slice(F.transform(F.array_sort(counted), lambda s: s["w"]), 1, most)

    return let(keyword_tokens(claim), first)


def lexical_support(words: Column, context: Column, least: float = 0.34) -> Column:
    """Whether a third of a claim's ``support_words`` stand in the context; none: false."""

    def third(ws: Column, low: Column) -> Column:
        return (F.size(ws) > 0) & (F.size(F.filter(ws, lambda w: F.contains(low, w))) >= least * F.size(ws))

    return let(F.transform(words, F.lower), lambda ws: let(F.lower(blank(context)), lambda low: third(ws, low)))


def hits(words: list[list[str]]):
    """A function of a text: how many of each list's ``words`` stand in it, repeats counted. A word
    stands within one run of characters that words have, so a run's pieces of the words' lengths
    are looked up; what a run holds is remembered."""
    owners: dict[str, list[int]] = {}
    for i, ws in enumerate(words):
        for w in ws:
            owners.setdefault(w, []).append(i)
    always = np.bincount(owners.pop("", []), minlength=len(words))
    held = {w: np.array(at) for w, at in owners.items()}
    sizes = sorted({len(w) for w in held})
    run = re.compile("[" + "".join(map(re.escape, sorted(set("".join(held))))) + "]+") if held else None
    seen: dict[str, tuple[str, ...]] = {}

    def pieces(r: str) -> tuple[str, ...]:
        found = seen.get(r)
        if found is None:
            found = tuple({r[k : k + n] for n in sizes for k in range(len(r) - n + 1)} & held.keys())
            if len(r) <= 64 and len(seen) < 1 << 18:
                seen[r] = found
        return found

    def count(text: str) -> np.ndarray:
        found = {w for r in set(run.findall(text)) for w in pieces(r)} if run else ()
        return always + np.bincount(np.concatenate([held[w] for w in found]), minlength=len(words)) if found else always

    return count


def supported(docs: DataFrame, claims_: DataFrame, most: int = 100_000, least: float = 0.34) -> DataFrame:
    """(item_id, doc_id, supported) of every claim (item_id, words) against every document
    (doc_id, context): claims are a stated set and are held against the table in blocks. Each
    text is read once for a block, not once for a claim."""
    low = docs.select("doc_id", F.lower(blank(F.col("context"))).alias("low"))
    lower = claims_.select("item_id", F.transform("words", F.lower).alias("words"))
    kinds = {f.name: f for f in [*claims_.select("item_id").schema, *docs.select("doc_id").schema]}
    schema = T.StructType([kinds["item_id"], kinds["doc_id"], T.StructField("supported", T.BooleanType())])

    def held(block: DataFrame) -> DataFrame:
        rows = block.toArrow()
        items, words = rows["item_id"].combine_chunks(), [ws or [] for ws in rows["words"].to_pylist()]
        sizes = np.array([len(ws) for ws in words], np.int64)
        shared = docs.sparkSession.sparkContext.broadcast((items, words))

        def run(batches):
            items, words = shared.value
            count, each = hits(words), max(1, (1 << 16) // max(1, len(words)))
            for batch in batches:
                for at in range(0, batch.num_rows, each):
                    part = batch.slice(at, each)
                    n = np.array([count(t) for t in part.column(1).to_pylist()], np.int64).reshape(-1, len(words))
                    of = np.repeat(np.arange(len(n)), len(words))
                    yield pa.RecordBatch.from_arrays([items.take(pa.array(np.tile(np.arange(len(words)), len(n)))), part.column(0).take(pa.array(of)), pa.array(((sizes > 0) & (n >= least * sizes)).ravel())], schema.names)

        return low.mapInArrow(run, schema)

    out, *others = [held(b) for b in blocks(lower, most)]
    for more in others:
        out = out.unionByName(more)
    return out


def quotes_hold(quotes: DataFrame, evidence: DataFrame, shortest: int = 12) -> DataFrame:
    """(verdict_id, valid): every quote (verdict_id, evidence_id, quote) has ``shortest``
    characters and stands word for word in the evidence it names."""
    rows = quotes.join(evidence.select("evidence_id", F.col("text").alias("_t")), "evidence_id", "left")
    fine = (F.length("quote") >= shortest) & F.coalesce(F.contains(F.col("_t"), F.col("quote")), F.lit(False))
    return rows.groupBy("verdict_id").agg(F.bool_and(F.coalesce(fine, F.lit(False))).alias("valid"))


def reviewed(verdicts: DataFrame, judges: int = 2) -> DataFrame:
    """(note_id, result): two judges that agree, with a valid quote of the primary source."""
    g = verdicts.groupBy("note_id").agg(F.count("*").alias("n"), F.countDistinct("verdict").alias("k"), F.min("verdict").alias("v"), F.bool_or("primary").alias("p"), F.bool_and("valid").alias("ok"))
    return g.select("note_id", F.when((F.col("n") >= judges) & (F.col("k") == 1) & F.col("p") & F.col("ok"), F.col("v")).otherwise(F.lit("undecided")).alias("result"))
