"""The life of notes: building, deciding, invalidating, deleting, reflecting, linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.functions.text import mentions
from paperlake.operators.common import top
from paperlake.operators.memory import LINKS, STATUSES, retrievable
from paperlake.operators.verify import lexical_support, support_words

# fixed values: the heading that makes no note, the mark of generated notes, the tags that
# show evidence, kinds that no reflection rests on, and the paper of field reflections
NO_NOTE = "一句话主张"
GENERATED = "system:generated"
REFLECTIONS = ["entity", "反思", "领域反思", "reflection"]
FIELD = "__field__"


def markdown_sections(docs: DataFrame, key: str, text: str = "md") -> DataFrame:
    """(key, no, title, body) of the ``## `` blocks of a text, in order; what stands before the
    first one has no title and is left out. Null texts have none."""
    blocks = F.split(F.col(text), r"(?m)^##\s+")
    rows = docs.select(key, F.posexplode(F.slice(blocks, 2, 1 << 20)).alias("no", "b"))
    head = F.substring_index("b", "\n", 1)
    return rows.select(key, "no", F.trim(head).alias("title"), F.btrim(F.substr("b", F.length(head) + 2), F.lit(" \n\t\r")).alias("body"))


def reading_notes(docs: DataFrame, claims: DataFrame, entities: DataFrame, most: int = 900) -> DataFrame:
    """(paper_id, ord, kind, content, source, artefact) of ``docs`` (paper_id, md), argument-map
    ``claims`` (paper_id, no, claim, evidence, limitation) and ``entities`` (paper_id, no, name,
    type): blocks, then claims, then entities. Empty blocks and names make no note."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    blocks = markdown_sections(docs, "paper_id").where((F.col("title") != "") & (F.col("body") != "") & (F.col("title") != NO_NOTE))
    blocks = blocks.select("paper_id", F.struct(F.lit(0).alias("part"), "no").alias("ord"), F.col("title").alias("kind"), F.left("body", F.lit(most)).alias("content"), F.col("title").alias("source"), F.lit("brief").alias("artefact"), F.lit(None).cast("string").alias("name"))
    arguments = claims.where(text("claim") != "").select("paper_id", F.struct(F.lit(1).alias("part"), "no").alias("ord"), F.lit("claim").alias("kind"), F.concat(F.col("claim"), F.lit(" | 证据: "), text("evidence"), F.lit(" | 局限: "), text("limitation")).alias("content"), F.lit("argument_map").alias("source"), F.lit("full").alias("artefact"), F.lit(None).cast("string").alias("name"))
    named = entities.where(text("name") != "").select("paper_id", F.struct(F.lit(2).alias("part"), "no").alias("ord"), F.lit("entity").alias("kind"), F.concat(F.col("name"), F.lit("（"), text("type"), F.lit("）")).alias("content"), F.lit("entity").alias("source"), F.lit(None).cast("string").alias("artefact"), F.col("name"))
    return blocks.unionByName(arguments).unionByName(named)


def judged(notes: DataFrame, artefacts: DataFrame, sources: DataFrame, policy_current: bool, task: str) -> DataFrame:
    """Adds status and tags to ``reading_notes``. A claim is active if the paper's text
    supports it and its artefact (paper_id, artefact, state) is CLEAN; an entity if the policy
    is current and the text mentions it; all others are candidates."""
    rows = notes.join(artefacts, ["paper_id", "artefact"], "left").join(sources.select("paper_id", F.col("text").alias("_t")), "paper_id", "left")
    state, source = F.coalesce("state", F.lit("MISSING")), F.coalesce("_t", F.lit(""))
    entity = F.col("kind") == "entity"
    bound = mentions(source, F.coalesce("name", F.lit("")))
    active = F.when(entity, bound & F.lit(policy_current)).otherwise(lexical_support(support_words(F.col("content")), source) & (state == "CLEAN"))
    tags = F.when(entity, F.array(F.lit(f"graph-policy:{'CURRENT' if policy_current else 'REVIEW_DUE'}"), F.concat(F.lit("source-bound:"), bound.cast("string")))).otherwise(F.array(F.concat(F.lit("artifact:"), "artefact"), F.concat(F.lit("artifact-status:"), state)))
    return rows.withColumn("status", F.when(active, "active").otherwise("candidate")).withColumn("tags", F.concat(tags, F.array(F.lit(GENERATED), F.lit(f"task:{task}")))).drop("_t", "state", "name")


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` notes without the generated ones of a (paper_id, task) that ``new`` brings, and
    ``new``: a run that brings nothing for a paper keeps what was there."""
    mine = new.select("paper_id", "task").distinct()
    generated = F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), GENERATED)
    stays = old.where(~generated).unionByName(old.where(generated).join(mine, ["paper_id", "task"], "left_anti").select(*old.columns))
    return stays.unionByName(new.select(*old.columns))


def verdicts(claims: DataFrame, said: DataFrame, fallback: str = "supported") -> DataFrame:
    """(batch, i, ok): of claims (batch, i from 0, fallback) by a model's verdicts (batch, i,
    ok). These count if they name all claims of a batch from 0 on, or all from 1 on; else the
    whole batch goes by ``fallback``. Of repeated verdicts the last one (column no) counts."""
    last = said.groupBy("batch", "i").agg(F.max_by("ok", "no").alias("ok"))
    at = lambda shift, name: last.select("batch", (F.col("i") - shift).alias("i"), F.col("ok").alias(name))
    rows = claims.join(at(0, "ok0"), ["batch", "i"], "left").join(at(1, "ok1"), ["batch", "i"], "left")
    whole = lambda c: F.bool_and(F.col(c).isNotNull()).over(Window.partitionBy("batch"))
    return rows.select("batch", "i", F.when(whole("ok0"), F.col("ok0")).when(whole("ok1"), F.col("ok1")).otherwise(F.col(fallback)).alias("ok"))


def decided(notes: DataFrame, decisions: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes after decisions (id, no, status), the last of each note, and the vectors that are
    left: those of notes that can still be found. Other words than statuses are no decision."""
    last = decisions.where(F.col("status").isin(STATUSES)).groupBy("id").agg(F.max_by("status", "no").alias("_s"))
    rows = notes.join(last, "id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")
    gone = rows.where(~retrievable()).select(F.col("id").alias("owner_id"))
    return rows, vectors.join(gone, "owner_id", "left_anti")


def invalidated(notes: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Notes with ``invalid_at`` set for ``ids`` (id); a time that is set stays."""
    marked = ids.select("id").distinct().withColumn("_x", F.lit(True))
    return notes.join(marked, "id", "left").withColumn("invalid_at", F.when(F.col("_x") & F.col("invalid_at").isNull(), at).otherwise(F.col("invalid_at"))).drop("_x")


def purged(notes: DataFrame, note_links: DataFrame, vectors: DataFrame, dead: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the ``dead`` notes (id), their typed links and vectors, and
    without them in other notes' ``links``, which keep their order."""
    ids = dead.select("id").distinct()
    left = notes.join(ids, "id", "left_anti")
    pairs = left.select("id", F.posexplode("links").alias("_pos", "_dst"))
    stays = pairs.join(ids.select(F.col("id").alias("_dst")), "_dst", "left_anti").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_dst"))), lambda s: s["_dst"]).alias("_l"))
    cleaned = left.join(stays, "id", "left").withColumn("links", F.when(F.col("links").isNull(), F.col("links")).otherwise(F.coalesce("_l", F.array().cast(notes.schema["links"].dataType)))).drop("_l")
    end = lambda c: ids.select(F.col("id").alias(c))
    return cleaned.select(*notes.columns), note_links.join(end("src"), "src", "left_anti").join(end("dst"), "dst", "left_anti").select(*note_links.columns), vectors.join(end("owner_id"), "owner_id", "left_anti").select(*vectors.columns)


def reflection_input(notes: DataFrame, imp: Column, rec: Column, most: int = 12, least: int = 4, field: bool = False) -> DataFrame:
    """(scope, rank, id): what a reflection on each paper, or on the ``field``, rests on: the
    ``most`` notes of the highest importance times recency. Papers of under ``least`` of them,
    and a field of under two papers, have no reflection."""
    rows = notes.where(retrievable() & ~F.col("kind").isin(REFLECTIONS)).withColumn("heat", F.floor(imp * rec * 1e6 + 0.5).cast("long"))
    rows = rows.withColumn("scope", F.lit(FIELD) if field else F.col("paper_id").cast("string"))
    best = top(rows, ["scope"], [F.desc("heat"), F.asc("id")], most).select("scope", "rank", "id", "paper_id")
    own = F.when(F.col("paper_id").cast("string") != FIELD, F.col("paper_id"))
    enough = best.groupBy("scope").agg(F.count("*").alias("_n"), F.countDistinct(own).alias("_p")).where((F.col("_n") >= least) & (F.col("_p") >= (2 if field else 0)))
    return best.join(enough, "scope", "left_semi").select("scope", "rank", "id")


def insights(found: DataFrame, inputs: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes (scope, no, content, status) of a model's insights (scope, no, insight, evidence
    ids) and their ``supports`` links (scope, no, dst). Evidence counts if it is among the
    scope's ``inputs``; an insight is active if its evidence supports it, else a candidate."""
    rows = found.where(F.trim(F.coalesce("insight", F.lit(""))) != "").select("scope", "no", F.left(F.trim("insight"), F.lit(1200)).alias("content"), "evidence")
    cited = rows.select("scope", "no", F.posexplode(F.array_distinct("evidence")).alias("pos", "id")).join(inputs.select("scope", "id"), ["scope", "id"], "left_semi")
    texts = cited.join(notes.select("id", F.left("content", F.lit(300)).alias("t")), "id").groupBy("scope", "no").agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"]), "\n"), F.lit(3000)).alias("_e"))
    rows = rows.join(texts, ["scope", "no"], "left")
    good = F.col("_e").isNotNull() & lexical_support(support_words(F.col("content")), F.coalesce("_e", F.lit("")))
    return rows.select("scope", "no", "content", F.when(good, "active").otherwise("candidate").alias("status")), cited.select("scope", "no", F.col("id").alias("dst"))


def contested(notes: DataFrame, claims: DataFrame, hits: DataFrame) -> DataFrame:
    """(note_id, status): what a claim (claim_id, claim, stance, verified) does to notes. A
    contradicting and verified one is contested together with the note it meets (``conflicts``
    over ``hits``); other verified ones are active, the rest candidates."""
    met = conflicts(claims, hits, notes)
    rows = claims.join(met, "claim_id", "left")
    clash = (F.col("stance") == "contradicts") & F.col("verified") & F.col("id").isNotNull()
    own = rows.select(F.col("claim_id").alias("note_id"), F.when(clash, "contested").when(F.col("verified"), "active").otherwise("candidate").alias("status"))
    return own.unionByName(rows.where(clash).select(F.col("id").alias("note_id"), F.lit("contested").alias("status"))).distinct()


def conflicts(claims: DataFrame, hits: DataFrame, notes: DataFrame, within: int = 8) -> DataFrame:
    """(claim_id, id): the first of a claim's hits (claim_id, rank, id) that is no entity and
    doesn't say the same to the letter."""
    rows = hits.where(F.col("rank") <= within).join(notes.select("id", "kind", "content"), "id").join(claims.select("claim_id", "claim"), "claim_id")
    rows = rows.where((F.col("kind") != "entity") & (F.trim("content") != F.trim("claim")))
    return rows.groupBy("claim_id").agg(F.min_by("id", F.struct("rank", "id")).alias("id"))


def typed_links(asked: DataFrame, notes: DataFrame) -> DataFrame:
    """(src, dst, rel) of links (src, dst, rel) between notes that exist; an unknown relation
    counts as ``extends``, a note has no link to itself, a link stands once."""
    end = lambda c: notes.select(F.col("id").alias(c))
    rel = F.when(F.col("rel").isin(LINKS), F.col("rel")).otherwise(F.lit("extends"))
    return asked.where("src <> dst").join(end("src"), "src", "left_semi").join(end("dst"), "dst", "left_semi").select("src", "dst", rel.alias("rel")).distinct()


def quarantined(notes: DataFrame) -> DataFrame:
    """Active notes without a tag that shows their evidence become candidates; notes by people,
    which aren't marked as generated, stay."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    shown = F.exists(tags, lambda t: t.startswith("artifact-status:") | t.startswith("source-bound:"))
    return notes.withColumn("status", F.when((F.coalesce("status", F.lit("active")) == "active") & F.array_contains(tags, GENERATED) & ~shown, "candidate").otherwise(F.col("status")))


def listing(notes: DataFrame, by: list[str], most: int = 100) -> DataFrame:
    """(by..., n, ids): how many notes each group has, and the ids of its ``most`` newest."""
    n = notes.groupBy(*by).agg(F.count("*").alias("n"))
    newest = top(notes, by, [F.desc("created_at"), F.desc("id")], most).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda s: s["id"]).alias("ids"))
    return n.join(newest, by)


def pending(notes: DataFrame, kind: str = "candidate", most: int = 100) -> DataFrame:
    """The newest notes of a status, for people to decide on."""
    return notes.where(F.col("status") == kind).orderBy(F.desc("created_at"), F.desc("id")).limit(most)
