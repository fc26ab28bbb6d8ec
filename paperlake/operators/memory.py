"""Note memory: retrievability, status, consolidation, clean-up, statistics, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.functions.text import blank, clean, keyword_tokens
from paperlake.operators.common import top

STATUSES = ["active", "candidate", "contested", "rejected", "superseded"]
LINKS = ["supports", "contradicts", "extends"]


def retrievable() -> Column:
    return F.coalesce("status", F.lit("active")).isin("active", "contested") & F.col("invalid_at").isNull()


def trusted() -> Column:
    """What answers may rest on: contested notes are found but not trusted."""
    return (F.col("status") == "active") & F.col("invalid_at").isNull()


def upsert(old: DataFrame, new: DataFrame, keys: list[str], newest: str = "created_at") -> DataFrame:
    """Rows of both, the newest of each key; of equally new ones those of ``new``."""
    both = old.withColumn("_old", F.lit(1)).unionByName(new.withColumn("_old", F.lit(0)))
    return top(both, keys, [F.desc(newest), F.asc("_old"), F.asc(F.xxhash64(*old.columns))], 1, "_n").drop("_old", "_n")


def entries(memories: DataFrame, paper: str, task: str | None = None) -> DataFrame:
    """A paper's entries, of one task if given, the newest first."""
    rows = memories.where(F.col("paper_id") == paper)
    return (rows if task is None else rows.where(F.col("task") == task)).orderBy(F.desc("created_at"), F.xxhash64(*memories.columns))


def known_concepts(concepts: DataFrame, most: int = 40) -> DataFrame:
    """Up to ``most`` different concepts, in order."""
    return concepts.select("concept").where("concept IS NOT NULL").distinct().orderBy("concept").limit(most)


def keywords(docs: DataFrame, key: str, text: str = "text", most: int = 12) -> DataFrame:
    """(key, rank, term, n): the most frequent words, then alphabetically."""
    counted = docs.select(key, F.explode(keyword_tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))
    return top(counted, [key], [F.desc("n"), F.asc("term")], most).select(key, "rank", "term", "n")


def notes_of(rows: DataFrame) -> DataFrame:
    """Notes (id, paper_id, kind, content, keywords) of rows (id, paper_id, kind, content):
    cleaned, 1200 characters at most; under 6 characters they go."""
    rows = rows.withColumn("content", F.left(clean(blank(F.col("content"))), F.lit(1200))).where(F.length("content") >= 6)
    words = keywords(rows, "id", "content").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("keywords"))
    return rows.join(words, "id", "left").select("id", "paper_id", "kind", "content", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), F.left("content", F.lit(120)).alias("context"))


def latest_status(events: DataFrame, key: str = "id", status: str = "status", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """(key, status, ts) of the last event of each key."""
    last = F.max_by(F.struct(status, ts), F.struct(ts, tie))
    return events.groupBy(key).agg(last.alias("x")).select(key, f"x.{status}", f"x.{ts}")


def consolidated(notes: DataFrame) -> DataFrame:
    """(id, kept): notes with the same paper, kind and first 160 characters of content are kept
    as the smallest id. Grouped, so that copies meet before the shuffle."""
    sign = [F.coalesce("paper_id", F.lit("")).alias("p"), F.coalesce("kind", F.lit("")).alias("k"), F.sha2(F.left(blank(F.col("content")), F.lit(160)), 256).alias("h")]
    rows = notes.select("id", *sign)
    first = rows.groupBy("p", "k", "h").agg(F.min("id").alias("kept"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, ["p", "k", "h"]).select("id", "kept")


def orphans(children: DataFrame, key: str, parents: DataFrame, parent: str) -> DataFrame:
    """Rows of ``children`` of which the key is in no row of ``parents``; null keys are
    orphans too."""
    return children.join(parents.select(F.col(parent).alias("_p")).distinct(), F.col(key) == F.col("_p"), "left_anti")


def collect_garbage(notes: DataFrame, note_links: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Live notes' links, typed links and vectors, and one row of counts of what went."""
    alive = notes.select("id").distinct()
    pairs = notes.select("id", F.posexplode("links").alias("pos", "dst"))
    good = pairs.join(alive.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda s: s["dst"]).alias("_l"))
    cleaned = notes.join(good, "id", "left").withColumn("links", F.coalesce("_l", F.array().cast(notes.schema["links"].dataType))).drop("_l")
    typed = note_links.join(alive.select(F.col("id").alias("src")), "src", "left_semi").join(alive.select(F.col("id").alias("dst")), "dst", "left_semi")
    owned = vectors.join(alive.select(F.col("id").alias("owner_id")), "owner_id", "left_semi")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    lost = n(pairs, "a").crossJoin(n(cleaned.select(F.explode("links")), "b")).crossJoin(n(note_links, "c")).crossJoin(n(typed, "d")).crossJoin(n(vectors, "e")).crossJoin(n(owned, "f"))
    return cleaned, typed, owned, lost.select((F.col("a") - F.col("b")).alias("links"), (F.col("c") - F.col("d")).alias("note_links"), (F.col("e") - F.col("f")).alias("vectors"))


def statistics(notes: DataFrame, paper: str = "paper_id") -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return notes.agg(F.count("*").alias("notes"), F.countDistinct(paper).alias("papers"), *[count(s) for s in STATUSES])


def due_for_review(notes: DataFrame, reviews: DataFrame, as_of: Column, hours: int = 24, limit: int = 8) -> DataFrame:
    """Candidates and contested notes not reviewed within ``hours``, the first by id."""
    recent = reviews.where(F.col("reviewed") > as_of - hours * 3600.0).select(F.col("note_id").alias("id"))
    return notes.where(F.col("status").isin("candidate", "contested")).join(recent, "id", "left_anti").orderBy("id").limit(limit)


def applied(notes: DataFrame, decisions: DataFrame) -> DataFrame:
    """Compare and set: a decision (id, content, old_status, new_status) counts only if the
    note is still as it was judged."""
    d = decisions.select("id", F.col("content").alias("_c"), F.col("old_status").alias("_o"), F.col("new_status").alias("_n"))
    rows = notes.join(d, "id", "left")
    fits = F.col("_c").eqNullSafe(F.col("content")) & F.col("_o").eqNullSafe(F.col("status")) & F.col("_n").isin(STATUSES)
    return rows.withColumn("status", F.when(fits, F.col("_n")).otherwise(F.col("status"))).drop("_c", "_o", "_n")


def reflection_candidates(notes: DataFrame, imp: Column, rec: Column, most: int = 12) -> DataFrame:
    rows = notes.where(retrievable() & ~F.col("kind").isin("reflection", "entity", "反思"))
    return rows.withColumn("heat", F.floor(imp * rec * 1e6 + 0.5).cast("long")).orderBy(F.desc("heat"), "id").limit(most)


def touched(events: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, last_access, access_count) of access events."""
    return events.groupBy(key).agg(F.max(ts).alias("last_access"), F.count("*").alias("access_count"))


def search(notes: DataFrame, text: str, limit: int = 80) -> DataFrame:
    """Notes with ``text`` in content, keywords, tags or source in any ASCII case, newest first;
    an empty text finds all. Percent signs and underscores are wild cards."""
    like = F.lit(False)
    for c in ("content", "source", "kind"):
        like = like | F.col(c).ilike(f"%{text}%")
    for c in ("keywords", "tags"):
        like = like | F.exists(c, lambda w: w.ilike(f"%{text}%"))
    return notes.where(retrievable() & F.coalesce(like, F.lit(False))).orderBy(F.desc("created_at"), "id").limit(limit)
