"""Entities and relations: aliases, generic names, merging, rule extraction, contradictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperlake.functions.text import blank, dedup_key, mentions, sentences
from paperlake.operators import similar
from paperlake.operators.common import small, top

# fixed values: what a graph may hold, names that say nothing, and aliases
ENTITY_TYPES = ["Algorithm/Model", "Dataset/Benchmark", "Evaluation Metric", "Theoretical Component", "Problem/Task", "Limitation/Artifact"]
RELATION_TYPES = ["Improves_Upon", "Evaluated_On", "Contradicts", "Vulnerable_To", "Requires"]
GENERIC = ["model", "data", "performance", "accuracy", "algorithm", "method", "result", "paper", "experiment", "dataset", "metric"]
GENERIC_CONCEPTS = ["algorithm", "model", "models", "method", "methods", "methodology", "evaluation", "metric", "metrics", "dataset", "datasets", "benchmark", "paper", "result", "results", "approach", "table", "figure", "fig", "baseline", "performance", "accuracy", "experiment", "experiments", "study", "work", "analysis", "data", "training", "test", "task", "问题", "方法", "模型", "结果", "评估", "指标", "数据", "实验", "分析"]
ALIASES = {"flashattention 2": "FlashAttention-v2", "flashattention-2": "FlashAttention-v2", "imagenet1k": "ImageNet-1k", "imagenet-1k": "ImageNet-1k", "bleu4": "BLEU-4", "bleu-4": "BLEU-4"}
# fixed values: names that rules look for, with their types
TRIGGERS = [("FlashAttention-v2", "Algorithm/Model"), ("Transformer", "Algorithm/Model"), ("HumanEval", "Dataset/Benchmark"), ("ImageNet-1k", "Dataset/Benchmark"), ("BLEU-4", "Evaluation Metric"), ("Latency", "Evaluation Metric"), ("Cross-Entropy with Label Smoothing", "Theoretical Component"), ("Long-sequence Hallucination", "Problem/Task"), ("Quadratic Memory Footprint", "Limitation/Artifact"), ("DBSCAN", "Algorithm/Model"), ("Monte Carlo", "Algorithm/Model"), ("Geant4", "Algorithm/Model"), ("DNA damage", "Problem/Task"), ("LET", "Evaluation Metric"), ("RBE", "Evaluation Metric"), ("Microdosimetry", "Theoretical Component"), ("Bragg peak", "Theoretical Component"), ("FLASH", "Problem/Task"), ("Beam Quality", "Evaluation Metric")]
# fixed values: what hints at a relation, the first that matches counts
HINTS = [("Improves_Upon", "improv|outperform|优于|提升"), ("Evaluated_On", "evaluat|benchmark|在.*上评估|实验"), ("Contradicts", "contradict|conflict|矛盾|不一致"), ("Vulnerable_To", "vulnerable|fail|limitation|局限|失效"), ("Requires", "requir|depend|需要|依赖")]


def alias_table(spark: SparkSession, policy: dict[str, str] | None = None, call: dict[str, str] | None = None) -> DataFrame:
    """(alias, canonical): those of the call before those of the policy before the seed."""
    found = {**ALIASES, **{k.strip().lower(): v.strip() for k, v in (policy or {}).items()}, **{k.strip().lower(): v.strip() for k, v in (call or {}).items()}}
    return spark.createDataFrame(sorted(found.items()), "alias string, canonical string")


def resolve(df: DataFrame, aliases: DataFrame, name: str, out: str) -> DataFrame:
    """Adds ``out``: the canonical name, one step; else the trimmed name."""
    a = small(aliases.select(F.col("alias").alias("_a"), F.col("canonical").alias("_c")))
    return df.join(a, F.lower(F.trim(name)) == F.col("_a"), "left").withColumn(out, F.coalesce("_c", F.trim(name))).drop("_a", "_c")


def sanitize_entities(items: DataFrame, aliases: DataFrame, generic: list[str] = GENERIC) -> DataFrame:
    """(batch, ord, name, type, canonical, verdict) of items (batch, ord, name, type): verdict
    is kept, merged (an earlier one has the same letters and digits), generic or schema."""
    rows = resolve(items, aliases, "name", "canonical").withColumn("canonical", F.regexp_replace("canonical", r"\s+", " "))
    bad = F.when(~F.coalesce(F.col("type").isin(ENTITY_TYPES), F.lit(False)), "schema").when(F.lower("canonical").isin(generic), "generic")
    rows = rows.withColumn("_bad", bad).withColumn("_key", dedup_key(F.col("canonical")))
    ranked = top(rows, ["batch", "_bad", "_key"], [F.asc("ord")], 1 << 30, "_n")
    verdict = F.coalesce("_bad", F.when(F.col("_n") > 1, "merged").otherwise("kept"))
    return ranked.select("batch", "ord", "name", "type", "canonical", verdict.alias("verdict"))


def merge_similar(kept: DataFrame, least: float = 0.85) -> DataFrame:
    """Greedy merging by word similarity in order: each name joins the first kept one that is
    ``least`` similar: (batch, ord, canonical, into). See ``similar.merged``."""
    return similar.merged(kept.select("batch", "ord", "canonical"), least)


def sanitize_relations(relations: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(batch, src, rel, dst, ev) of relations (batch, ord, src, rel, dst, ev): allowed kinds
    between kept entities of the batch, by their letters and digits; the first of equals."""
    names = entities.where("verdict = 'kept'").select(F.col("batch").alias("_b"), dedup_key(F.col("canonical")).alias("_k"), F.col("canonical").alias("_n"))
    rows = resolve(resolve(relations.where(F.col("rel").isin(RELATION_TYPES)), aliases, "src", "_src"), aliases, "dst", "_dst")
    for end in ("src", "dst"):
        side = names.select(*[F.col(c).alias(f"{c}_{end}") for c in names.columns])
        rows = rows.join(side, (F.col("batch") == F.col(f"_b_{end}")) & (dedup_key(F.col(f"_{end}")) == F.col(f"_k_{end}")))
    rows = rows.select("batch", "ord", F.col("_n_src").alias("src"), "rel", F.col("_n_dst").alias("dst"), F.left("ev", F.lit(160)).alias("ev"))
    return top(rows, ["batch", "src", "rel", "dst"], [F.asc("ord")], 1, "_r").drop("_r", "ord")


def rule_entities(docs: DataFrame, key: str, text: str = "text", names: list[tuple[str, str]] = TRIGGERS) -> DataFrame:
    """(key, ord, name, type) of the trigger names that a text has."""
    low = F.filter(F.array(*[F.when(mentions(F.col(text), F.lit(n)), F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(t).alias("type"))) for i, (n, t) in enumerate(names)]), lambda x: x.isNotNull())
    return docs.select(key, F.explode(low).alias("e")).select(key, "e.ord", "e.name", "e.type")


def rule_relations(docs: DataFrame, key: str, text: str = "text", most: int = 12, names: list[tuple[str, str]] = TRIGGERS, hints: list[tuple[str, str]] = HINTS) -> DataFrame:
    """(key, src, rel, dst, ev): pairs of trigger names in one sentence that hints at a
    relation, in order of sentences and names. A text's search stops after the first name with
    which it has ``most`` pairs, repeats counted; each pair is given once."""
    rows = docs.select(key, F.posexplode(sentences(F.col(text))).alias("no", "s"))
    rel = F.coalesce(*[F.when(F.col("s").rlike(f"(?iu){p}"), F.lit(r)) for r, p in hints])
    rows = rows.withColumn("rel", rel).where("rel is not null")
    found = rule_entities(rows.select(F.struct(key, "no", "s", "rel").alias("k"), F.col("s").alias("t")), "k", "t", names)
    pairs = found.alias("a").join(found.alias("b"), (F.col("a.k") == F.col("b.k")) & (F.col("a.ord") != F.col("b.ord")))
    rows = pairs.select(F.col(f"a.k.{key}").alias(key), F.col("a.k.no").alias("no"), F.col("a.ord").alias("i"), F.col("b.ord").alias("j"), F.col("a.name").alias("src"), F.col("a.k.rel").alias("rel"), F.col("b.name").alias("dst"), F.left(F.col("a.k.s"), F.lit(160)).alias("ev"))
    order = [F.asc("no"), F.asc("i"), F.asc("j")]
    raw = top(rows, [key], order, most + len(names), "_n")
    begun = raw.withColumn("_first", F.min("_n").over(Window.partitionBy(key, "no", "i"))).where(F.col("_first") <= most)
    first = top(begun, [key, "src", "rel", "dst"], order, 1, "_d")
    return top(first, [key], [F.asc("no"), F.asc("i"), F.asc("j")], most, "_r").select(key, "src", "rel", "dst", "ev")


def contradictions(drafts: DataFrame, relations: DataFrame) -> DataFrame:
    """(draft_id, src, dst) of the contradicting relations whose both ends a draft mentions.
    ``relations`` are those of a policy or paper: a stated list, held against each draft."""
    rel = small(relations.where("rel = 'Contradicts'").select("src", "dst").distinct())
    return drafts.join(rel, mentions(blank(F.col("text")), F.col("src")) & mentions(blank(F.col("text")), F.col("dst"))).select("draft_id", "src", "dst")


def concepts(words: DataFrame, memory: DataFrame, aliases: DataFrame, most: int = 18, paper: str = "paper_id") -> DataFrame:
    """(paper, concept, weight): keywords count 1, remembered entities 3; aliases resolved,
    generic names dropped, the ``most`` heaviest (then alphabetically)."""
    both = words.select(paper, "term", F.lit(1.0).alias("w")).unionByName(memory.select(paper, "term", F.lit(3.0).alias("w")))
    # repeats are summed before names are resolved and again after
    both = resolve(both.groupBy(paper, "term").agg(F.sum("w").alias("w")), aliases, "term", "concept")
    low = F.lower(F.trim("concept"))
    kept = both.where((F.length(low) >= 2) & ~low.isin([*GENERIC, *GENERIC_CONCEPTS])).groupBy(paper, "concept").agg(F.sum("w").alias("weight"))
    return top(kept, [paper], [F.desc("weight"), F.asc("concept")], most).select(paper, "rank", "concept", "weight")


def policy_state(policies: DataFrame, as_of: str, days: int = 7, schema_name: str = "graph-policy-v1") -> DataFrame:
    """(schema, valid, review_due) of policies (schema, reviewed_at, aliases MAP, blacklist)."""
    valid = (F.col("schema") == schema_name) & F.col("aliases").isNotNull() & F.forall(F.map_values("aliases"), lambda v: F.trim(v) != "") & F.col("blacklist").isNotNull() & F.forall("blacklist", lambda v: F.trim(v) != "")
    age = (F.to_timestamp(F.lit(as_of)).cast("double") - F.try_to_timestamp("reviewed_at").cast("double")) / 86400.0
    return policies.select("schema", F.coalesce(valid, F.lit(False)).alias("valid"), (~F.coalesce(valid, F.lit(False)) | age.isNull() | (age < 0) | (age > days)).alias("review_due"))
