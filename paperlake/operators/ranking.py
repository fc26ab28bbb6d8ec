"""Fusion, scoring and diversity of ranked lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperlake.operators.common import micro, top

# fixed values: kinds of notes that carry much, and some, weight
HIGH_KINDS = ["一句话结论", "核心洞见", "claim", "质疑", "局限", "反思", "reflection"]
MIDDLE_KINDS = ["追问", "证据", "方法", "可复现", "假设", "Gap", "空白"]


def rrf(lists: DataFrame, query: str, key: str, c: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ``lists`` (query, key, rank from 1, weight): (query, key, rrf)."""
    return lists.groupBy(query, key).agg(F.sum(F.col("weight") / (c + F.col("rank"))).alias("rrf"))


def minmax(df: DataFrame, query: str, score: str, name: str) -> DataFrame:
    """Scores of each query moved to 0..1; a span of zero counts as one."""
    w = Window.partitionBy(query)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(name, (F.col(score) - low) / F.when(high > low, high - low).otherwise(F.lit(1.0)))


def importance(kind: Column, content: Column) -> Column:
    has = lambda names: kind.rlike("|".join(names))
    base = F.when(has(HIGH_KINDS), 0.9).when(has(MIDDLE_KINDS), 0.7).when(kind.contains("实体") | F.lower(F.trim(kind)).isin("entity", "note"), 0.3).otherwise(0.55)
    return F.round(F.when(F.coalesce(content, F.lit("")).rlike(r"\d"), F.least(F.lit(1.0), base + 0.05)).otherwise(base), 3)


def recency(last_access: Column, created_at: Column, as_of: Column, half_life_h: float = 168.0) -> Column:
    """0.5 to the age in half lives, four digits; times are epoch seconds, a stored 0 counts as none."""
    seen = F.coalesce(F.nullif(last_access, F.lit(0.0)), F.nullif(created_at, F.lit(0.0)), as_of)
    return F.round(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), (as_of - seen) / 3600.0) / half_life_h), 4)


def boost(hits: Column) -> Column:
    """1 to 1.2 by the number of preferred terms found."""
    return 1 + 0.2 * F.least(F.lit(1.0), hits / 2.0)


def final_score(relevance: Column, imp: Column, rec: Column, boosted: Column | float = 1.0, rest: Column | float = 1.0) -> Column:
    return (0.80 * relevance + rest * (0.12 * imp + 0.08 * rec)) * boosted


def hybrid(lexical: DataFrame, semantic: DataFrame, notes: DataFrame, query: str, key: str, limit: int = 80) -> DataFrame:
    """Fuses two ranked lists. ``lexical``: (query, key, rank, trust of the query); ``semantic``:
    (query, key, rank). Trust under .5 keeps 12 of each list, else max(limit, 40); vectors
    weigh 1 - trust (two digits) if that is over .05. ``notes``: (key, imp, rec, hits); what
    doesn't come from relevance counts by trust, and so does the lift of preferred terms."""
    pool = max(limit, 40)
    room = F.when(F.col("trust") < 0.5, 12).otherwise(pool)
    trusts = lexical.select(query, "trust").distinct()
    a = lexical.where(F.col("rank") <= room).select(query, key, "rank", F.lit(1.0).alias("weight"))
    b = semantic.join(trusts, query, "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("weight", F.bround(1 - F.col("trust"), 2))
    b = b.where((F.col("rank") <= room) & (F.col("weight") > 0.05)).select(query, key, "rank", "weight")
    fused = minmax(rrf(a.unionByName(b), query, key).withColumn("rrf", F.round("rrf", 12)), query, "rrf", "rel")
    joined = fused.join(notes, key).join(trusts, query, "left").withColumn("trust", F.coalesce("trust", F.lit(0.0)))
    lifted = 1 + (boost(F.col("hits")) - 1) * F.col("trust")
    scored = joined.withColumn("score_micro", micro(final_score(F.col("rel"), F.col("imp"), F.col("rec"), lifted, F.col("trust"))))
    return top(scored, [query], [F.desc("score_micro"), F.asc(key)], limit).select(query, "rank", key, "score_micro")


def mmr(pool: DataFrame, query: str, key: str, k: int = 6, weight: float = 0.7) -> DataFrame:
    """Greedy maximal marginal relevance in pools (query, key, position from 0, keywords):
    relevance 1 / (1 + position), similarity the largest Jaccard to what is picked. The fold
    is sequential, so each pool (bounded by its top-k before) is one pandas group."""
    kind = {f.name: f.dataType.simpleString() for f in pool.schema.fields}

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["position", key])
        left = [(r["position"], r[key], frozenset(w.lower() for w in r["keywords"]) if r["keywords"] is not None else frozenset()) for _, r in rows.iterrows()]
        taken: list = []

        def gain(x):
            near = max((len(x[2] & t[2]) / len(x[2] | t[2]) if x[2] and t[2] else 0.0 for t in taken), default=0.0)
            return weight / (1 + x[0]) - (1 - weight) * near

        while left and len(taken) < k:
            best = max(left, key=gain)  # the first of equals
            taken.append(best)
            left.remove(best)
        return pd.DataFrame({query: [rows[query].iloc[0]] * len(taken), "rank": range(1, len(taken) + 1), key: [t[1] for t in taken]})

    return pool.select(query, key, "position", "keywords").groupBy(query).applyInPandas(pick, f"{query} {kind[query]}, rank int, {key} {kind[key]}")


def decayed(weight: Column, updated: Column, as_of: Column, half_life_days: float = 30.0) -> Column:
    return weight * F.pow(F.lit(0.5), F.greatest(F.lit(0.0), (as_of - updated) / 86400.0) / half_life_days)


def preferences(bumps: DataFrame, term: str = "term", step: float = 0.3, first: float = 1.0, cap: float = 3.0) -> DataFrame:
    """(term, weight, updated) after all bumps (term, ts): a term starts at 1 and gains .3 a
    bump up to 3. Bumps are equal, so their number decides and no order is needed."""
    return bumps.groupBy(term).agg(F.least(F.lit(cap), first + step * F.count("*")).alias("weight"), F.max("ts").alias("updated"))
