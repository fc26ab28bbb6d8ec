"""Extraction of graphs from papers as a table function over partitioned rows.

``graph_function`` makes of any extractor (text, attempt) -> payload a function that Spark calls
with a paper's sections as one partition, in their order. A payload is a dict of entities
(name, type) and relations (from, rel, to). It counts as a whole: if one row of it is no
object, has no name, a type or relation outside the lists, or an end that is no entity, all of
it is refused; the extractor is asked once more, and after that the paper waits for a person.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.operators.entities import ENTITY_TYPES, RELATION_TYPES

COLUMNS = "kind string, name string, type string, src string, rel string, dst string, status string, reason string"


def checked(payload: Any) -> tuple[list[tuple[str, str]], list[tuple[str, str, str]]]:
    """Entities and relations of a payload, or a ValueError that says what is wrong."""
    if not isinstance(payload, dict) or not all(isinstance(payload.get(k), list) for k in ("entities", "relations")):
        raise ValueError("no lists of entities and relations")
    if not payload["entities"]:
        raise ValueError("no entities")
    entities, relations = [], []
    for i, e in enumerate(payload["entities"]):
        name = str(e.get("name") or "").strip() if isinstance(e, dict) else ""
        if not name or e.get("type") not in ENTITY_TYPES:
            raise ValueError(f"entity {i} has no name or another type")
        entities.append((name, e["type"]))
    names = {n for n, _ in entities}
    for i, r in enumerate(payload["relations"]):
        ends = [str(r.get(k) or "").strip() for k in ("from", "to")] if isinstance(r, dict) else ["", ""]
        if not isinstance(r, dict) or r.get("rel") not in RELATION_TYPES or not names.issuperset(ends):
            raise ValueError(f"relation {i} is of another kind or has an end that is no entity")
        relations.append((ends[0], r["rel"], ends[1]))
    return entities, relations


def graph_function(extractor: Callable[[str, int], Any], tries: int = 2, most: int = 15_000):
    """A table function of (key, text) rows, PARTITION BY key: it yields the key and
    ``COLUMNS``: a row for each entity and relation (status ACCEPTED, or RETRY_ACCEPTED), or
    one of kind ``none`` (MANUAL_REVIEW, with the last reason). The extractor sees the first
    ``most`` characters of a paper, its sections joined by line feeds."""

    class Graph:
        def __init__(self):
            self.key, self.texts, self.size = None, [], 0

        def eval(self, row):
            self.key = row["key"]
            if row["text"] and self.size < most:
                self.texts.append(row["text"])
                self.size += len(row["text"]) + 1

        def terminate(self):
            text, reason = "\n".join(self.texts)[:most], ""
            for attempt in range(tries):
                try:
                    entities, relations = checked(extractor(text, attempt))
                except Exception as e:  # an extractor may fail in any way; the paper is kept for review
                    reason = str(e)[:160]
                    continue
                status = "RETRY_ACCEPTED" if attempt else "ACCEPTED"
                for name, kind in entities:
                    yield self.key, "entity", name, kind, None, None, None, status, reason
                for src, rel, dst in relations:
                    yield self.key, "relation", None, None, src, rel, dst, status, reason
                return
            yield self.key, "none", None, None, None, None, None, "MANUAL_REVIEW", reason

    return Graph


def extracted(parts: DataFrame, extractor: Callable[[str, int], Any], key: str = "paper_id", order: str = "ord", text: str = "text", tries: int = 2) -> DataFrame:
    """(key, kind, name, type, src, rel, dst, status, reason) of papers' sections ``parts`` (key,
    order, text); every paper has a row at least."""
    from pyspark.sql.functions import udtf

    spark: SparkSession = parts.sparkSession
    kind = parts.schema[key].dataType.simpleString()
    spark.udtf.register("graph_of_sections", udtf(graph_function(extractor, tries), returnType=f"key {kind}, {COLUMNS}"))
    rows = parts.select(F.col(key).alias("key"), F.col(order).alias("ord"), F.col(text).alias("text"))
    found = spark.sql("SELECT * FROM graph_of_sections(TABLE({rows}) PARTITION BY key ORDER BY ord)", rows=rows)
    return found.withColumnRenamed("key", key)


def items_of(found: DataFrame, key: str = "paper_id") -> tuple[DataFrame, DataFrame]:
    """What ``entities.sanitize_entities`` and ``sanitize_relations`` take: the accepted
    entities (batch, ord, name, type) and relations (batch, ord, src, rel, dst, ev)."""
    place = F.xxhash64("name", "type")
    e = found.where("kind = 'entity'").select(F.col(key).alias("batch"), place.alias("ord"), "name", "type")
    r = found.where("kind = 'relation'").select(F.col(key).alias("batch"), F.xxhash64("src", "rel", "dst").alias("ord"), "src", "rel", "dst", F.lit("").alias("ev"))
    return e, r
