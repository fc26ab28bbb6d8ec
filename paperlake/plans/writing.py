"""Queries of terms, outlines and gates over artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.functions import terms
from paperlake.operators import documents, outline
from paperlake.plans.knowledge import WORDS, with_headings
from paperlake.plans.tables import query, table, texts

NAMES = {"the": "THE", "tion": "Tion", "de la": "DE-LA"}

#: The documents of ASCII characters alone, a part of the query's rows.
ASCII_CONSISTENCY_SQL = """SELECT doc_id, CAST(CASE WHEN n = 0 THEN 1000000 ELSE floor(round(g / n::DOUBLE, 4) * 1e6 + 0.5) END AS BIGINT) AS ratio_micro FROM (SELECT doc_id, len(f) AS n, len(list_filter(f, lambda x: x = 'THE')) AS g
FROM (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(text, '[^A-Za-z0-9À-ÿ]', ' ', 'g'), '[A-Za-z0-9]+'), lambda x: lower(x) = 'the') AS f FROM (SELECT doc_id, text FROM documents WHERE NOT regexp_matches(text, '[^\\x00-\\x7F]'))))"""


@query("""SELECT doc_id, CAST(CASE WHEN n = 0 THEN 1000000 ELSE floor(round(g / n::DOUBLE, 4) * 1e6 + 0.5) END AS BIGINT) AS ratio_micro FROM (SELECT doc_id, len(f) AS n, len(list_filter(f, lambda x: x = 'THE')) AS g
FROM (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda x: lower(x) = 'the') AS f FROM documents))""")
def term_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts have no term."""
    return texts(spark, sf_dir).select("doc_id", F.floor(terms.consistency(F.col("text"), {"the": "THE"}) * 1e6 + 0.5).cast("long").alias("ratio_micro"))


@query()
def unify_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary rules by lookaround, which DuckDB's expressions lack."""
    return texts(spark, sf_dir).select("doc_id", F.md5(terms.unified(F.col("text"), NAMES)).alias("text_md5"))


STATES = "(SELECT l_orderkey AS paper_id, CASE WHEN l_linenumber % 2 = 0 THEN 'draft' ELSE 'review' END AS artefact, CASE WHEN l_returnflag = 'R' AND l_discount > 0.05 THEN 'DIRTY' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'NEEDS_REVIEW' ELSE 'CLEAN' END AS status FROM lineitem)"


@query(f"SELECT paper_id, CASE WHEN bool_or(status = 'DIRTY') THEN 'DIRTY' WHEN bool_and(status = 'CLEAN') AND count(DISTINCT artefact) = 2 THEN 'CLEAN' ELSE 'NEEDS_REVIEW' END AS status FROM {STATES} GROUP BY 1")
def artefact_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as papers, their items as artefacts."""
    li = table(spark, sf_dir, "lineitem")
    status = F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05), "DIRTY").when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "NEEDS_REVIEW").otherwise("CLEAN")
    rows = li.select(F.col("l_orderkey").alias("paper_id"), F.when(F.col("l_linenumber") % 2 == 0, "draft").otherwise("review").alias("artefact"), status.alias("status"))
    return outline.artefact_status(rows, ["draft", "review"])


@query()
def outline_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, chunks, outline and draft of all documents under given headings; a null text
    counts as an empty one."""
    parts = documents.sections(with_headings(texts(spark, sf_dir)), "doc_id")
    pieces = documents.chunks(parts, "doc_id")
    return outline.drafts(outline.outline(parts, pieces, "doc_id"), pieces, "doc_id").select("doc_id", "ord", F.length("text").alias("n"))


@query()
def section_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain loop tests it."""
    return outline.digest(texts(spark, sf_dir), "doc_id", must_have=F.lit([w for w, _ in WORDS])).select("doc_id", F.length("digest").alias("n"), F.md5("digest").alias("digest_md5"))
