"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet in
the shared folder and read again as the next one's docs. All but the last return the columns
of ``docs``, with fewer rows: documents in no learned language, toxic documents, all but one
document of each near-duplicate group and documents that contain a benchmark item go. The
last stage gives the digests of the tokens of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperlake.llm import bpe, decontaminate, langid, queries, simhash, toxicity
from paperlake.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language with a score of .5 or more; null texts, and those
    without a letter, go. If no language was learned all stay."""
    return langid.keep_known(docs, queries.language_model(spark, sf_dir))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below .7 for toxicity; null and empty texts score like an empty
    window. Without labels of both kinds all stay."""
    return toxicity.keep_clean(docs, queries.toxic_model(spark, sf_dir))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest id of each group of texts that links of a five-word Jaccard
    index of .8 hold together; of equal rows one, of null and empty texts one."""
    return simhash.keep_one(docs, shingle=5, least=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold .8 of the five-word shingles of a benchmark item; null and empty
    texts hold none."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"), shingle=5, least=0.8)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256; null counts as empty."""
    import public_tokenizers

    return bpe.digests(docs, queries.tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", deduplicated), ("decontamination", decontaminated), ("tokens", tokenized)]

#: SQL cannot express the two learned stages, nor byte-level BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
