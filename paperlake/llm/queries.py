"""The thin ``opN_*`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlake.llm import bpe, decontaminate, fingerprint, langid, packing, quality, resample, sharding, simhash, tokenfile, toxicity, warc, whiten
from paperlake.llm.common import crc_of_id, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), shingle=5, least=0.8)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, sf_dir, "pages"), least_bytes=0))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, distance=4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenfile.write(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return tokenfile.read(manifest)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), [1.0] * 24)


def toxic_model(spark: SparkSession, sf_dir: str) -> toxicity.Network:
    return toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_of_id("doc_id") % 3 != 1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxic_model(spark, sf_dir))
    return scored.select("doc_id", (crc_of_id("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def language_model(spark: SparkSession, sf_dir: str) -> langid.Model:
    return langid.fit(table(spark, sf_dir, "documents").where(crc_of_id("doc_id") % 5 != 0))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = langid.predict(docs, language_model(spark, sf_dir))
    return found.select("doc_id", (crc_of_id("doc_id") % 5 == 0).alias("held_out"), "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"), crc_of_id("doc_id") % 4 != 2)
    scored = quality.score(docs, rules)
    return scored.select("doc_id", (crc_of_id("doc_id") % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, percent=5, least_words=20, seed=42)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten.whitened(table(spark, sf_dir, "embeddings"), most=16)
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, length=4096)
    return packing.packed(pieces, length=4096).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_warc": op2_warc,
    "op3_simhash": op3_simhash,
    "op4_token_files": op4_token_files,
    "op5_fingerprints": op5_fingerprints,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_language_id": op9_language_id,
    "op10_quality": op10_quality,
    "op11_resample": op11_resample,
    "op12_whiten": op12_whiten,
    "op13_pack": op13_pack,
}
ORACLE_SQL: dict[str, str] = {"op1_decontaminate": decontaminate.ORACLE, "op2_warc": warc.ORACLE}
