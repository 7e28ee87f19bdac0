"""The operators with production parameters over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfield.llm.oracles import ORACLES as ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfield.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfield.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfield.llm.substrings import remove_repeats

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, width=20).select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfield.llm.simhash import groups, spare_families

    found = groups(table(spark, sf_dir, "documents"), spare_families(2), shingle=3)
    return found.select("doc_id", F.lower(F.concat(*(F.substring(F.hex("fp"), k, 2) for k in range(15, 0, -2)))).alias("fingerprint"), "component_id")


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfield.llm.containers import write

    return write(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1).digests()


def op6_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfield.llm.media import media_features, to_media

    return media_features(to_media(table(spark, sf_dir, "documents")))


def op7_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfield.llm.toxicity import graded, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, graded(table(spark, sf_dir, "labels")))).drop("text")


def op8_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfield.llm.sharding import shuffle

    out = shuffle(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfield.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, capacity=4096)


def op10_risk_controlled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridfield.llm.quality import judge

    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {f.__name__: f for f in (op1_entropy_mixing, op2_license_scan, op3_substring_dedup, op4_simhash_near_dedup, op5_token_ids, op6_jpeg_media, op7_ordinal_toxicity, op8_hypergeometric_sharding, op9_harmonic_packing, op10_risk_controlled_quality)}
