"""Documents to packed training sequences: five stages, each over all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's
docs.  All but the last return the columns of documents.  Nulls, empty texts and repeated ids: as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfield.llm import mixing, packing, simhash, substrings, toxicity
from gridfield.llm.queries import table, tokenizer_path
from gridfield.llm.runtime import Scratch

#: Near duplicates: all pairs whose sets of five-word shingles have a similarity of 0.8, checked on the sets.  Fingerprints
#: of four words, and pivots that discard pairs further apart than so many bits, say which pairs are checked first.
SHINGLE, SIMILAR, WORDS, NEAR = 5, 0.8, 4, 64


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model rejects go."""
    model = toxicity.train(docs, toxicity.graded(table(spark, sf_dir, "labels")))
    *_, rejected = toxicity.added_columns(docs.columns)
    return toxicity.score(docs, model).where(~F.col(rejected)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays."""
    return simhash.keep_one(docs, simhash.plain_table(NEAR, WORDS), SHINGLE, similar=SIMILAR)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the words of 20-word windows that stand earlier; texts that lose none stay as they are, to the blank."""
    cut = substrings.remove_repeats(docs, width=20, keep_whole=True)
    return cut.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them, at most twice."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path(), end_id=2, capacity=4096)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Classifiers, fingerprints and a tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
