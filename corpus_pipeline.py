"""From documents to token ids: language ID, near-duplicates, benchmark passages, mixing, binary output.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; `run` writes what a
stage returns as Parquet to the shared scratch folder and rereads it, so a lost executor costs a stage at
most. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontam, langid, mixing, neardup, rans
from factloom.llm.common import delete, scratch_path, table
from factloom.llm.queries import word_bpe

#: Encoded words that a worker remembers: executors still hold the memory of the stages before.
TOKEN_WORDS = 400_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised; the others go."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose sets of 5-word shingles are similar by 0.8 or more."""
    return neardup.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as read back from the binary output: doc_id, start, n_tokens, ids_crc32."""
    return rans.round_trip(docs, word_bpe(), words=TOKEN_WORDS)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontaminate), ("mixing", mix), ("token_ids", token_ids)]

#: SQL can express neither the learned classifier nor the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    out = STAGES[-1][1](spark, docs, sf_dir)  # its files are written when it returns
    delete(spark, last)
    return out
