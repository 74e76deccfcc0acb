"""A corpus from raw documents: quality, near-duplicates, repeated passages, a mix of sources, token ids.

Every stage takes what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import op1_substring, op2_bpe, op4_quality, op6_simhash, op8_mixing
from rasterloom.llm.common import materialise, own_names

#: Documents with a lower score go.
LEAST_QUALITY = 0.3
#: Text of a chunk in the last stage: its tasks hold the texts that they decode, beside what the stages before left with the executors.
CHUNK_BYTES = 6_000_000
#: The name of a column of this module's own.
_OWN = "__pipeline"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it is fitted on the labels of sf_dir."""
    model = op4_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = own_names(docs, _OWN)
    return op4_quality.score(docs, model, keys=docs.columns, out=score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return op6_simhash.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 or more words that stand elsewhere too; n_chars is that of the new text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = op1_substring.remove_repeats(docs.withColumn(_OWN, F.struct(*others)), carry=[_OWN], as_it_was=True)
    new = {"doc_id": F.col("id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*(new[c].alias(c) if c in new else F.col(_OWN)[c].alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded to whole documents; those without words aren't taken."""
    found = op8_mixing.mix(docs.withColumn(_OWN, F.struct(*docs.columns)), carry=[_OWN])
    times = F.when(F.col("size") > 0, F.expr("(2 * taken + size) div (2 * size)")).otherwise(F.lit(0)).cast("int")
    return found.select(_OWN, F.explode(F.array_repeat(F.lit(1), times))).select(f"{_OWN}.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text they decode to."""
    found = op2_bpe.encode(docs, op2_bpe.word_file(), decoded=True, chunk_bytes=CHUNK_BYTES)
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("text").alias("decoded"))


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_duplicates), ("substring dedup", repeats), ("source mix", mix), ("BPE", tokens)]

#: SQL can't express the classifier, fingerprints or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
