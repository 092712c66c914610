"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns of ``docs``.  Extra columns of
``docs`` pass through the first three stages and stay with each copy in the mix.
"""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import mixing, ngram_join, packing, pii, quality
from quirework.llm.common import read, small_batches
from quirework.plans.settle import shared_dir


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade above the lowest is at least one half.  The model learns from ``labels``."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).filter("kept").select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.  Of rows with one id and text one
    stays; rows with a null id have nothing to be told apart by and all stay."""
    small_batches(spark)
    groups = ngram_join.similar_groups(docs)
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.withColumn("_text", F.xxhash64("text")).join(kept, "doc_id", "left_semi")
    once = named.dropDuplicates(["doc_id", "_text"])
    return once.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; ``n_chars`` follows."""
    small_batches(spark)
    masked = pii.find_pii(docs, masked=True)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: every document as often as the mix takes it; ``n_chars`` follows a cut text."""
    mixed = mixing.mixed(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, spaced=False)


STAGES = [("quality classifier", good), ("n-gram Jaccard join", distinct), ("PII", private),
          ("mixing sources to target weights", mix), ("packing", pack)]

#: The classifier is trained and the tokenizer is a library's, which SQL cannot express: tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows lie in the shared folder."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
