"""Training-corpus pipeline: quality, near copies, benchmark passages, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's documents.  All but the last return
the columns of ``documents``.

Semantics for odd input, in every stage: rows are judged one by one, so null and
repeated ids take no other rows along; a null or empty text is scored by the
classifier, copies nothing, holds no benchmark words, has no words to take in the
mix (so it ends there); repeated rows are near copies, of which one stays; further
columns are carried along whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import decontaminate, mixing, ngram_join, quality, token_index
from touchline.llm.shared import new_folder


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of the n-gram Jaccard join."""
    return ngram_join.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without enough benchmark passages to count as contaminated."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: a row for each epoch of a document."""
    return mixing.emit_mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id shards with their index; (doc_id, copy, start, n_tokens, ids_crc32) read back from them."""
    rows = token_index.token_ids(docs, token_index.tokenizer_file())
    return rows.select("doc_id", "copy", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality classifier", reject_low_quality),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("source mixing", mix_to_weights),
    ("token-id output", write_token_ids),
]

#: Neither a trained classifier nor a tokenizer can be said in SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to shared storage and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = new_folder(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
