"""A training corpus from raw documents: reject bad texts, keep one of near copies, redact, mix sources, encode.

STAGES are (name, function(spark, docs, sf_dir)); each stage's rows are written as Parquet and reread as the next one's docs.
All but the last return the columns of documents. run() applies them to the table documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import bpe, jaccard_join, mixing, pii, quality
from chronolith.llm.runtime import staged, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
MIN_SCORE = 0.5
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the table labels, scores under MIN_SCORE go."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"), MIN_SCORE)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return jaccard_join.keep_first(docs, width=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become their kind in brackets."""
    return pii.redact_all(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs, keep=[c for c in docs.columns if c != "doc_id"])
    repeated = mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*docs.columns)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids (little-endian unsigned 32-bit integers)."""
    return bpe.encode_texts(docs, VOCABULARY, keep=["doc_id", "source"])


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("PII", personal_data),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe_tokens),
]

#: The stages use trained models, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
