"""The corpus pipeline: documents through five stages, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever
others there are. What happens to nulls, ties, repeated rows and long texts is told by the stages' operators; empty and null
texts are equal to stage 2, which keeps one of them; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import exact_dedup, ngram_join, quality_classifier, sentencepiece_codec, source_mix
from emberlog.llm.common import tokenizer_path
from emberlog.session import cut, free, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality_classifier.drop_rejected(docs, table(spark, sf_dir, "labels"))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    return ngram_join.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return source_mix.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text of the mix, decoded again as a check."""
    found = sentencepiece_codec.sentencepiece(docs, tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_pieces", "n_bytes_fallback", "ids", F.xxhash64("ids").alias("ids_hash"), "exact")


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", copies),
    ("ngram_join", near_copies),
    ("source_mix", mixed),
    ("sentencepiece", pieces),
]

#: SQL can express neither the classifier nor the segmentation; the tests hold run() against plain Python, given the classifier's decisions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
            free(before)  # the stage before is used up; the input table is left alone
    return docs.drop("ids")
