"""From raw documents to token ids, in five stages.

Each stage takes what its predecessor kept as Parquet and returns the columns of
``documents``; the last returns token ids and the text they stand for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftwalk.llm import bpe, decontamination, line_dedup, minhash, quality
from driftwalk.llm.base import read, text_or_empty
from driftwalk.staging import stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on ``labels``, does not reject."""
    return quality.drop_low_quality(docs, read(spark, sf_dir, "labels"))


def keep_lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, shared lines in one of them only; ``n_chars`` follows the text."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length(text_or_empty("text")).cast("long")).select(
        docs.columns
    )


def keep_one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.drop_near_duplicates(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no item of ``benchmark`` leaks."""
    items = read(spark, sf_dir, "benchmark")
    return decontamination.drop_leaking(docs, items, short_inside=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of every document, their number, and the text decoded again."""
    path = bpe.vocabulary("word_bpe_49k.json")
    encoded = bpe.encode_texts(docs.select("doc_id", "text"), path)
    return bpe.decode_ids(encoded, path).select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", keep_lines_once),
    ("MinHash near-dedup", keep_one_of_copies),
    ("benchmark decontamination", keep_uncontaminated),
    ("BPE encoding and decoding", encode),
]

# The classifier is a fitted model, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for at, (_, apply) in enumerate(STAGES, 1):
        docs = apply(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = stage(docs, "pipeline")
    return docs
