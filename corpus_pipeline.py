"""A training corpus from raw documents: each stage takes all its predecessor kept and is written before the next.

STAGES: (name, function of (spark, docs, sf_dir)). Every stage but the last returns the columns of
documents; n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdq.llm import langid, line_dedup, near_copies, packing, substring_dedup
from mdq.llm.common import staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: some of it cannot be put in SQL: trained models, components of near copies, token ids
ORACLE_SQL = None


def _documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from the documents of sf_dir."""
    model = langid.fit(table(spark, sf_dir, "documents"))
    return langid.predict(docs, model).filter("accepted").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that other documents hold too go from all but the first; documents left without words go."""
    return _documents(line_dedup.drop_shared_lines(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles that overlap by 0.8 or more."""
    return near_copies.keep_one(docs).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words that occur elsewhere are cut; documents left without words go."""
    return _documents(substring_dedup.drop_repeated_windows(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packed", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
