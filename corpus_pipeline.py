"""Training-corpus pipeline over `documents`: five operators, each on all that its predecessor kept.

Defined cases, stage by stage. Language ID drops null, empty and letterless texts, and texts whose
language is known with less than an even chance (all, when no row names a language). Near-dedup
links documents from a similarity of 0.8 and keeps the smallest id of a group; repeated rows of an id
become one, and rows without an id all stay. Substring dedup cuts out passages of 50 words or
more that a document of a smaller id has with a similarity of 0.8 or more; a document of which nothing is left goes. Decontamination
cuts out words inside a benchmark window of ten words and drops documents of which more than four fifths
are hit; with no items nothing goes. SentencePiece keeps every row; its text makes way for
its piece ids. Other columns go through; n_chars follows a changed text. Empty tables give empty ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stackroom.llm import decontam, language_id, near_dup, sentencepiece_nbest, substring_dedup
from stackroom.session import ready, shared_folder, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    return near_dup.keep_first(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in a document of a smaller id are cut out."""
    return substring_dedup.remove_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that stand in a window of a benchmark item are cut out; documents that are hardly anything else go."""
    return decontam.remove_overlaps(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the best segmentation, with the scores of the best four."""
    return sentencepiece_nbest.encode(docs).drop("text")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", decontaminate),
    ("sentencepiece", encode_pieces),
]

#: Learned, searched and verified stages: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet and read again."""
    ready(spark)
    base = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{base}/pipeline-{uuid.uuid4().hex}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
