"""The corpus pipeline: documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the next stage's documents. All stages but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import bpe, chosen_path, langid, mixing, substrings
from gridweave.workspace import Workspace

#: Least probability of the best language.
MIN_LANGUAGE_SCORE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told, and correct ``lang`` to it.

    Learns from the text and lang of all documents; a document without a letter, or of no
    language likelier than all others together, goes.
    """
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    found = langid.with_language(docs, langid.train(docs, path), path)
    told = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return told.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that shares 0.8 of its five-word shingles."""
    return chosen_path.similar_groups(docs)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take 50-byte passages of documents with smaller ids out of each text."""
    return substrings.dedup_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave documents so that sources reach their target weights."""
    return mixing.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("suffix_dedup", repeated_passage_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", token_stage),
]

#: SQL can't express language models, substring digits over bytes or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            out, before = ws.adopt(out), docs  # written once: a stage that has saved its result isn't written again
            ws.drop(before)
        docs = out
    return docs
