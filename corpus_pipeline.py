"""The training-corpus pipeline: quality, line dedup, near duplicates, decontamination, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``; further columns of ``docs`` go, whatever their names.

In every stage an empty table gives an empty one, a null or empty text has a defined result, a null id, language or source is
a value like any other, and very long texts are read whole. What each stage does with them is said at the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktide.llm import byte_bpe, decontaminate, jaccard, line_dedup, quality
from sparktide.llm.common import small_batches, stored
from sparktide.llm.queries import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _given(spark: SparkSession, docs: DataFrame) -> DataFrame:
    small_batches(spark)
    return docs.select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior of being good is under one half go.

    Null and empty texts are judged by the features of an empty text; repeated rows are judged alike; a tie at one half stays.
    """
    docs = _given(spark, docs)
    return quality.classify(docs, table(spark, sf_dir, "labels")).where("keep").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines go, and documents of which nothing else is left.

    Null and empty texts stay as they are; repeated rows lose the same lines; of an id's occurrences of a line the least
    position counts as its first. ``n_chars`` is counted anew where lines went.
    """
    out = line_dedup.dedup_lines(_given(spark, docs)).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one of least id, null ids last.

    Null, empty and wordless texts are one class; repeated rows are copies; of two texts under the kept id the one of least
    hash stays.
    """
    return jaccard.keep_one(_given(spark, docs)).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark item leaks go. Null and empty texts stay; repeated rows are treated alike."""
    return decontaminate.decontaminate(_given(spark, docs), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with their byte offsets, and whether they decode to the text. Null and empty texts have no tokens; repeated rows are encoded alike."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    out = byte_bpe.encode_and_decode(_given(spark, docs).select("doc_id", "lang", "source", "n_chars", digest, "text"), ranks)
    return out.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "token_ends", (F.sha2("decoded", 256) == F.col("text_sha256")).alias("decodes"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE encoding and decoding", token_stage),
]

#: SQL can express neither the classifier nor the walks, nor byte-pair merging; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
