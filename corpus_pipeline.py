"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

language ID, line dedup, SimHash near-dedup, benchmark decontamination, SentencePiece encoding. A stage takes
(spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the columns of
documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import decontaminate, langid, lines, pieces, simhash
from stowage.llm.common import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; those without a letter are rejected."""
    docs = docs.select(COLUMNS)
    found = langid.identify(docs, langid.fit(docs), keep=["text", "lang", "source", "n_chars"])
    return found.where("lang_pred <> 'und'").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others have, or nearly have; what has no text left goes."""
    out = lines.deduplicate(docs.select(COLUMNS)).where("text is not null and trim(text) <> ''")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.keep_one(docs.select(COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens and digests of each document's encoding and of its decoding."""
    return pieces.digests(docs.select(COLUMNS), pieces.public_model())


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark),
    ("sentencepiece", encoding),
]

#: Suffix automata, MinHash and tokenisation can't be put in SQL; tests/llm holds each operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read back.

    Nulls, empty and very long texts, ties and repeated rows are as in the operators that the stages call. Columns of
    documents beside its five are left out; no documents give no rows. The folder stays until the result has been read,
    as it is read from there: whoever names the folder clears it.
    """
    base, docs = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
