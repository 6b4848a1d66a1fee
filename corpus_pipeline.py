"""The corpus pipeline: language, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again before the next.
Decisions are by row, never by doc_id alone: rows that share an id are judged apart, rows without an id take part like
others, and every column of a row that stays is kept, whatever its name. An empty table passes all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import decontaminate, exact_dedup, jaccard_join, language_id
from quillstone.llm.common import crc_bucket, lean_batches, materialise
from quillstone.llm.queries import pack_documents

#: Least score of the predicted language; texts below lie too near two languages.
LEAST_SCORE = 0.5


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned, with a score of LEAST_SCORE or more.

    Texts that are null, empty or have no letter have no language and go. Equal texts share their fate, so ties and
    repeated rows stay or go together; very long texts are judged whole. Where no language can be learned, all go.
    """
    lean_batches(spark)
    book = language_id.train_codebook(docs, crc_bucket("doc_id", 4) != 2)
    return language_id.keep_languages(docs, book, least=LEAST_SCORE)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal after white space is normalised, the row of smallest id.

    Null and empty texts are equal. A row without an id stays only if no equal text has one; of rows that repeat id and
    text one stays.
    """
    lean_batches(spark)
    return exact_dedup.without_copies(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (5-word shingles, Jaccard similarity 0.8 or more, linked in chains) the row of smallest id.

    Texts without words are near nothing. A row without an id stays only if none of its group has one; of rows that
    repeat id and text one stays.
    """
    lean_batches(spark)
    return jaccard_join.without_near_copies(docs, shingle_words=5, similarity=(80, 100))


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; equal texts share their fate; repeated rows stay if their text does.
    """
    lean_batches(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows. A null or empty text is the end mark alone; repeated rows and null ids are documents of their own."""
    lean_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("language", keep_language),
    ("exact_dedup", keep_first_copies),
    ("near_dedup", keep_one_of_each_group),
    ("decontaminate", drop_benchmarks),
    ("pack", pack),
]

#: Near copies, edit windows and tokenizers are beyond SQL; the tests hold the pipeline against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
