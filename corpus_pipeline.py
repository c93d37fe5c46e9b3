"""A corpus made ready for training: five stages, each of which works on all that the one before kept.

Every stage takes documents with any further columns, whatever their names, and an empty table; very long texts are gone through whole, in one
task each. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontam, langid, pieces, secrets, simhash
from millrace.llm.common import table, written
from millrace.llm.queries import PIECE_MODEL


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a network learns it from those of docs that have one.

    Null and empty texts and those without a letter go. Repeated rows fare alike. Of an empty table nothing is learned and nothing comes.
    """
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id: sets of shingles of five words, 0.8 alike or more.

    Texts without a word, null ones too, are one group. Of rows with one doc_id and several texts each group keeps its own; repeated rows are
    one. Rows without a doc_id stay.
    """
    return simhash.dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts and those under five words match nothing and stay, repeated rows too."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark. Null and empty texts have none; repeated rows stay repeated."""
    return secrets.redacted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, decoded) of all documents. Null and empty texts have no ids and an empty text; repeated rows stay repeated."""
    return pieces.encode(docs, PIECE_MODEL)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secret_free), ("pieces", encoded)]

#: SQL can't express the first stage's network; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
