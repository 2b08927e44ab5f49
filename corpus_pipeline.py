"""A corpus pipeline over ``documents``: language, lines, near duplicates, secrets, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.llm import langid, linededup, neardup, packing, secrets
from tradelens.llm.common import importable, read_table
from tradelens.session import shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised; learns from the labelled documents.

    Null texts and texts without letters go.  The score that is asked for rises with the text's number of n-grams, so
    very short texts stay.  Repeated rows are judged alike; an empty table gives no rows.
    """
    out = langid.keep_recognised(docs)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that are similar to an earlier line; documents left without words go.

    Rows are told apart by doc_id (also null or repeated) and text; of lines that agree in doc_id and number that of the
    smaller text hash is the earlier.  Null and empty texts stay as they are; an empty table gives no rows.
    """
    return linededup.dedup_lines(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates.

    It is the one of the smallest doc_id (null after all others), then of the smallest text hash; of equal rows one stays.
    Null, empty and blank texts are in no group and stay; an empty table gives no rows.
    """
    return neardup.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; all rows stay, null texts stay null, and an empty table gives no rows."""
    return secrets.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences.

    Null and empty texts are pieces of a separator only; repeated rows are pieces like any other; an empty table gives
    no rows.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("near_dedup", remove_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Neither hyperdimensional profiles, 64-bit sketches nor best-fit bins can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs = read_table(importable(spark), sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
