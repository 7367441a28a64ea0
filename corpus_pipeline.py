"""Corpus pipeline: language ID, exact dedup, near dedup, PII redaction, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all
but the last return the columns of ``documents``. ``run`` writes each stage's result in the
shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.exact_dedup import drop_exact_copies
from tidegauge.llm.language_id import predict_languages, train_language_model
from tidegauge.llm.near_dedup import keep_one
from tidegauge.llm.packing import pack_documents
from tidegauge.llm.pii import redact
from tidegauge.llm.shared import cut, new_names, release, table

#: A prediction with a smaller posterior is rejected.
LEAST_POSTERIOR = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language: no letters, or no clear language, and the row goes.

    Null and empty texts have no letters and go. Where no row has a language to learn from,
    nothing can be told and all rows stay. Equal rows share their fate; other columns, null
    ids and repeated ids pass through.
    """
    model = train_language_model(docs)
    if not model.languages:
        return docs
    lang, score = new_names(docs.columns, 2)
    judged = predict_languages(docs, model, names=(lang, score))
    return judged.filter((F.col(lang) != "und") & (F.col(score) >= LEAST_POSTERIOR)).drop(lang, score)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, white space aside: the longest, then of the least id.

    Null and empty texts are one group; a null id comes last; of repeated rows one stays.
    """
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the least id, null ids last.

    Null texts and texts without words are one class; of repeated rows one stays; very long
    texts are compared whole.
    """
    return keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in the text replaced by its kind, and n_chars to match.

    Null texts stay null, with a null n_chars; empty ones stay empty; repeated rows stay.
    """
    out = redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences.

    A null or empty text is one piece, the end id alone; repeated rows are packed each on its own.
    """
    return pack_documents(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: Language ID, alignment and packing can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        if k:
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
