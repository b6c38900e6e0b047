"""From raw documents to packed training sequences.

Quality filter, near-duplicate removal, benchmark decontamination, redaction of personal data, packing.
Every stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and all but
the last return the columns of ``documents``. In every stage extra columns are kept (but for the last),
texts of any length are read whole, and an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strophe.llm import boosting, decontam, near, packing, pii
from strophe.llm.common import materialize, table
from strophe.llm.queries import WORD_VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the quality classifier scores 0.5 or more.

    Null and empty texts have the score of an empty text; rows that repeat share their score; rows with a
    null id or label are not learned from, but scored.
    """
    return boosting.keep(docs, boosting.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near copies: five words, similarity 0.8.

    Null and blank texts are copies of each other; of rows that repeat an id one stays, with the smallest
    text; rows with a null id take no part and are kept.
    """
    return near.deduplicate(docs, words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item.

    Null and empty texts hold none; rows that repeat go or stay together; a null id changes nothing.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in brackets in place of personal data; ``n_chars`` follows the text.

    A null text stays null; rows that repeat and rows with a null id are redacted like any other.
    """
    return pii.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens.

    A null text is empty and packs as the end id alone; rows that repeat and rows with a null id are packed
    like any other.
    """
    return packing.pack(packing.pieces(docs, public_tokenizers.path(WORD_VOCABULARY), "words", end_id=1))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("sequences", sequences),
]
#: SQL cannot express the classifier, the components or the packing: tested against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and reread for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
