"""From raw documents to packed training sequences, in five stages.

Each stage's function takes (spark, docs, sf_dir) and gives a DataFrame; it is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``, and more columns of any names stay as they
are. Whole texts are read, however long; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import resemblance
from tidemark.llm.common import materialize, table
from tidemark.llm.decontamination import drop_contaminated
from tidemark.llm.ledger import redact
from tidemark.llm.packing import pack
from tidemark.llm.queries import word_tokenizer
from tidemark.llm.simhash import keep_one_each
from tidemark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go.

    Null and empty texts are scored like others; repeated rows go or stay
    together. Without labels of both kinds there is nothing to learn, and a
    document goes only if all labels say toxic.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 of five-word shingles) the document with the smallest id stays.

    Texts without words (null and empty ones, too) are a group; repeated rows
    leave one; documents without an id stay.
    """
    return keep_one_each(docs, shingle=resemblance.SHINGLE, find=resemblance.near_duplicates)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages in a twentieth of their words go.

    Null and empty texts stay; repeated rows go or stay together; an empty
    benchmark keeps all.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay, and null texts stay null."""
    return redact(docs, n_chars="n_chars")[0]


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences. A null or empty text is a piece of the end's id alone; every row has its pieces."""
    return pack(docs, word_tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express a trained classifier, components of similar sets or packing.
ORACLE_SQL = None
