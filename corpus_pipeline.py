"""A training corpus from ``documents``: five stages, each a whole-table job over what is left.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's docs. All but the last return the columns of
documents. ORACLE_SQL is None: language ID, near-duplicates and the sample have no SQL form; the
tests hold run() against a brute-force chain of the stages instead.

Every stage takes null in any column, empty and very long texts, repeated rows, empty tables and extra
columns of any name, as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cinderframe.llm import binary, decontaminate, langid, mixing, simhash
from cinderframe.llm.common import read_table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; what language ID rejects (``und``) goes.

    Null, empty and letterless texts go, and nothing else; repeated rows stay; without labelled text to
    learn from the other rows stay as well.
    """
    return langid.drop_unidentified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group of near-duplicates.

    A null doc_id is the largest; of rows that repeat one doc_id and text one stays; rows of one doc_id
    with unlike texts are of different groups. Wordless texts are alike.
    """
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item; a null or wordless text, or item, holds none."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them.

    A null source is one of its own, last in order; rows without words go; rows that repeat doc_id and
    text are taken alike.
    """
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each row, from the written id files.

    Null doc_ids come first; a null or empty text is its end id alone; repeated rows have rows of their own.
    """
    return binary.token_output(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each stage's result is a table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
