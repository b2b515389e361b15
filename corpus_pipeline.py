"""A corpus from documents to packed sequences, stage by stage.

Language identification drops documents without recognisable language, exact
deduplication and near-duplicate grouping keep one document of each group,
decontamination drops documents that hold benchmark passages, and packing deals
what is left into sequences. Every stage sees all that its predecessor kept, as
a table written and read again.

Defined results: null and empty texts have no language and go at the first
stage, as do rows without an id, which no later decision could name; of
repeated rows one stays; an empty table gives an empty result; further columns
are carried to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm import decontaminate, exact_dedup, language, near_dedup, packing
from seriesforge.llm.common import staged, table

#: From this mean probability of its words' best languages on, a document counts as written in known ones, one or several.
SURE = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in languages of the corpus, mixed ones too; texts without a letter or a likely language go."""
    found = language.identified(docs, language.fitted(docs)).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("certainty") >= SURE))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_semi")


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by 0.8 of five-word shingles."""
    kept = near_dedup.near_groups(docs, words=5, percent=80).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", by_language),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmarks),
    ("packing", into_sequences),
]

#: No SQL says what these stages compute; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result staged for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs)
    return docs
