"""A training-corpus pipeline: grade, remove near copies, decontaminate, redact secrets, mix.

Each stage gets (spark, docs, sf_dir) and returns a frame; the next one reads what it returned from a table. All but the
last return the columns of `documents`.

Defined cases, of every stage: null texts are empty ones, which have no copies, no benchmark words, no secrets and no words
to mix; empty tables give empty results, and without labels or benchmark nothing is removed; rows with the same id are kept
or removed row by row, but of rows that are repeated as a whole `near_copies` keeps all that name their group; extra columns
are passed on, whatever their names, and end at the mixture; very long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.curriculum import mixed
from corpusloom.llm.decontam import decontaminated
from corpusloom.llm.neardup import one_of_each
from corpusloom.llm.ordinal import good_documents
from corpusloom.llm.secrets import without_secrets
from corpusloom.llm.shared import FILE_DOCUMENTS, gathered, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _few_files(kept: DataFrame, docs: DataFrame) -> DataFrame:
    return gathered(kept, docs.count() // FILE_DOCUMENTS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are graded good by a model of the ratings in `labels`."""
    return _few_files(good_documents(docs, table(spark, sf_dir, "labels")), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of their five-word shingles."""
    return _few_files(one_of_each(docs, percent=80), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words in a row of a `benchmark` item."""
    return _few_files(decontaminated(docs, table(spark, sf_dir, "benchmark")), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced."""
    return _few_files(without_secrets(docs), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What of each document the mix takes, and the positions in training of all its readings; the rows are in the order of the first."""
    return mixed(docs).orderBy(F.try_element_at("positions", F.lit(1)), "doc_id")


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination), ("secrets", secrets), ("mixture", mixture)]
#: A fitted model decides the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
