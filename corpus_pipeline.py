"""A training corpus from raw documents, in five stages.

Each stage works on all that the stage before it kept.  All but the last return the columns of
``documents``; the last returns the blocks of the mixture
with their text, so nothing of the tables before it is needed to write the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from probitas.llm import quality_rules as rules
from probitas.llm.common import read, table
from probitas.llm.decontamination import drop_contaminated
from probitas.llm.line_dedup import drop_repeated_lines
from probitas.llm.mixing import mixture
from probitas.llm.near_dedup import drop_near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose content share is too small go.  The field is trained on the labelled documents."""
    return rules.keep_content_documents(docs, rules.train(docs, read(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go, and documents of which nothing is left."""
    return drop_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark go."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of equal tokens, apportioned so that all sources weigh the same."""
    return mixture(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The labels of a conditional random field, and edit distances between documents, are beyond SQL;
#: tests/llm compares the rows with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture made from ``documents``.

    Each stage's result is written as Parquet to the shared checkpoint folder and read again,
    so a lost executor costs no earlier stage.  A table is removed when the next one is there,
    the last one when the session ends.
    """
    docs, done = read(spark, sf_dir, "documents"), lambda: None
    for _, stage in STAGES:
        kept, remove = table(stage(spark, docs, sf_dir))
        done()
        docs, done = kept, remove
    return docs
