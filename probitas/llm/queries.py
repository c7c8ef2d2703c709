"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_classifier, quality_rules, sql
from .archives import arc_to_warc, pages_as_arc
from .common import read
from .decontamination import contaminated
from .line_dedup import repeated_lines
from .mixing import mixture
from .near_dedup import near_duplicates
from .secrets import confirmed_secrets
from .token_counts import token_counts
from .url_filters import url_filter


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents that match an earlier line, with the line that stays."""
    return repeated_lines(read(spark, sf_dir, "documents")).select("doc_id", "line_no", "kept_doc_id", "kept_line_no", "edits")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The WARC records of all pages, which are first put into ARC files of both versions."""
    return arc_to_warc(pages_as_arc(read(spark, sf_dir, "pages"))).withColumn("block", F.decode("block", "UTF-8"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a near-duplicate document and the document of its group that stays."""
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "kept_doc_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its path template; the labels are those of the documents of the same number."""
    bad = F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad")
    return url_filter(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE tokens of every document."""
    return token_counts(read(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains."""
    found = contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "windows", "coverage", "verbatim")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structurally confirmed secrets in documents."""
    return confirmed_secrets(read(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, with their scores; low-quality and toxic ones aren't in it."""
    docs = read(spark, sf_dir, "documents")
    return quality_classifier.good_documents(docs, quality_classifier.train(docs, read(spark, sf_dir, "labels")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, with their share of content."""
    docs = read(spark, sf_dir, "documents")
    return quality_rules.content_documents(docs, quality_rules.train(docs, read(spark, sf_dir, "labels")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of documents picked so that all sources weigh the same."""
    return mixture(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_warc,
        op3_near_dedup,
        op4_url_filter,
        op5_token_counts,
        op6_decontamination,
        op7_secrets,
        op8_quality_classifier,
        op9_quality_rules,
        op10_mixing,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": sql.LINE_DEDUP, "op2_warc": sql.WARC, "op10_mixing": sql.MIXING}
