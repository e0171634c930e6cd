"""Queries of the text problems, for the driver's registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftbed.llm import containers, credentials
from siftbed.llm import formatting_duplicates as duplicates
from siftbed.llm import leaks, personal, quality
from siftbed.sources.tables import read_table


def p1_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Every later copy of a finding, with the finding that remains and the size of their group."""
    return duplicates.formatting_duplicates(read_table(spark, folder, "findings"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_copies(spark, folder).select("keep_id", "copy_id").distinct()


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every message with its credentials, where they start, and the text with them masked."""
    return credentials.scan_texts(read_table(spark, folder, "messages"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    in_messages = p2_redacted(spark, folder).select(F.lit("message").alias("record_kind"), F.col("message_id").alias("record_id"), F.explode("secrets").alias("secret"))
    in_findings = credentials.shown_in_redaction(read_table(spark, folder, "findings"))
    in_findings = in_findings.select(F.lit("finding").alias("record_kind"), F.col("finding_id").alias("record_id"), F.explode("secrets").alias("secret"))
    return in_messages.unionByName(in_findings).distinct()


def p3_masked(spark: SparkSession, folder: str) -> DataFrame:
    """Every message with the personal data in it, and the text with typed placeholders."""
    messages, names, findings = (read_table(spark, folder, t) for t in ("messages", "given_names", "findings"))
    return personal.scan_texts(messages, names, findings)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    items = p3_masked(spark, folder).select("message_id", F.explode("items").alias("item"))
    return items.select("message_id", F.col("item.type").alias("pii_type"), F.col("item.value").alias("pii_value")).distinct()


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or of each piece of one over the capacity, for every kind of container."""
    return containers.packed(read_table(spark, folder, "documents"), read_table(spark, folder, "container_sizes"))


def p7_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and evaluation item that it repeats, with the spans to remove."""
    return leaks.leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_spans(spark, folder).select("doc_id", "item_id").distinct()


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics and the kind of every document."""
    return quality.text_statistics(read_table(spark, folder, "documents"), read_table(spark, folder, "doc_labels"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_statistics(spark, folder).where("kind <> 'prose'").select("doc_id", "kind").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_copies, p2_found, p2_redacted, p3_found, p3_masked, p6_containers, p7_found, p7_spans, p8_found, p8_statistics)}
SQL: dict[str, str] = {}
