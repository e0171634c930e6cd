"""All queries outside of the text problems, for the driver's registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftbed.operators import nested, timestamps
from siftbed.plans import json_queries, report_queries, rule_queries, scalar_queries
from siftbed.sources.tables import read_table


def p4_normalised(spark: SparkSession, folder: str) -> DataFrame:
    """Every message with the instant chosen for it, whether its value settles it, and the format."""
    return timestamps.normalise_timestamps(read_table(spark, folder, "messages"), read_table(spark, folder, "sources")).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    chosen = timestamps.normalise_timestamps(read_table(spark, folder, "messages"), read_table(spark, folder, "sources"))
    return chosen.where("settled").select("message_id", "epoch_us").distinct()


def p5_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of all flat tables, and in how many rows each is present."""
    return nested.table_columns(nested.flatten(read_table(spark, folder, "raw_sessions")))


def p5_links(spark: SparkSession, folder: str) -> DataFrame:
    """The foreign keys between the flat tables."""
    return nested.table_links(nested.flatten(read_table(spark, folder, "raw_sessions")))


def p5_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """One of the flat tables: content blocks with the keys of their parents."""
    rows = nested.flatten(read_table(spark, folder, "raw_sessions"))
    return nested.table(rows, "content[]", ["", "type", "text", "tool_use_id", "is_error"])


def p5_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of texts with the file they came from and the key of their parent."""
    rows = nested.flatten(read_table(spark, folder, "raw_sessions"), keep=("source_file",))
    return nested.texts(rows, keep=("source_file",)).select("raw_id", "text_path", "parent_path", "source_file", "text")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.texts(nested.flatten(read_table(spark, folder, "raw_sessions"))).select("raw_id", "text_path", "parent_path").distinct()


QUERIES = {f.__name__: f for f in (p4_found, p4_normalised, p5_found, p5_tables, p5_links, p5_blocks, p5_messages)}
SQL: dict[str, str] = dict(json_queries.TABLES_SQL)
for module in (scalar_queries, rule_queries, report_queries, json_queries):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
