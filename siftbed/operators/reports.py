"""Counts over findings and the reports made of them. No report holds a matched text or its context.

Aggregates combine in the map tasks, so a rule or source with a third of all findings is one row per task before the
shuffle. Null categories, severities and names are groups of their own. Empty findings give empty groups and a total of
0; a source without findings keeps its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftbed.functions import secrets as S
from siftbed.operators.catalog import SEVERITIES

NAME, VERSION = "siftbed", "0.2.0"


def severity_rank(severity: Column) -> Column:
    """0 for critical to 3 for low, 4 for anything else and null."""
    rank = F.lit(len(SEVERITIES))
    for i, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(F.lower(F.trim(severity)) == name, i).otherwise(rank)
    return rank


def total(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count("*").alias("total_secrets"))


def by_severity(findings: DataFrame) -> DataFrame:
    """Counts in the order of severity; severities without findings have no row."""
    return findings.groupBy("severity").agg(F.count("*").alias("n")).orderBy(severity_rank(F.col("severity")), "severity")


def by_category(findings: DataFrame, order: Column) -> DataFrame:
    """Counts by category and the first place in which each is met."""
    return findings.groupBy("category").agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))


def by_pattern(findings: DataFrame) -> DataFrame:
    """Counts by the name of the rule: rules of one name count together."""
    return findings.groupBy("pattern_name").agg(F.count("*").alias("n"))


def by_severity_and_pattern(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "pattern_name").agg(F.count("*").alias("n"))


def top_patterns(findings: DataFrame, order: Column) -> DataFrame:
    """Rules by severity and falling count, the first seen first among equals, with their rank in the severity."""
    counts = findings.groupBy("severity", "pattern_name").agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    place = Window.partitionBy("severity").orderBy(F.desc("n"), "first_seen", "pattern_name")
    return counts.withColumn("rank", F.row_number().over(place)).orderBy(severity_rank(F.col("severity")), "rank")


def all_counts(findings: DataFrame) -> DataFrame:
    """Counts by severity, category, rule and in total, from one pass."""
    sets = [[F.col("severity")], [F.col("category")], [F.col("pattern_name")], []]
    grouped = findings.groupingSets(sets, F.col("severity"), F.col("category"), F.col("pattern_name"))
    return grouped.agg(F.grouping_id().cast("int").alias("gid"), F.count("*").alias("n"))


def by_source(findings: DataFrame, key: str = "source_tool") -> DataFrame:
    """Findings and affected files of every source that has any."""
    return findings.groupBy(key).agg(F.count("*").alias("secret_count"), F.count_distinct("source_file").alias("affected_conversations"))


def source_counts(messages: DataFrame, key: str = "source_key") -> DataFrame:
    """Messages, distinct conversations, and the estimate of conversations where a source doesn't tell them."""
    n = F.count("*")
    return messages.groupBy(key).agg(n.alias("messages"), F.count_distinct("conversation_id").alias("conversations"), S.conversation_estimate(n, 10).alias("estimate"))


def source_report(sources: DataFrame, findings: DataFrame, key: str = "source_key") -> DataFrame:
    """Every source with its findings and affected files; sources that weren't found or have no message have none."""
    counts = by_source(findings, key)
    scanned = F.coalesce(F.col("found"), F.lit(False)) & (F.coalesce(F.col("message_count"), F.lit(0)) > 0)
    joined = sources.join(counts, key, "left")
    return joined.withColumns({c: F.when(scanned, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)) for c in ("secret_count", "affected_conversations")})


def details(findings: DataFrame, source: str, *order: str, home: str = "") -> DataFrame:
    """The findings of every source, numbered from 1 in order, with the home directory shortened."""
    path = S.with_home(F.col("source_file"), home) if home else F.col("source_file")
    # A window by source would bring a source with a third of all rows to one task: number within ranges, then add up.
    return numbered(findings.withColumn("shown_file", path), source, *order).select(source, "number", "severity", "pattern_name", "redacted_text", "shown_file", "line_number")


def numbered(rows: DataFrame, group: str, *order: str, name: str = "number") -> DataFrame:
    """Rows numbered from 1 within each group in order, without a group in one task.

    Rows are range-partitioned by group and order, so a large group spans many tasks; each task numbers its part, and
    the counts of the parts before, one row per group and task, are added. `order` should be unique within a group.
    """
    parts = rows.repartitionByRange(F.col(group).asc_nulls_first(), *order).withColumn("_task", F.spark_partition_id())
    within = Window.partitionBy(F.col("_task"), F.col(group)).orderBy(*order)
    local = parts.withColumn("_local", F.row_number().over(within))
    sizes = parts.groupBy(F.col(group).alias("_group"), F.col("_task").alias("_of")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_group", "_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = local.join(offsets, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_task") == F.col("_of")))
    return joined.withColumn(name, (F.col("_local") + F.col("_before")).cast("bigint")).drop("_task", "_local", "_group", "_of", "_before")


REPORTED = ["pattern_id", "pattern_name", "category", "severity", "redacted_value", "source_file", "line_number"]


def reported(findings: DataFrame) -> DataFrame:
    """Findings as reports show them: redacted, without the match and its context."""
    return findings.withColumnRenamed("redacted_text", "redacted_value").drop("matched_text", "context")


def json_lines(sources: DataFrame, findings: DataFrame, key: str = "source_key") -> DataFrame:
    """The report as rows of JSON, a header for each source (`kind` 0) and one for each finding (1): no row grows with a source.

    `write.partitionBy(key).text(...)` makes a distributed report of them.
    """
    heads = source_report(sources, findings, key).select(
        F.lit(0).alias("kind"), key,
        F.to_json(F.struct("name", "path", "found", F.col("conversation_count").alias("conversations"), F.col("message_count").alias("messages"), F.col("secret_count").alias("secrets_found"), "error")).alias("value"),
    )
    return heads.unionByName(reported(findings).select(F.lit(1).alias("kind"), key, F.to_json(F.struct(*REPORTED)).alias("value")))


def summary(findings: DataFrame) -> dict:
    """Total and counts by severity, category and rule, as a report prints them: one row per rule at most."""
    counts = all_counts(findings).collect()
    out: dict = {"total_secrets": 0, "by_severity": {}, "by_category": {}, "by_pattern": {}}
    for row in counts:
        if row.gid == 0b111:
            out["total_secrets"] = row.n
        else:
            name, value = {0b011: ("by_severity", row.severity), 0b101: ("by_category", row.category), 0b110: ("by_pattern", row.pattern_name)}[row.gid]
            out[name][value] = row.n
    out["by_severity"] = {s: out["by_severity"][s] for s in [*SEVERITIES, *sorted(set(out["by_severity"]) - set(SEVERITIES), key=str)] if s in out["by_severity"]}
    return out


def any_found(findings: DataFrame) -> bool:
    """Whether there is any finding: the exit code of a scan."""
    return not findings.isEmpty()
