"""Queries of the aggregates, orders and reports, over the recorded findings, sources, scans and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftbed.operators import matching, reports
from siftbed.plans import sql
from siftbed.sources.tables import read_table


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "findings")


def total_findings(spark: SparkSession, folder: str) -> DataFrame:
    return reports.total(_findings(spark, folder))


def by_severity(spark: SparkSession, folder: str) -> DataFrame:
    return reports.by_severity(_findings(spark, folder)).withColumn("severity_rank", reports.severity_rank(F.col("severity")))


def by_category(spark: SparkSession, folder: str) -> DataFrame:
    return reports.by_category(_findings(spark, folder), F.col("finding_id"))


def by_pattern(spark: SparkSession, folder: str) -> DataFrame:
    return reports.by_pattern(_findings(spark, folder))


def severity_pattern(spark: SparkSession, folder: str) -> DataFrame:
    return reports.by_severity_and_pattern(_findings(spark, folder))


def top_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """All rules of each severity with their rank."""
    return reports.top_patterns(_findings(spark, folder), F.col("finding_id"))


def agg_grouping_sets(spark: SparkSession, folder: str) -> DataFrame:
    return reports.all_counts(_findings(spark, folder))


def count_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return reports.by_source(_findings(spark, folder)).select("source_tool", "secret_count")


def affected_files(spark: SparkSession, folder: str) -> DataFrame:
    return reports.by_source(_findings(spark, folder)).select("source_tool", "affected_conversations")


def source_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Messages and conversations of each source, each message counted once."""
    once = read_table(spark, folder, "messages").select("source_key", "conversation_id", "message_id").distinct()
    return reports.source_counts(once)


def conv_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct conversations of each tool; its name counts in one case."""
    return read_table(spark, folder, "messages").groupBy(F.lower("source_tool").alias("tool")).agg(F.count_distinct("conversation_id").alias("n"))


def _scanned(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of the catalog in all messages, with the key of their source and their file."""
    messages = read_table(spark, folder, "messages")
    origin = messages.groupBy("message_id").agg(F.min_by(F.struct("source_key", "source_tool", "source_file"), "ingested_at").alias("of"))
    found = matching.findings(messages)
    return found.join(origin, "message_id").select("*", "of.source_key", "of.source_tool", "of.source_file").drop("of")


def source_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every source with what the catalog finds in its messages."""
    report = reports.source_report(read_table(spark, folder, "sources"), _scanned(spark, folder))
    return report.select("source_key", "name", "secret_count", "affected_conversations")


def report_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The counts that a report of the scan prints."""
    return reports.all_counts(_scanned(spark, folder))


def report_details(spark: SparkSession, folder: str) -> DataFrame:
    """All recorded findings, numbered within their tool, redacted."""
    return reports.details(_findings(spark, folder), "source_tool", "finding_id", home="/home/corvari20")


def report_json(spark: SparkSession, folder: str) -> DataFrame:
    """The report of the scan as JSON rows."""
    return reports.json_lines(read_table(spark, folder, "sources"), _scanned(spark, folder))


def any_found(spark: SparkSession, folder: str) -> DataFrame:
    """The exit code of a scan: 1 if there is any finding."""
    return _findings(spark, folder).limit(1).agg(F.count("*").cast("int").alias("exit_code"))


def skipped_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that a scan goes into: found, with messages."""
    return read_table(spark, folder, "sources").where("found and message_count > 0").select("source_key")


def tool_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of chosen tools."""
    chosen = read_table(spark, folder, "sources").where(F.col("tool").isin("claude", "codex", "kiro")).select("source_key")
    return read_table(spark, folder, "messages").join(F.broadcast(chosen), "source_key", "left_semi").select("message_id").distinct()


def src_union(spark: SparkSession, folder: str) -> DataFrame:
    """Messages and documents as one table of texts."""
    messages = read_table(spark, folder, "messages").select(F.concat(F.lit("message/"), "message_id").alias("id"), "source_tool", "source_file", "text")
    documents = read_table(spark, folder, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("id"), F.col("source").alias("source_tool"), "source_file", "text")
    return messages.unionByName(documents).groupBy("source_tool").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


def first_existing(spark: SparkSession, folder: str) -> DataFrame:
    """Of all exports of a session file the first one, by capture and id."""
    rows = read_table(spark, folder, "raw_sessions")
    return rows.groupBy("source_file").agg(F.min_by("raw_id", F.struct(F.coalesce("captured_at", F.lit("9999-01-01").cast("timestamp")), "raw_id")).alias("raw_id"))


def latest_k(spark: SparkSession, folder: str) -> DataFrame:
    """The 5,000 newest events: a top-k, kept per task before it is merged."""
    return read_table(spark, folder, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(5000).select("event_id", "ts")


def list_limit(spark: SparkSession, folder: str) -> DataFrame:
    """The first 500 words of each document as a list: the operator for the limit of list traversal."""
    return read_table(spark, folder, "documents").select("doc_id", F.size(F.slice(F.split("text", " "), 1, 500)).alias("n"))


def first_files(spark: SparkSession, folder: str) -> DataFrame:
    """The first 10,000 files in the order of paths: the limit of a tree scan."""
    return _findings(spark, folder).where("source_file is not null").select("source_file").distinct().orderBy("source_file").limit(10_000)


def context_limit(spark: SparkSession, folder: str) -> DataFrame:
    """Contexts as findings keep them: at most 200 characters."""
    return _findings(spark, folder).select("finding_id", F.substring("context", 1, 200).alias("context"))


def findings_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Findings numbered within their file by the distributed numbering, which keeps no group in one task."""
    rows = _findings(spark, folder).select("finding_id", "source_file")
    return reports.numbered(rows, "source_file", "finding_id").select("finding_id", "number")


QUERIES = {
    f.__name__: f
    for f in (
        total_findings, by_severity, by_category, by_pattern, severity_pattern, top_patterns, agg_grouping_sets, count_by_source, affected_files, source_counts,
        conv_distinct, source_report, report_summary, report_details, report_json, any_found, skipped_sources, tool_filter, src_union, first_existing, latest_k,
        list_limit, first_files, context_limit, findings_numbered,
    )
}


def _sql() -> dict[str, str]:
    from siftbed.plans.rule_queries import _FINDINGS

    scanned = f"{_FINDINGS}, origin AS (SELECT message_id, arg_min(source_key, ingested_at) AS source_key, arg_min(source_tool, ingested_at) AS source_tool, arg_min(source_file, ingested_at) AS source_file FROM messages GROUP BY message_id), scanned AS (SELECT * FROM first JOIN origin USING (message_id) WHERE nth = 1)"
    sets = "severity, category, pattern_name, grouping(severity, category, pattern_name)::INT AS gid, count(*) AS n"
    by_sets = "GROUP BY GROUPING SETS ((severity), (category), (pattern_name), ())"
    return {
        "total_findings": "SELECT count(*) AS total_secrets FROM findings",
        "by_severity": f"SELECT severity, count(*) AS n, ({sql.severity_rank('severity')})::INT AS severity_rank FROM findings GROUP BY severity",
        "by_category": "SELECT category, count(*) AS n, min(finding_id) AS first_seen FROM findings GROUP BY category",
        "by_pattern": "SELECT pattern_name, count(*) AS n FROM findings GROUP BY pattern_name",
        "severity_pattern": "SELECT severity, pattern_name, count(*) AS n FROM findings GROUP BY ALL",
        "top_patterns": "SELECT *, row_number() OVER (PARTITION BY severity ORDER BY n DESC, first_seen, pattern_name)::INT AS rank FROM (SELECT severity, pattern_name, count(*) AS n, min(finding_id) AS first_seen FROM findings GROUP BY ALL)",
        "agg_grouping_sets": f"SELECT {sets} FROM findings {by_sets}",
        "count_by_source": "SELECT source_tool, count(*) AS secret_count FROM findings GROUP BY ALL",
        "affected_files": "SELECT source_tool, count(DISTINCT source_file) AS affected_conversations FROM findings GROUP BY ALL",
        "source_counts": "SELECT source_key, count(*) AS messages, count(DISTINCT conversation_id) AS conversations, greatest(count(*) // 10, 1)::BIGINT AS estimate FROM (SELECT DISTINCT source_key, conversation_id, message_id FROM messages) GROUP BY source_key",
        "conv_distinct": "SELECT lower(source_tool) AS tool, count(DISTINCT conversation_id) AS n FROM messages GROUP BY ALL",
        "source_report": f"{scanned} SELECT s.source_key, s.name, CASE WHEN s.found AND s.message_count > 0 THEN count(c.rule) ELSE 0 END AS secret_count, CASE WHEN s.found AND s.message_count > 0 THEN count(DISTINCT c.source_file) ELSE 0 END AS affected_conversations FROM sources s LEFT JOIN scanned c USING (source_key) GROUP BY s.source_key, s.name, s.found, s.message_count",
        "report_summary": f"{scanned} SELECT {sets} FROM scanned {by_sets}",
        "report_details": "SELECT source_tool, row_number() OVER (PARTITION BY source_tool ORDER BY finding_id) AS number, severity, pattern_name, redacted_text, replace(source_file, '/home/corvari20', '~') AS shown_file, line_number FROM findings",
        "any_found": "SELECT (count(*) > 0)::INT AS exit_code FROM findings",
        "skipped_sources": "SELECT source_key FROM sources WHERE found AND message_count > 0",
        "tool_filter": "SELECT DISTINCT message_id FROM messages JOIN sources USING (source_key) WHERE tool IN ('claude', 'codex', 'kiro')",
        "src_union": "SELECT source_tool, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT source_tool, text FROM messages UNION ALL SELECT source, text FROM documents) GROUP BY source_tool",
        "first_existing": "SELECT source_file, raw_id FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY captured_at NULLS LAST, raw_id) AS nth FROM raw_sessions) WHERE nth = 1",
        "latest_k": "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000",
        "list_limit": "SELECT doc_id, least(len(string_split(text, ' ')), 500)::INT AS n FROM documents",
        "first_files": "SELECT source_file FROM (SELECT DISTINCT source_file FROM findings WHERE source_file IS NOT NULL) ORDER BY encode(source_file) LIMIT 10000",
        "context_limit": "SELECT finding_id, context[:200] AS context FROM findings",
        "findings_numbered": "SELECT finding_id, row_number() OVER (PARTITION BY source_file ORDER BY finding_id) AS number FROM findings",
    }


SQL = _sql()
