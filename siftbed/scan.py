"""The scan as a library call and as a command: sources to messages to findings to a report.

    python -m siftbed --tool claude --tool codex --days 7 --json
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftbed.operators import matching, reports
from siftbed.operators.catalog import SEVERITIES, Rule
from siftbed.session import get_spark, written
from siftbed.sources import tools


@dataclass
class Scan:
    """A planned scan: sources with their counts, and findings with source and file."""

    sources: DataFrame
    findings: DataFrame
    days: int


def scan_messages(messages: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """Findings of a table of messages with their source and file; `rules` replaces the catalog."""
    return matching.findings(messages, rules, keep=("source_key", "source_tool", "source_file"))


def scan_text(spark: SparkSession, text: str, rules: tuple[Rule, ...] | None = None, source_file: str = "", source_tool: str = "") -> DataFrame:
    """Findings of one text."""
    one = spark.createDataFrame([("0", source_tool, source_tool, source_file, text)], "message_id string, source_key string, source_tool string, source_file string, text string")
    return scan_messages(one, rules)


def scan(scope: tools.Scope, chosen: list[str] | None = None, path: str | None = None) -> Scan:
    """All or the chosen tools, or instead of them one path."""
    sources = [tools.tree(scope, path)] if path else tools.collect_sources(scope, chosen)
    return Scan(tools.source_table(scope.spark, sources), scan_messages(tools.message_table(scope.spark, sources)), scope.days)


def print_text(result: Scan, verbose: bool, home: str) -> int:
    """Counts by source and severity on standard output; with `verbose` the findings. Returns the number of findings."""
    heads = reports.source_report(result.sources, result.findings).orderBy("place").collect()
    for row in heads:
        if not row.found:
            print(f"{row['name']}: not found")
        elif row.error:
            print(f"{row['name']}: error: {row.error}")
        else:
            size = ", ".join(f"{n:,} {what}" for n, what in ((row.conversation_count, "conversations"), (row.message_count, "messages")) if n) or "empty"
            print(f"{row['name']} ({size}): {row.secret_count:,} secrets in {row.affected_conversations:,} conversations")
    counts = reports.top_patterns(result.findings, F.col("place")).collect()
    total = sum(row.n for row in counts)
    print(f"\n{total:,} secrets in the last {result.days} days" if total else f"\nNo secrets in the last {result.days} days")
    for severity in SEVERITIES:
        of = [row for row in counts if row.severity == severity]
        if of:
            print(f"\n{severity.upper()} ({sum(r.n for r in of):,})")
            print("\n".join(f"  {r.n:,} x {r.pattern_name}" for r in of))
    if verbose:
        rows = reports.details(result.findings, "source_tool", "source_file", "message_id", "place", "match_start", home=home)
        for row in rows.orderBy("source_tool", "number").toLocalIterator():
            print(f"{row.source_tool} {row.number}. [{row.severity}] {row.pattern_name}\n    Value: {row.redacted_text}\n    File: {row.shown_file}\n    Line: {row.line_number}")
    return total


def print_json(result: Scan) -> int:
    """The report as one JSON document; sources are streamed, so the driver holds the findings of one source at a time."""
    counts = reports.summary(result.findings)
    print(json.dumps({"scanner": reports.NAME, "version": reports.VERSION, "scan_period_days": result.days} | counts, indent=2, ensure_ascii=False)[:-2] + ',\n  "sources": [')
    shown = reports.reported(result.findings).select("source_key", *reports.REPORTED, "place", "match_start", "message_id")
    heads = reports.source_report(result.sources, result.findings).orderBy("place").collect()
    for i, row in enumerate(heads):
        of = shown.where(F.col("source_key") == row.source_key).orderBy("source_file", "message_id", "place", "match_start").toLocalIterator()
        head = {"name": row["name"], "path": row.path, "found": row.found, "conversations": row.conversation_count, "messages": row.message_count, "secrets_found": row.secret_count}
        head |= {"findings": [{c: f[c] for c in reports.REPORTED} for f in of]} | ({"error": row.error} if row.error else {})
        print("    " + json.dumps(head, ensure_ascii=False) + ("," if i + 1 < len(heads) else ""))
    print("  ]\n}")
    return counts["total_secrets"]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog=reports.NAME, description="Finds secrets and personal data in chat histories and files.")
    out.add_argument("--tool", "-t", action="append", choices=list(tools.TOOLS), help="a tool to scan; may be repeated; all by default")
    out.add_argument("--days", "-d", type=int, default=30, help="days to look back, 0 for all")
    out.add_argument("--json", "-j", action="store_true", help="report as JSON")
    out.add_argument("--path", "-p", help="a file or tree to scan instead of the tools")
    out.add_argument("--verbose", "-v", action="store_true", help="list the findings, redacted")
    out.add_argument("--home", default=os.path.expanduser("~"), help="home directory of the tools")
    out.add_argument("--version", action="version", version=f"{reports.NAME} {reports.VERSION}")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a scan; 1 if it found anything, else 0."""
    options = parser().parse_args(argv)
    begun = time.monotonic()
    scope = tools.Scope(spark or get_spark(), options.home, options.days, linux=sys.platform != "darwin")
    result = scan(scope, options.tool, options.path)
    # The reports look at both several times; the files are read once, and no raw match is written.
    result = Scan(written(result.sources, "sources"), written(result.findings.drop("matched_text", "context"), "findings"), result.days)
    total = print_json(result) if options.json else print_text(result, options.verbose, options.home)
    if not options.json:
        print(f"\n{time.monotonic() - begun:.1f} s")
    return 1 if total else 0
