"""Queries of the catalog and the matcher: candidates, verdicts of each filter, and findings in all messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftbed.functions import fixed_values as fixed
from siftbed.functions import secrets as S
from siftbed.operators import catalog, matching, reports
from siftbed.plans import sql
from siftbed.sources.tables import read_table


def pattern_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """All rules."""
    return catalog.catalog_frame(spark)


def patterns_by_category(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.catalog_frame(spark).groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.size("context_keywords") > 0).alias("with_keywords"), F.count("entropy_threshold").alias("with_entropy"))


def patterns_by_severity(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.catalog_frame(spark).groupBy("severity").agg(F.count("*").alias("n"))


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    return matching.candidates(read_table(spark, folder, "messages"), gated=False)


def _placed(found: DataFrame) -> DataFrame:
    ids = catalog.catalog_frame(found.sparkSession).select("place", "pattern_id")
    return found.join(F.broadcast(ids), "place")


def match_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every match of every rule in every message, before any filter."""
    return _placed(_candidates(spark, folder)).select("message_id", "pattern_id", "match_start", "matched_text").distinct()


def match_candidates_document(spark: SparkSession, folder: str) -> DataFrame:
    """Every match of every rule in the documents."""
    found = matching.candidates(read_table(spark, folder, "documents"), key="doc_id", gated=False)
    return _placed(found).select("doc_id", "pattern_id", "match_start", "matched_text")


def match_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """All matches of one rule with their places, by expressions alone: the way for a rule of a user's own in SQL."""
    rows = read_table(spark, folder, "documents").select("doc_id", F.explode(S.match_offsets(F.col("text"), F.lit("[A-Za-z]+[0-9]+"))).alias("m"))
    return rows.select("doc_id", F.col("m.start").alias("start"), F.col("m.match").alias("match"))


def match_min_len(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates by rule, and those of at least 8 characters."""
    return _placed(_candidates(spark, folder)).select("message_id", "pattern_id", "match_start", "matched_text").distinct().groupBy("pattern_id").agg(F.count("*").alias("n"), F.count_if(F.char_length("matched_text") >= 8).alias("kept"))


VERDICTS = ["no_example", "card", "email", "address", "ssn", "database", "phone", "iban", "pool", "short_key", "placeholder", "keyword", "entropy"]


def candidate_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate with the verdict of each filter."""
    judged = matching.judged(_candidates(spark, folder))
    return judged.select("message_id", "pattern_id", "match_start", "long_enough", *VERDICTS).distinct()


def context_keyword(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of rules with keywords, by whether one is near."""
    judged = matching.judged(_candidates(spark, folder)).where(F.size("context_keywords") > 0)
    return judged.select("message_id", "pattern_id", "match_start", "keyword").distinct().groupBy("pattern_id", "keyword").agg(F.count("*").alias("n"))


def entropy_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of rules with a threshold, by whether they reach it."""
    judged = matching.judged(_candidates(spark, folder)).where("entropy_threshold is not null")
    return judged.select("message_id", "pattern_id", "match_start", "entropy").distinct().groupBy("pattern_id", "entropy").agg(F.count("*").alias("n"))


def scan_findings(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of all messages: the first surviving match of each message, rule and text, with line and context."""
    found = matching.findings(read_table(spark, folder, "messages"))
    return found.select("message_id", "pattern_id", "pattern_name", "category", "severity", "redacted_text", "match_start", "line_number", "context")


def findings_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """How many surviving matches each finding stands for."""
    joined = matching.judged(_candidates(spark, folder))
    for name in matching.verdicts():
        joined = joined.where(name)
    return joined.groupBy("message_id", "pattern_id", "matched_text").agg(F.count_distinct("match_start").alias("n"), F.min("match_start").alias("first_start"))


def scan_by_severity(spark: SparkSession, folder: str) -> DataFrame:
    return reports.by_severity(matching.findings(read_table(spark, folder, "messages")))


def scan_by_rule(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of all rules, 0 for those without one: one row for each of the 322."""
    counts = matching.findings(read_table(spark, folder, "messages")).groupBy("pattern_id").agg(F.count("*").alias("n"))
    return catalog.catalog_frame(spark).select("pattern_id").join(counts, "pattern_id", "left").select("pattern_id", F.coalesce("n", F.lit(0)).alias("n"))


def anti_test_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Findings that aren't published test values, by an anti join with the published ones."""
    published = spark.createDataFrame([(v,) for v in fixed.TEST_CARDS + fixed.PUBLISHED_SSNS + fixed.PUBLISHED_IBANS], "value string")
    rows = read_table(spark, folder, "findings").select("finding_id", F.regexp_replace("matched_text", "[^0-9A-Z]", "").alias("value"))
    return rows.join(F.broadcast(published), "value", "left_anti").select("finding_id")


def anti_domains(spark: SparkSession, folder: str) -> DataFrame:
    """Address findings at domains that may name a person, by an anti join with the domains that don't."""
    domains = spark.createDataFrame([(v,) for v in fixed.IMPERSONAL_DOMAINS], "domain string")
    rows = read_table(spark, folder, "findings").where(F.contains("matched_text", F.lit("@"))).select("finding_id", F.lower(F.substring_index("matched_text", "@", -1)).alias("domain"))
    return rows.join(F.broadcast(domains), "domain", "left_anti").select("finding_id")


QUERIES = {
    f.__name__: f
    for f in (
        pattern_catalog, patterns_by_category, patterns_by_severity, match_candidates, match_candidates_document, match_offsets, match_min_len, candidate_verdicts,
        context_keyword, entropy_filter, scan_findings, findings_dedup, scan_by_severity, scan_by_rule, anti_test_cards, anti_domains,
    )
}

# The comparison: each rule is a scan of its own, as RE2 takes constant patterns only once.
_LOOKAHEAD = "voyage_api_key"


def _rule_matches(table: str, key: str) -> str:
    """Every match of every rule with its place; a regex with a look-ahead is stated without it and tested afterwards."""
    branches = []
    for rule in catalog.catalog():
        regex = rule.regex if rule.rule_id != _LOOKAHEAD else r"pa-[A-Za-z0-9_-]{43}\b"
        branches.append(f"SELECT {key}, {rule.place} AS rule, {sql.text(regex)} AS rx, text, regexp_extract_all(text, {sql.text(regex)}) AS found, string_split_regex(text, {sql.text(regex)}) AS gaps FROM texts WHERE regexp_matches(text, {sql.text(regex)})")
    offset = "list_sum(list_transform(gaps[:k], lambda g: length(g))) + coalesce(list_sum(list_transform(found[: k - 1], lambda m: length(m))), 0)"
    look = f"(rule <> {next(r.place for r in catalog.catalog() if r.rule_id == _LOOKAHEAD)} OR (length(regexp_replace(m[4:], '[^A-Z]', '', 'g')) >= 2 AND length(regexp_replace(m[4:], '[^0-9]', '', 'g')) >= 2))"
    return (
        f"texts AS (SELECT DISTINCT {key}, text FROM {table} WHERE text <> ''), hits AS ({' UNION ALL '.join(branches)}), "
        f"placed AS (SELECT {key}, rule, text, found[k] AS m, ({offset})::INT AS start FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM hits)), "
        f"candidates AS (SELECT * FROM placed WHERE {look})"
    )


def _rules() -> str:
    rows = ", ".join(
        f"({r.place}, {sql.text(r.rule_id)}, {sql.text(r.name)}, {sql.text(r.category)}, {sql.text(r.severity)}, {'[' + ', '.join(map(sql.text, r.keywords)) + ']'}::VARCHAR[], {'NULL' if r.entropy is None else r.entropy}::DOUBLE)"
        for r in catalog.catalog()
    )
    return f"rules AS (SELECT * FROM (VALUES {rows}) AS r(rule, pattern_id, pattern_name, category, severity, keywords, threshold))"


def _unless(rules: list[str], turned_down: str) -> str:
    return f"NOT (pattern_id IN {sql.values(rules)} AND {turned_down})"


_SQL_VERDICTS = {
    "long_enough": "length(m) >= 8",
    "no_example": f"(pattern_id IN {sql.values(catalog.OFFICIALLY_EXAMPLES)} OR NOT {sql.example('m')})",
    "card": _unless(["credit_card"], f"({sql.test_card('m')} OR NOT {sql.luhn('m')})"),
    "email": _unless(["email_address"], sql.impersonal_email("m")),
    "address": _unless(["basic_auth_url"], sql.local_address("m")),
    "ssn": _unless(["ssn"], sql.impossible_ssn("m")),
    "database": _unless(matching.DATABASE_RULES, f"({sql.example_database('m')} OR {sql.regex_literal('m')})"),
    "phone": _unless(["phone_number_us", "phone_number_intl"], sql.fictional_phone("m")),
    "iban": _unless(["iban"], sql.published_iban("m")),
    "pool": _unless(["aws_cognito_pool"], sql.sample_pool("m")),
    "short_key": _unless(["flutterwave_encryption_key"], sql.goes_on_as_key("text[start + length(m) + 1 : start + length(m) + 25]")),
    "placeholder": _unless(["generic_secret"], sql.placeholder("m")),
    "keyword": sql.keyword(sql.surroundings("text", "start", "length(m)"), "keywords"),
    "entropy": f"(threshold IS NULL OR {sql.entropy(sql.secret_value('m'))} >= threshold)",
}
_MATCHES = _rule_matches("messages", "message_id")
_JUDGED = f"WITH {_MATCHES}, {_rules()}, judged AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _SQL_VERDICTS.items())} FROM candidates JOIN rules USING (rule)), kept AS (SELECT * FROM judged WHERE {' AND '.join(_SQL_VERDICTS)})"
_FINDINGS = f"{_JUDGED}, first AS (SELECT *, row_number() OVER (PARTITION BY message_id, rule, m ORDER BY start) AS nth FROM kept)"

_CATALOG_ROWS = ", ".join(
    f"({r.place}, {sql.text(r.rule_id)}, {sql.text(r.name)}, {sql.text(r.category)}, {sql.text(r.severity)}, {catalog.SEVERITIES.index(r.severity)}, {sql.text(r.regex)}, "
    f"[{', '.join(map(sql.text, sorted(catalog.anchors(r.regex))))}]::VARCHAR[], [{', '.join(map(sql.text, r.keywords))}]::VARCHAR[], {'NULL' if r.entropy is None else r.entropy}::DOUBLE, {r.rule_id in catalog.OFFICIALLY_EXAMPLES})"
    for r in catalog.catalog()
)
SQL = {
    "pattern_catalog": f"SELECT * FROM (VALUES {_CATALOG_ROWS}) AS c(place, pattern_id, pattern_name, category, severity, severity_rank, regex, anchors, context_keywords, entropy_threshold, skip_example)",
    "patterns_by_category": f"WITH {_rules()} SELECT category, count(*) AS n, count(*) FILTER (WHERE len(keywords) > 0) AS with_keywords, count(threshold) AS with_entropy FROM rules GROUP BY category",
    "patterns_by_severity": f"WITH {_rules()} SELECT severity, count(*) AS n FROM rules GROUP BY severity",
    "match_candidates": f"WITH {_MATCHES}, {_rules()} SELECT message_id, pattern_id, start AS match_start, m AS matched_text FROM candidates JOIN rules USING (rule)",
    "match_candidates_document": f"WITH {_rule_matches('documents', 'doc_id')}, {_rules()} SELECT doc_id, pattern_id, start AS match_start, m AS matched_text FROM candidates JOIN rules USING (rule)",
    "match_offsets": "SELECT doc_id, (list_sum(list_transform(gaps[:k], lambda g: length(g))) + coalesce(list_sum(list_transform(found[: k - 1], lambda m: length(m))), 0))::INT AS start, found[k] AS match FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+[0-9]+') AS found, string_split_regex(text, '[A-Za-z]+[0-9]+') AS gaps FROM documents))",
    "match_min_len": f"WITH {_MATCHES}, {_rules()} SELECT pattern_id, count(*) AS n, count(*) FILTER (WHERE length(m) >= 8) AS kept FROM candidates JOIN rules USING (rule) GROUP BY pattern_id",
    "candidate_verdicts": f"{_JUDGED} SELECT message_id, pattern_id, start AS match_start, long_enough, {', '.join(VERDICTS)} FROM judged",
    "context_keyword": f"{_JUDGED} SELECT pattern_id, keyword, count(*) AS n FROM judged WHERE len(keywords) > 0 GROUP BY ALL",
    "entropy_filter": f"{_JUDGED} SELECT pattern_id, entropy, count(*) AS n FROM judged WHERE threshold IS NOT NULL GROUP BY ALL",
    "scan_findings": f"{_FINDINGS} SELECT message_id, pattern_id, pattern_name, category, severity, {sql.redacted('m')} AS redacted_text, start AS match_start, {sql.line_number('text', 'start')}::INT AS line_number, {sql.context_line('text', 'start', 'm')} AS context FROM first WHERE nth = 1",
    "findings_dedup": f"{_JUDGED} SELECT message_id, pattern_id, m AS matched_text, count(*) AS n, min(start) AS first_start FROM kept GROUP BY ALL",
    "scan_by_severity": f"{_FINDINGS} SELECT severity, count(*) AS n FROM first WHERE nth = 1 GROUP BY severity",
    "scan_by_rule": f"{_FINDINGS} SELECT r.pattern_id, count(f.rule) AS n FROM rules r LEFT JOIN (SELECT * FROM first WHERE nth = 1) f USING (rule) GROUP BY r.pattern_id",
    "anti_test_cards": f"SELECT finding_id FROM findings WHERE coalesce(regexp_replace(matched_text, '[^0-9A-Z]', '', 'g') NOT IN {sql.values(fixed.TEST_CARDS + fixed.PUBLISHED_SSNS + fixed.PUBLISHED_IBANS)}, true)",
    "anti_domains": f"SELECT finding_id FROM findings WHERE contains(matched_text, '@') AND lower(string_split(matched_text, '@')[-1]) NOT IN {sql.values(fixed.IMPERSONAL_DOMAINS)}",
}
