"""Queries of the scalar functions: over the matched texts of all findings and a few values at the edges of each."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftbed.functions import fixed_values as fixed
from siftbed.functions import secrets as S
from siftbed.plans import sql
from siftbed.sources import files
from siftbed.sources.tables import read_table

_AT = "@"
# Values that the tables lack; whatever looks like a key is put together here.
EDGES = [
    "", "aaaa", "aabb", "abcdefgh", "abcde", "abcdefghijkl", "abcdefghijklm", "K=v", 'K: "v"', "K=v==", "a=b=c", "key = './x'",
    *fixed.TEST_CARDS, "4539578763621486", "4539578763621487", "378282246310006", "123456789012",
    *fixed.PUBLISHED_SSNS, "078-05-1120", "000-12-3456", "666-12-3456", "899-12-3456", "900-12-3456", "123-00-4567", "123-45-0000", "444-44-4444",
    *fixed.PUBLISHED_IBANS, "DE89 3704 0044 0532 0130 00", "DE02120300000000202051",
    *(f"postgres://{u}:{p}@{h}/x" for u, p, h in (("user", "password", "prod-1"), ("user", "Zk3", "prod-1"), ("svc", "Zk3", "localhost"), ("svc", "Zk3", "db"), ("svc", "Zk3", "[::1]"), ("SVC", "Zk3", "DB.example.com"))),
    "redis://:" + "pw" + _AT + "localhost", r"mysql://[^:]+:[^@]+@[^\s]+", "https://a:b" + _AT + "localhost/", "https://x-access-token:b" + _AT + "h/", "https://a:b" + _AT + "h/",
    *(f"{local}{_AT}{domain}" for local, domain in (("noreply", "a.de"), ("abbot", "a.de"), ("info", "a.de"), ("jo", "gmail.com"), ("jo", "mail.gmail.com"), ("jo", "a.de"))),
    "(555) 123-4567", "212-555-0199", "+1 212 456 7890", "555-1234", "555123", "+49 30 555 12345",
    "us-east-1_abc123def", "us-east-1_Zk39QmPw2", "secret: changeme", "token=$TOKEN", "token=process.env.T", "pwd = /etc/x", "auth: some_name_here", "auth: Zk39QmPw2rT7yU1iO5pL",
    "key=ABCDEFGH", "key=ABCDEFG", "key=HGFEDCBA", "sk_live_abcdefgh9", "x=12345678", "0a0b0c0d", "1111111", "11111111", "11223344", "1a2b3c4d", "9f9f9f9f9", "01030507",
    fixed.SYNTHETIC_FRAGMENTS[0] + fixed.SYNTHETIC_FRAGMENTS[1], fixed.SYNTHETIC_FRAGMENTS[2] * 2, fixed.SYNTHETIC_FRAGMENTS[3], "a" * 25, "k=" + "ab" * 12, "é😀é", "YOUR_KEY", "latest-db-1",
]


def _values(spark: SparkSession, folder: str) -> DataFrame:
    edges = spark.createDataFrame([(-i - 1, v) for i, v in enumerate(EDGES)], "id bigint, text string")
    return read_table(spark, folder, "findings").select(F.col("finding_id").alias("id"), F.col("matched_text").alias("text")).unionByName(edges)


_VALUES = "(SELECT finding_id AS id, matched_text AS text FROM findings UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}, {sql.text(v)})" for i, v in enumerate(EDGES)) + ") AS e(id, text))"


def _scalar(function: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return _values(spark, folder).select("id", function(F.col("text")).alias("result"))

    query.__doc__ = (function.__doc__ or "").split("\n")[0]
    return query


_SCALARS: dict[str, tuple[Callable[[Column], Column], str]] = {
    "x01_entropy": (lambda c: F.round(S.entropy(c), 6), f"round({sql.entropy('text')}, 6)"),
    "x02_redact": (S.redacted, sql.redacted("text")),
    "x03_luhn": (S.passes_luhn, sql.luhn("text")),
    "x04_fp_db_uri": (S.is_example_database, sql.example_database("text")),
    "x05_fp_ssn": (S.is_impossible_ssn, sql.impossible_ssn("text")),
    "x06_likely_example": (S.is_example, sql.example("text")),
    "x07_seq_chars": (S.has_run, sql.run("text")),
    "x08_seq_hex": (S.has_stepped_hex, sql.stepped_hex("text")),
    "x09_fixture_fragments": (S.has_fragments, sql.fragments("text")),
    "x10_fp_generic": (S.is_placeholder, sql.placeholder("text")),
    "x11_fp_email": (S.is_impersonal_email, sql.impersonal_email("text")),
    "x12_fp_phone": (S.is_fictional_phone, sql.fictional_phone("text")),
    "x13_fp_iban": (S.is_published_iban, sql.published_iban("text")),
    "x14_fp_url": (S.is_local_address, sql.local_address("text")),
    "x15_test_card": (S.is_test_card, sql.test_card("text")),
    "x16_fp_regex_literal": (S.is_regex_literal, sql.regex_literal("text")),
    "x17_sample_pool": (S.is_sample_pool, sql.sample_pool("text")),
    "x18_longer_key": (lambda c: S.goes_on_as_key(F.concat(F.substring(F.sha2(c, 256), 1, 20), F.when(F.crc32(c) % 2 == 0, "-X").otherwise("-"))), None),
    "x21_secret_value": (S.secret_value, sql.secret_value("text")),
}

QUERIES = {name: _scalar(function) for name, (function, _) in _SCALARS.items()}
SQL = {name: f"SELECT id, {expression} AS result FROM {_VALUES}" for name, (_, expression) in _SCALARS.items() if expression}


def x18_longer_key(spark: SparkSession, folder: str) -> DataFrame:
    """Short keys that go on as the longer secret key, over texts that start 0 to 3 characters before the match's end."""
    v = _values(spark, folder).where(F.col("text").isNotNull())
    after = F.concat(F.regexp_replace(F.col("text"), "[^a-hA-H0-9]", ""), F.lit("0a1B2c3D4e5F6a7B8c9D"))
    return v.select("id", S.goes_on_as_key(F.concat(F.substring(after, 1, 20), F.when(F.col("id") % 2 == 0, "-X").otherwise("-Y"))).alias("result"))


QUERIES["x18_longer_key"] = x18_longer_key
SQL["x18_longer_key"] = f"""SELECT id, {sql.goes_on_as_key("(regexp_replace(text, '[^a-hA-H0-9]', '', 'g') || '0a1B2c3D4e5F6a7B8c9D')[:20] || CASE WHEN id % 2 = 0 THEN '-X' ELSE '-Y' END")} AS result FROM {_VALUES} WHERE text IS NOT NULL"""


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """Findings at their first place in the text of their message; one delivery of each message."""
    messages = read_table(spark, folder, "messages").select("message_id", "text").dropDuplicates(["message_id"])
    joined = read_table(spark, folder, "findings").where(F.char_length("matched_text") > 0).join(messages, "message_id")
    placed = joined.withColumn("at", F.instr(F.col("text"), F.col("matched_text")) - 1)
    return placed.where(F.col("at") >= 0).select("finding_id", "pattern_id", "matched_text", "text", "at")


_PLACED = """(SELECT finding_id, pattern_id, matched_text, text, instr(text, matched_text) - 1 AS place FROM findings
JOIN (SELECT DISTINCT message_id, text FROM messages) USING (message_id) WHERE matched_text <> '' AND contains(text, matched_text))"""


def x19_context_window(spark: SparkSession, folder: str) -> DataFrame:
    """Findings with 200 characters on each side."""
    return _placed(spark, folder).select("finding_id", S.surroundings(F.col("text"), F.col("at"), F.char_length("matched_text")).alias("result"))


def x20_context_keyword(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a keyword of any rule stands within 200 characters of a finding, for all rules with keywords."""
    window = S.surroundings(F.col("text"), F.col("at"), F.char_length("matched_text"))
    rules = read_table(spark, folder, "patterns").select(F.col("pattern_id").alias("rule"), "context_keywords")
    near = _placed(spark, folder).join(F.broadcast(rules), F.col("rule") == F.trim("pattern_id"))
    return near.select("finding_id", "rule", S.has_keyword(window, F.col("context_keywords")).alias("result"))


def x22_line_number(spark: SparkSession, folder: str) -> DataFrame:
    """The line of each finding in its message."""
    return _placed(spark, folder).select("finding_id", S.line_number(F.col("text"), F.col("at")).alias("result"))


def x23_context_line(spark: SparkSession, folder: str) -> DataFrame:
    """The redacted line of each finding."""
    return _placed(spark, folder).select("finding_id", S.context_line(F.col("text"), F.col("at"), F.col("matched_text")).alias("result"))


def x24_home_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of sources with one home directory shortened."""
    return read_table(spark, folder, "sources").select("source_key", S.with_home(F.col("path"), "/home/corvari20").alias("result"))


def x25_grouped_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Message counts with commas between thousands, and the rank of severities for presentation."""
    return read_table(spark, folder, "scan_results").select("scan_id", S.grouped(F.coalesce(F.col("message_count"), F.lit(0)) * 1000).alias("result"))


def x26_substr_count(spark: SparkSession, folder: str) -> DataFrame:
    """How often a marker stands in a document, at least 1."""
    return read_table(spark, folder, "documents").select("doc_id", S.occurrences(F.col("text"), "the ").alias("result"))


def x27_conv_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations estimated from messages, one for ten."""
    return read_table(spark, folder, "scan_results").select("scan_id", S.conversation_estimate(F.col("message_count"), 10).alias("result"))


AS_OF = datetime(2025, 6, 1, tzinfo=timezone.utc)


def f01_lookback_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Scans of the 90 days before an instant; those without a time stay."""
    return read_table(spark, folder, "scan_results").where(S.within_days(F.col("scanned_at"), 90, F.lit(AS_OF))).select("scan_id")


def f04_keyword_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a word of chats in any case."""
    words = ["message", "prompt", "completion", "chat", "conversation"]
    return read_table(spark, folder, "documents").where(files.has_keyword(F.col("text"), words)).select("doc_id")


def f05_ext_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of files whose extension a scan of a tree reads."""
    return read_table(spark, folder, "findings").where(files.is_scanned(F.col("source_file"))).select("finding_id", files.extension(F.col("source_file")).alias("ext"))


def f06_pruned_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Whether a scan of a tree would enter the directory of each finding's file."""
    return read_table(spark, folder, "findings").where("source_file is not null").select("finding_id", files.is_pruned(F.col("source_file")).alias("pruned"))


def f08_name_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Sources by a part of their name, and files by suffix."""
    rows = read_table(spark, folder, "raw_sessions")
    return rows.where(F.contains(F.lower("source_file"), F.lit("copilot")) | F.endswith(F.col("source_file"), F.lit(".jsonl"))).select("raw_id")


def f09_min_length(spark: SparkSession, folder: str) -> DataFrame:
    """Messages by the least lengths that layouts ask for."""
    n = F.char_length("text")
    return read_table(spark, folder, "messages").groupBy().agg(*[F.sum((n > k).cast("int")).alias(f"longer_{k}") for k in (5, 10, 20)])


def m08_strip_blank(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of messages that aren't blank, stripped, counted per message."""
    lines = F.filter(F.transform(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n"), S.stripped), lambda x: x != "")
    rows = read_table(spark, folder, "messages").select("message_id", "text").distinct()
    return rows.where(F.col("text").isNotNull()).select("message_id", F.size(lines).alias("lines"), F.array_join(lines, "|").alias("joined"))


def m10_truncate_text(spark: SparkSession, folder: str) -> DataFrame:
    """The first 1,000 characters of each document: the operator for size limits of readers."""
    return read_table(spark, folder, "documents").select("doc_id", F.substring("text", 1, 1000).alias("text"))


def m11_epoch_ms(spark: SparkSession, folder: str) -> DataFrame:
    """Instants of all values that are 13 digits."""
    rows = read_table(spark, folder, "messages").where(F.col("ts_raw").rlike(r"^\d{13}$"))
    return rows.select("message_id", F.unix_micros(S.epoch_ms(F.col("ts_raw").cast("bigint"))).alias("us")).distinct()


def m12_iso_ts(spark: SparkSession, folder: str) -> DataFrame:
    """Instants of all values that are ISO 8601 in UTC or with an offset."""
    rows = read_table(spark, folder, "messages").where(F.col("ts_raw").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"))
    return rows.select("message_id", F.unix_micros(S.iso_instant(F.col("ts_raw"))).alias("us")).where("us is not null").distinct()


def m13_valid_text(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with two bytes appended that are no UTF-8: each becomes a replacement character."""
    raw = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FFFE"))).cast("string")
    return read_table(spark, folder, "documents").select("doc_id", F.make_valid_utf8(raw).alias("text"))


_FUNCTIONS = [
    m13_valid_text,
    x19_context_window, x20_context_keyword, x22_line_number, x23_context_line, x24_home_paths, x25_grouped_numbers, x26_substr_count, x27_conv_estimate,
    f01_lookback_filter, f04_keyword_gate, f05_ext_filter, f06_pruned_paths, f08_name_filter, f09_min_length, m08_strip_blank, m10_truncate_text, m11_epoch_ms, m12_iso_ts,
]
QUERIES |= {f.__name__: f for f in _FUNCTIONS}
_EXT = "lower(regexp_extract(source_file, '[^/\\\\](\\.[^./\\\\]+)$', 1))"
SQL |= {
    "x19_context_window": f"SELECT finding_id, {sql.surroundings('text', 'place', 'length(matched_text)')} AS result FROM {_PLACED}",
    "x20_context_keyword": f"SELECT finding_id, p.pattern_id AS rule, {sql.keyword(sql.surroundings('text', 'place', 'length(matched_text)'), 'context_keywords')} AS result FROM {_PLACED} f JOIN patterns p ON p.pattern_id = trim(f.pattern_id)",
    "x22_line_number": f"SELECT finding_id, {sql.line_number('text', 'place')} AS result FROM {_PLACED}",
    "x23_context_line": f"SELECT finding_id, {sql.context_line('text', 'place', 'matched_text')} AS result FROM {_PLACED}",
    "x24_home_paths": "SELECT source_key, replace(path, '/home/corvari20', '~') AS result FROM sources",
    "x25_grouped_numbers": "SELECT scan_id, format('{:,}', coalesce(message_count, 0) * 1000) AS result FROM scan_results",
    "x26_substr_count": "SELECT doc_id, greatest((length(text) - length(replace(text, 'the ', ''))) // 4, 1)::INT AS result FROM documents",
    "x27_conv_estimate": "SELECT scan_id, CASE WHEN message_count = 0 THEN 0 ELSE CASE WHEN message_count IS NOT NULL THEN greatest(message_count // 10, 1) ELSE 1 END END::BIGINT AS result FROM scan_results",
    "f01_lookback_filter": "SELECT scan_id FROM scan_results WHERE scanned_at IS NULL OR scanned_at >= TIMESTAMPTZ '2025-06-01 00:00:00+00' - INTERVAL 90 DAY",
    "f04_keyword_gate": "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)message|prompt|completion|chat|conversation')",
    "f05_ext_filter": f"SELECT finding_id, {_EXT} AS ext FROM findings WHERE {_EXT} IN {sql.values([*files.SCANNED_EXTENSIONS, ''])}",
    "f06_pruned_paths": "SELECT finding_id, len(list_filter(string_split(replace(source_file, '\\', '/'), '/')[:-2], lambda d: (d[1] = '.' AND length(d) > 1) OR d IN " + sql.values(files.PRUNED_DIRECTORIES) + ")) > 0 AS pruned FROM findings WHERE source_file IS NOT NULL",
    "f08_name_filter": "SELECT raw_id FROM raw_sessions WHERE contains(lower(source_file), 'copilot') OR suffix(source_file, '.jsonl')",
    "f09_min_length": "SELECT " + ", ".join(f"count(*) FILTER (WHERE length(text) > {k})::BIGINT AS longer_{k}" for k in (5, 10, 20)) + " FROM messages",
    "m08_strip_blank": "SELECT message_id, len(l)::INT AS lines, array_to_string(l, '|') AS joined FROM (SELECT message_id, list_filter(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: " + sql.stripped("x") + "), lambda x: x <> '') AS l FROM (SELECT DISTINCT message_id, text FROM messages WHERE text IS NOT NULL))",
    "m13_valid_text": "SELECT doc_id, text || chr(65533) || chr(65533) AS text FROM documents",
    "m10_truncate_text": "SELECT doc_id, text[:1000] AS text FROM documents",
    "m11_epoch_ms": "SELECT DISTINCT message_id, ts_raw::BIGINT * 1000 AS us FROM messages WHERE regexp_full_match(ts_raw, '\\d{13}')",
    "m12_iso_ts": "SELECT DISTINCT message_id, epoch_us(TRY_CAST(ts_raw AS TIMESTAMPTZ)) AS us FROM messages WHERE TRY_CAST(ts_raw AS TIMESTAMPTZ) IS NOT NULL AND regexp_full_match(ts_raw, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d{1,6})?(Z|[+-]\\d{2}:\\d{2})')",
}
