"""Queries of the JSON layouts over exported sessions; an export that is a list holds one record per element."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftbed.functions import secrets as S
from siftbed.sources import layouts as L
from siftbed.sources.tables import read_table


def _exports(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "raw_sessions").withColumnRenamed("payload", "content")
    return L.parsed(rows)


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: elements of a list, or the export itself."""
    each = F.coalesce(L.elements(F.col("record")), F.array("record"))
    return _exports(spark, folder).where("record is not null").select("raw_id", "source_key", "source_file", F.posexplode(each).alias("nth", "record"))


_KEPT = ("raw_id", "nth")


def json_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Strings longer than 10 characters to depth 5."""
    return L.recursive_messages(_exports(spark, folder), "raw_id").groupBy("raw_id", "text").agg(F.count("*").alias("n"))


def json_texts_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same of single records, to depth 4."""
    return L.recursive_messages(_records(spark, folder), *_KEPT, max_depth=4).groupBy(*_KEPT, "text").agg(F.count("*").alias("n"))


def json_texts_flat(spark: SparkSession, folder: str) -> DataFrame:
    """A number in the properties of events, read through VARIANT."""
    rows = read_table(spark, folder, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return rows.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


def json_malformed(spark: SparkSession, folder: str) -> DataFrame:
    """Exports that aren't JSON, as plain text where they are longer than 20 characters."""
    found = L.recursive_messages(_exports(spark, folder).where("record is null"), "raw_id", fallback=20)
    return found.select("raw_id", "text")


def coalesce_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Session files: history or messages, content or text."""
    return L.history_messages(_exports(spark, folder), "raw_id").select("raw_id", "part", "role", "text")


def blocks_explode(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation lines: text, content blocks, tool inputs and queued content."""
    return L.project_messages(_records(spark, folder), *_KEPT).select(*_KEPT, "role", "text", "conversation_id")


def src_jsonl_history(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts of command histories."""
    rows = L.display_messages(_records(spark, folder), *_KEPT)
    return rows.select(*_KEPT, "text", "conversation_id", F.unix_micros("ts").alias("us"))


def src_typed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with a type: blocks, events, tool inputs and outputs."""
    return L.typed_messages(_records(spark, folder), *_KEPT).select(*_KEPT, "role", "text")


def src_session_details(spark: SparkSession, folder: str) -> DataFrame:
    """Session details with nested messages."""
    return L.session_messages(_exports(spark, folder), "raw_id").select("raw_id", "role", "text")


def src_json_recursive(spark: SparkSession, folder: str) -> DataFrame:
    """The recursive family with its keyword gate: messages per source."""
    from siftbed.sources.files import has_keyword
    from siftbed.sources.tools import CURSOR_WORDS

    gated = _exports(spark, folder).where(has_keyword(F.col("content"), CURSOR_WORDS))
    rows = L.recursive_messages(gated, "raw_id", "source_key", fallback=-1)
    return rows.groupBy("source_key").agg(F.count("*").alias("messages"), S.conversation_estimate(F.count("*"), 10).alias("conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        json_texts, json_texts_lines, json_texts_flat, json_malformed, coalesce_fields, blocks_explode, src_jsonl_history, src_typed_lines, src_session_details, src_json_recursive,
    )
}

_STEPS = r"""\.("(\\.|[^"\\])*"|[^.\["]+)|\[[0-9]+\]"""
_VALID = "valid AS (SELECT raw_id, source_key, source_file, payload::JSON AS j FROM raw_sessions WHERE json_valid(payload))"
_RECORDS = f"WITH {_VALID}, records AS (SELECT raw_id, source_file, nth - 1 AS nth, l[nth] AS r FROM (SELECT *, unnest(range(1, len(l) + 1)) AS nth FROM (SELECT raw_id, source_file, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[*]') ELSE [j] END AS l FROM valid)))"


def _tree(source: str, keys: str, value: str, depth: int) -> str:
    leaves = f"SELECT {keys}, t.atom ->> '$' AS text, len(regexp_extract_all(t.fullkey, '{_STEPS}')) AS depth FROM {source}, json_tree({value}) t WHERE t.type = 'VARCHAR'"
    return f"SELECT {keys}, text, count(*) AS n FROM ({leaves}) WHERE depth < {depth} AND length(text) > 10 GROUP BY ALL"


def _string(value: str) -> str:
    return f"CASE WHEN json_type({value}) = 'VARCHAR' THEN {value} ->> '$' END"


def _unnested(value: str) -> str:
    return f"unnest(CASE WHEN json_type({value}) = 'ARRAY' THEN json_extract({value}, '$[*]') ELSE [] END)"


_CONTENT = "json_extract(r, '$.message.content')"
_ROLE = _string("json_extract(r, '$.message.role')")
_SESSION = f"coalesce({_string(chr(106) + 'son_extract(r, ' + chr(39) + '$.sessionId' + chr(39) + ')')}, source_file)"
_MS = "json_extract(r, '$.timestamp')"
SQL = {
    "json_texts": f"WITH {_VALID} " + _tree("valid", "raw_id", "j", 5),
    "json_texts_lines": f"{_RECORDS} " + _tree("records", "raw_id, nth", "r", 4).replace("nth,", "nth::INT AS nth,", 1),
    "json_texts_flat": "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events",
    "json_malformed": "SELECT raw_id, payload AS text FROM raw_sessions WHERE NOT json_valid(payload) AND length(payload) > 20 AND trim(payload) <> ''",
    "coalesce_fields": f"WITH {_VALID}, turns AS (SELECT raw_id, unnest(CASE WHEN json_type(h) = 'ARRAY' THEN json_extract(h, '$[*]') ELSE [] END) AS m FROM (SELECT raw_id, coalesce(json_extract(j, '$.history'), json_extract(j, '$.messages')) AS h FROM valid)), "
    f"texts AS (SELECT raw_id, {_string('json_extract(m, ' + chr(39) + '$.role' + chr(39) + ')')} AS role, {_string('c')} AS text, rn FROM (SELECT *, coalesce(json_extract(m, '$.content'), json_extract(m, '$.text')) AS c, row_number() OVER () AS rn FROM turns)) "
    "SELECT raw_id, (row_number() OVER (PARTITION BY raw_id ORDER BY rn) - 1)::INT AS part, role, text FROM texts WHERE text <> ''",
    "blocks_explode": f"{_RECORDS}, blocks AS (SELECT raw_id, nth, {_ROLE} AS role, {_SESSION} AS session, {_unnested(_CONTENT)} AS b FROM records), "
    f"inputs AS (SELECT raw_id, nth, role, session, {_string('t.value')} AS text FROM blocks, json_each(CASE WHEN json_type(json_extract(b, '$.input')) = 'OBJECT' THEN json_extract(b, '$.input') END) t), "
    f"found AS (SELECT raw_id, nth, {_ROLE} AS role, {_string(_CONTENT)} AS text, {_SESSION} AS session, 0 AS least FROM records "
    f"UNION ALL SELECT raw_id, nth, role, {_string('json_extract(b, ' + chr(39) + '$.text' + chr(39) + ')')}, session, 0 FROM blocks "
    "UNION ALL SELECT raw_id, nth, role, text, session, 10 FROM inputs "
    f"UNION ALL SELECT raw_id, nth, 'system', {_string('json_extract(r, ' + chr(39) + '$.content' + chr(39) + ')')}, {_SESSION}, 20 FROM records) "
    "SELECT raw_id, nth::INT AS nth, role, text, session AS conversation_id FROM found WHERE length(text) > least",
    "src_jsonl_history": f"{_RECORDS} SELECT raw_id, nth::INT AS nth, r ->> '$.display' AS text, coalesce({_string('json_extract(r, ' + chr(39) + '$.sessionId' + chr(39) + ')')}, 'unknown') AS conversation_id, "
    f"CASE WHEN json_type({_MS}) = 'VARCHAR' THEN epoch_us(TRY_CAST(r ->> '$.timestamp' AS TIMESTAMPTZ)) ELSE ({_MS}::DOUBLE * 1000)::BIGINT END AS us FROM records WHERE json_type(json_extract(r, '$.display')) = 'VARCHAR' AND r ->> '$.display' <> ''",
}


def _at(value: str, path: str) -> str:
    return f"json_extract({value}, '{path}')"


_PAYLOAD = _at("r", "$.payload")
_HISTORY = _at("j", "$.history")
_TOOL_VALUES = " UNION ALL ".join(
    f"SELECT raw_id, nth, 'tool' AS role, {_string(_at(_PAYLOAD, '$.' + k))} AS text, 10 AS least, kind FROM typed UNION ALL "
    f"SELECT raw_id, nth, 'tool', {_string('t.value')}, 10, kind FROM typed, json_each(CASE WHEN json_type({_at(_PAYLOAD, '$.' + k)}) = 'OBJECT' THEN {_at(_PAYLOAD, '$.' + k)} END) t"
    for k in ("input", "output", "arguments")
)
_WORDS = "(?i)message|prompt|completion|chat|conversation"
SQL |= {
    "src_typed_lines": f"{_RECORDS}, typed AS (SELECT *, {_string(_at('r', '$.type'))} AS kind FROM records), blocks AS (SELECT raw_id, nth, kind, {_string(_at(_PAYLOAD, '$.role'))} AS role, {_unnested(_at(_PAYLOAD, '$.content'))} AS b FROM typed), "
    f"found AS (SELECT raw_id, nth, role, {_string(_at('b', '$.text'))} AS text, 5 AS least, kind FROM blocks WHERE kind = 'response_item' "
    f"UNION ALL SELECT raw_id, nth, 'user', {_string(_at(_PAYLOAD, '$.message'))}, 5, kind FROM typed WHERE kind = 'event_msg' "
    f"UNION ALL SELECT * FROM ({_TOOL_VALUES}) WHERE kind IN ('tool_call', 'tool_output')) SELECT raw_id, nth::INT AS nth, role, text FROM found WHERE length(text) > least",
    "src_session_details": f"WITH {_VALID}, turns AS (SELECT raw_id, {_unnested(_HISTORY)} AS m FROM valid), contents AS (SELECT raw_id, {_string(_at('m', '$.message.role'))} AS role, {_at('m', '$.message.content')} AS c FROM turns), "
    f"blocks AS (SELECT raw_id, role, {_unnested('c')} AS b FROM contents), "
    f"found AS (SELECT raw_id, role, {_string('c')} AS text, 0 AS least FROM contents UNION ALL SELECT raw_id, role, coalesce({_string(_at('b', '$.text'))}, {_string('b')}), 5 FROM blocks) "
    "SELECT raw_id, role, text FROM found WHERE length(text) > least",
    "src_json_recursive": f"WITH gated AS (SELECT * FROM raw_sessions WHERE trim(payload, chr(32) || chr(9) || chr(10) || chr(13)) <> '' AND regexp_matches(payload, '{_WORDS}')), valid AS (SELECT raw_id, source_key, payload::JSON AS j FROM gated WHERE json_valid(payload)), "
    f"leaves AS (SELECT source_key, t.atom ->> '$' AS text, len(regexp_extract_all(t.fullkey, '{_STEPS}')) AS depth FROM valid, json_tree(j) t WHERE t.type = 'VARCHAR'), "
    "texts AS (SELECT source_key FROM leaves WHERE depth < 5 AND length(text) > 10 UNION ALL SELECT source_key FROM gated WHERE NOT json_valid(payload)) "
    "SELECT source_key, count(*) AS messages, greatest(count(*) // 10, 1)::BIGINT AS conversations FROM texts GROUP BY source_key",
}

# Texts of the flat tables straight from the documents: the path of every string, its nearest key and its nearest element.
_STRINGS = "SELECT raw_id, source_file, replace(regexp_replace(t.fullkey, '^\\$\\.?', ''), '\"', '') AS text_path, t.atom ->> '$' AS text FROM valid, json_tree(j) t WHERE t.type = 'VARCHAR'"
_KEYS = "('text', 'content', 'display', 'message', 'prompt', 'output', 'arguments')"
_IS_TEXT = f"text <> '' AND (regexp_matches(text_path, '(^|[.])input([.\\[]|$)') OR regexp_extract(text_path, '(?:^|[.])([^.\\[\\]]+)(?:\\[[0-9]+\\])*$', 1) IN {_KEYS})"
_PARENT = "regexp_extract(text_path, '^(.*\\])[.]', 1) AS parent_path"
TABLES_SQL = {
    "p5_found": f"WITH {_VALID} SELECT DISTINCT raw_id, text_path, {_PARENT} FROM ({_STRINGS}) WHERE {_IS_TEXT}",
    "p5_messages": f"WITH {_VALID} SELECT raw_id, text_path, {_PARENT}, source_file, text FROM ({_STRINGS}) WHERE {_IS_TEXT}",
}
