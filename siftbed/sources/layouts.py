"""Chat records of the tools' JSON layouts, projected to messages with VARIANT expressions.

Every layout is one expression that turns a parsed record into an array of messages, exploded once: no join, no shuffle
and one parse per record. A record that isn't valid JSON gives no message, or itself as text where a tool's files may be
plain (`fallback`). Values that should be text but are numbers or objects are skipped. Duplicate keys need
spark.sql.variant.allowDuplicateKeys, else such a record counts as invalid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftbed.functions import secrets as S

#: Elements of a list that a recursive extraction follows, and the shortest string that it skips.
LIST_LIMIT, TINY = 500, 10

_VARIANTS, _FIELDS = "array<variant>", "map<string,variant>"


def field(record: Column, path: str) -> Column:
    """The value at a path as a VARIANT; null if the field is missing, JSON's null if it is null."""
    return F.try_variant_get(record, path, "variant")


def string_of(value: Column) -> Column:
    """A JSON string as a string; null for anything else."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def elements(value: Column) -> Column:
    """The elements of a JSON array; null for anything else."""
    return F.try_variant_get(value, "$", _VARIANTS)


def values_of(value: Column) -> Column:
    """The values of a JSON object's fields; null for anything else."""
    return F.map_values(F.try_variant_get(value, "$", _FIELDS))


def json_texts(record: Column, max_depth: int = 5) -> Column:
    """All strings of a record longer than `TINY` at nesting below `max_depth`; a list is followed for `LIST_LIMIT` elements."""

    def children(value: Column) -> Column:
        return F.coalesce(F.slice(elements(value), 1, LIST_LIMIT), values_of(value), F.array(value))

    level = F.array(record)
    for _ in range(max_depth - 1):
        level = F.flatten(F.transform(level, children))
    return F.filter(F.transform(level, string_of), lambda text: F.char_length(text) > TINY)


def _message(text: Column, role: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (F.lit(None).cast("string") if role is None else role).alias("role"))


def _messages(texts: Column, role: Column | None = None) -> Column:
    """An array of texts as an array of messages; no message for null."""
    return F.coalesce(F.transform(texts, lambda text: _message(text, role)), F.array().cast("array<struct<text:string,role:string>>"))


def _longer(texts: Column, least: int) -> Column:
    return F.filter(texts, lambda text: F.char_length(text) > least)


def _text_array(value: Column, least: int = 0) -> Column:
    """A string as an array of one, if it is longer than `least`."""
    text = string_of(value)
    return F.when(F.char_length(text) > least, F.array(text))


def block_texts(content: Column, least: int = 0, bare: bool = False) -> Column:
    """The `text` of every block of a list of content blocks; with `bare`, of blocks that are strings as well."""

    def of_block(block: Column) -> Column:
        text = string_of(field(block, "$.text"))
        return F.coalesce(text, string_of(block)) if bare else text

    return _longer(F.transform(elements(content), of_block), least)


def tool_inputs(content: Column, least: int = 10) -> Column:
    """The strings directly under the `input` of every block of a list of content blocks."""
    found = F.flatten(F.transform(elements(content), lambda block: F.coalesce(values_of(field(block, "$.input")), F.array().cast(_VARIANTS))))
    return _longer(F.transform(found, string_of), least)


def timestamp_of(value: Column) -> Column:
    """A record's time: text in ISO 8601, or a number of milliseconds; null for anything else."""
    number = F.try_variant_get(value, "$", "double")
    return F.when(F.schema_of_variant(value) == "STRING", S.iso_instant(string_of(value))).otherwise(S.epoch_ms(number))


def _exploded(records: DataFrame, messages: Column, *kept: str) -> DataFrame:
    return records.select(*kept, F.posexplode(messages).alias("part", "message")).select(*kept, "part", "message.role", "message.text")


def parsed(records: DataFrame, content: str = "content") -> DataFrame:
    """Records with `record`, the parsed content; null where it isn't valid JSON. Blank ones are dropped."""
    trimmed = S.stripped(F.col(content))
    return records.where(F.char_length(trimmed) > 0).withColumn("record", F.try_parse_json(trimmed))


def display_messages(records: DataFrame, *kept: str) -> DataFrame:
    """Prompts of a command history: `display`, with its `timestamp` in milliseconds and `sessionId`."""
    v = F.col("record")
    session = F.coalesce(string_of(field(v, "$.sessionId")), F.lit("unknown"))
    rows = records.select(*kept, F.lit(0).alias("part"), F.lit("user").alias("role"), string_of(field(v, "$.display")).alias("text"), timestamp_of(field(v, "$.timestamp")).alias("ts"), session.alias("conversation_id"))
    return rows.where(F.char_length("text") > 0)


def project_messages(records: DataFrame, *kept: str, origin: str = "source_file") -> DataFrame:
    """Conversation lines: `message.content` as text or blocks, tool inputs, and a top-level `content` of queued work."""
    v = F.col("record")
    content, role = field(v, "$.message.content"), string_of(field(v, "$.message.role"))
    messages = F.concat(
        _messages(_text_array(content), role), _messages(block_texts(content), role), _messages(tool_inputs(content), role),
        _messages(_text_array(field(v, "$.content"), 20), F.lit("system")),
    )
    session = F.coalesce(string_of(field(v, "$.sessionId")), F.col(origin))
    rows = records.withColumns({"ts": timestamp_of(field(v, "$.timestamp")), "conversation_id": session})
    return _exploded(rows, messages, *kept, "ts", "conversation_id")


def history_messages(records: DataFrame, *kept: str) -> DataFrame:
    """Session files: the list `history`, or `messages` where that is missing; of each `content`, or `text`."""
    v = F.col("record")
    turns = F.coalesce(field(v, "$.history"), field(v, "$.messages"))

    def turn(one: Column) -> Column:
        return _message(string_of(F.coalesce(field(one, "$.content"), field(one, "$.text"))), string_of(field(one, "$.role")))

    found = F.filter(F.transform(elements(turns), turn), lambda m: F.char_length(m["text"]) > 0)
    return _exploded(records, found, *kept)


def typed_messages(records: DataFrame, *kept: str) -> DataFrame:
    """Lines with a `type`: response items with blocks, event messages, and inputs and outputs of tools."""
    v = F.col("record")
    kind, payload = string_of(field(v, "$.type")), field(v, "$.payload")
    tools = [F.coalesce(_text_array(field(payload, f"$.{k}")), F.transform(values_of(field(payload, f"$.{k}")), string_of), F.array().cast("array<string>")) for k in ("input", "output", "arguments")]
    messages = (
        F.when(kind == "response_item", _messages(block_texts(field(payload, "$.content"), 5), string_of(field(payload, "$.role"))))
        .when(kind == "event_msg", _messages(_text_array(field(payload, "$.message"), 5), F.lit("user")))
        .when(kind.isin("tool_call", "tool_output"), _messages(_longer(F.concat(*tools), 10), F.lit("tool")))
    )
    return _exploded(records, messages, *kept)


def session_messages(records: DataFrame, *kept: str) -> DataFrame:
    """Session details: `history` of `message` with `content` as text, blocks or strings; an index (a list) has none."""
    turns = elements(field(F.col("record"), "$.history"))

    def turn(one: Column) -> Column:
        content, role = field(one, "$.message.content"), string_of(field(one, "$.message.role"))
        return F.concat(_messages(_text_array(content), role), _messages(block_texts(content, 5, bare=True), role))

    return _exploded(records, F.flatten(F.transform(turns, turn)), *kept)


def recursive_messages(records: DataFrame, *kept: str, max_depth: int = 5, content: str = "content", fallback: int | None = None) -> DataFrame:
    """All longer strings of a record; with `fallback`, invalid JSON longer than that many characters is one text."""
    texts = json_texts(F.col("record"), max_depth)
    if fallback is not None:
        raw = F.when(F.char_length(content) > fallback, F.array(F.col(content)))
        texts = F.when(F.col("record").isNull(), raw).otherwise(texts)
    return _exploded(records, _messages(texts), *kept)
