"""Deeply nested JSON records, turned into related flat tables by shared inlining.

The schema of the records is a graph of node types: an object or scalar is of the type of the key it stands under, with
a pair of brackets for each array around it (`content[]`), and the top of a record is of the type `$`. Elements of
arrays are repeated and get tables of their own; so do types found under several parents (shared), which includes every
type found below itself (recursive), since it is also entered from elsewhere. Everything else is a single descendant and
is inlined as columns into the row of the nearest ancestor that has a table. A row's primary key is its record's id and
its path. It has two foreign keys: the row it hangs under, and the row of the nearest object that is an element of an
array (itself, if it is one). A value's place is its row's path and its column's name, so it needs no key of its own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftbed.session import spread

# The keys whose strings are texts of a session, and the key below which every string is one.
TEXT_KEYS = ("text", "content", "display", "message", "prompt", "output", "arguments")
INPUT_KEY = "input"

#: The type of the top of a record.
TOP = "$"


def _constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def parse(payload: str | None):
    """The value of a JSON document in an array of one, or None if it isn't valid JSON (NaN and Infinity aren't)."""
    if not payload:
        return None
    try:
        return [json.loads(payload, parse_constant=_constant)]
    except ValueError:
        return None
    except RecursionError:
        return deep_parse(payload)


_BLANK = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"(?:true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.+-])", re.ASCII)


def deep_parse(payload: str):
    """Like `parse`, for any depth of nesting: open objects and arrays are kept in a list instead of on the call stack."""
    top: list = []
    stack: list[tuple[dict | list, str | None]] = []
    into: dict | list = top
    at, key, state = 0, None, "value"  # state: what has to come next
    try:
        while True:
            at = _BLANK.match(payload, at).end()
            mark = payload[at] if at < len(payload) else ""
            if state == "after" and not stack:
                return top if not mark else None
            if state == "after" and mark == ",":
                at, state = at + 1, "key" if isinstance(into, dict) else "value"
            elif mark == ("}" if isinstance(into, dict) else "]") and stack and state in ("after", "first"):
                into, key = stack.pop()
                at, state = at + 1, "after"
            elif isinstance(into, dict) and state in ("key", "first"):
                if mark != '"':
                    return None
                key, at = scanstring(payload, at + 1, True)
                at = _BLANK.match(payload, at).end()
                if payload[at] != ":":
                    return None
                at, state = at + 1, "value"
            elif state in ("value", "first"):
                if mark == '"':
                    value, at = scanstring(payload, at + 1, True)
                elif mark in ("{", "[") and mark:
                    value, at = ({} if mark == "{" else []), at + 1
                elif m := _SCALAR.match(payload, at):
                    value, at = json.loads(m[0]), m.end()
                else:
                    return None
                if isinstance(into, dict):
                    into[key] = value
                else:
                    into.append(value)
                state = "after"
                if isinstance(value, dict | list):
                    stack.append((into, key))
                    into, state = value, "first"
            else:
                return None
    except (ValueError, IndexError):
        return None


def type_of(key: str) -> str:
    """The type of a key: the key, marked where it could be taken for the top's."""
    return f"$'{key}" if not key or key[0] == "$" else key


def _children(node, kind: str) -> Iterator[tuple[object, str, str | None, int]]:
    """(value, type, key, index) of what stands directly below a node; the key is None for elements of an array."""
    if isinstance(node, dict):
        for key, value in node.items():
            yield value, type_of(key), key, 0
    elif isinstance(node, list):
        for i, value in enumerate(node):
            yield value, f"{kind}[]", None, i


def edges(document) -> set[tuple[str, str, bool]]:
    """(parent type, child type, repeated) of the schema graph that one document shows. Arrays are no nodes themselves."""
    found, stack = set(), [(document, TOP, TOP)]
    while stack:
        node, kind, owner = stack.pop()
        if not isinstance(node, list):
            owner = kind
        for value, child, key, _ in _children(node, kind):
            if isinstance(value, list):
                stack.append((value, child, owner))
            elif isinstance(value, dict) or key is None:
                found.add((owner, child, key is None))
                stack.append((value, child, child))
    return found


def shred(document, own: set[str] | None) -> list[tuple[str, str, str | None, str | None, str, list[tuple]]]:
    """The rows of one document: (table, path, parent table, parent path, element path, columns), given the shared types.

    With None for the types, every object has a row of its own. A column is (name, key, below_input, kind, value): its
    name below the row, the nearest object key, whether the key `input` is above or at it, its JSON kind, and its value
    as text. A row of a scalar has one column with an empty name. Objects and arrays without content leave no column.
    """
    top: tuple = (TOP, "", None, None, "", [])
    rows: list[tuple] = [top]
    stack = [(document, TOP, "", top, "", "", False)]
    while stack:
        node, kind, path, row, name, key, below = stack.pop()
        if isinstance(node, dict | list):
            inside = []
            for value, child, step, i in _children(node, kind):
                at = f"{path}[{i}]" if step is None else f"{path}.{step}" if path else step
                here, inner = row, name if step is None else f"{name}.{step}" if name else step
                if not isinstance(value, list) and (step is None or isinstance(value, dict) and (own is None or child in own)):
                    here, inner = (child, at, row[0], row[1], at if step is None and isinstance(value, dict) else row[4], []), ""
                    rows.append(here)
                inside.append((value, child, at, here, inner, key if step is None else step, below or step == INPUT_KEY))
            stack.extend(reversed(inside))
        else:
            kind_of = "null" if node is None else "boolean" if isinstance(node, bool) else "string" if isinstance(node, str) else "number"
            row[5].append((_clean(name), _clean(key), below, kind_of, _clean(node if kind_of == "string" else None if node is None else json.dumps(node))))
    return rows


def _clean(text: str | None) -> str | None:
    """Half surrogates, which JSON can write and UTF-8 can't, become replacement characters."""
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


_COLUMN = [("name", pa.string()), ("key", pa.string()), ("below_input", pa.bool_()), ("kind", pa.string()), ("value", pa.string())]
_COLUMNS = "array<struct<name:string,key:string,below_input:boolean,kind:string,value:string>>"
_KEYS = ["table_name", "path", "parent_table", "parent_path", "element_path"]


def schema_graph(records: DataFrame, *, payload: str = "payload") -> DataFrame:
    """type, repeated, parents, own_table: a row for each type of object or element, over all valid documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set = set()
            for text in batch.column(0).to_pylist():
                if document := parse(text):
                    found |= edges(document[0])
            yield pa.RecordBatch.from_arrays([pa.array([_clean(x) if isinstance(x, str) else x for x in c]) for c in zip(*found)] if found else [pa.array([], t) for t in (pa.string(), pa.string(), pa.bool_())], ["parent", "type", "repeated"])

    found = records.select(payload).mapInArrow(run, "parent string, type string, repeated boolean").distinct()
    graph = found.groupBy("type").agg(F.max("repeated").alias("repeated"), F.countDistinct("parent").alias("parents"))
    return graph.withColumn("own_table", F.col("repeated") | (F.col("parents") > 1))


def flatten(records: DataFrame, *, record: str = "raw_id", payload: str = "payload", keep: tuple[str, ...] = (), most_types: int = 20_000) -> DataFrame:
    """The rows of all tables: record, the columns to `keep`, table_name, path, parent_table, parent_path, element_path, columns (see `shred`).

    Null, empty and broken payloads give no row, documents of any depth do; a repeated record id gives the rows of each
    of its documents. A document that is a lone scalar has one row. The shared types are read from all documents first
    and held by every executor; where there are more than `most_types` (objects used as maps), nothing is inlined and
    every object has a row in the table of its type, which needs no such set.
    """
    shared = schema_graph(records, payload=payload).where("own_table AND NOT repeated").select("type").limit(most_types + 1).collect()
    own = {r[0] for r in shared} if len(shared) <= most_types else None
    kept = ", ".join(f"`{records.schema[c].name}` {records.schema[c].dataType.simpleString()}" for c in (record, *keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, rows, size = [], [], 0
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                document = parse(text)
                for row in shred(document[0], own) if document else ():
                    places.append(i)
                    rows.append(row)
                    size += len(row[1])
                    if len(rows) >= BATCH or size >= BATCH_CHARS:
                        yield _rows(batch, places, rows)
                        places, rows, size = [], [], 0
            yield _rows(batch, places, rows)

    keys = ", ".join(f"{k} string" for k in _KEYS)
    return spread(records.select(record, *keep, payload)).mapInArrow(run, f"{kept}, {keys}, columns {_COLUMNS}")


#: Rows, and characters of their paths, of a batch that leaves the task.
BATCH, BATCH_CHARS = 20_000, 1 << 26


def _rows(batch: pa.RecordBatch, places: list[int], rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch, with the id and kept columns of their records; columns are built one by one, not as objects."""
    taken = [batch.column(k).take(pa.array(places, pa.int64())) for k in range(batch.num_columns - 1)]
    keys = [pa.array([_clean(r[k]) for r in rows], pa.string()) for k in range(5)]
    flat = [c for r in rows for c in r[5]]
    fields = [pa.array([c[k] for c in flat], kind) for k, (_, kind) in enumerate(_COLUMN)]
    offsets = np.concatenate([[0], np.cumsum([len(r[5]) for r in rows])]).astype(np.int32)
    columns = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, [n for n, _ in _COLUMN]))
    return pa.RecordBatch.from_arrays([*taken, *keys, columns], [*batch.schema.names[:-1], *_KEYS, "columns"])


def table_columns(rows: DataFrame) -> DataFrame:
    """table_name, name, n_rows: the columns of every table of `flatten`; a table without columns has none."""
    return rows.select("table_name", F.explode("columns.name").alias("name")).groupBy("table_name", "name").agg(F.count("*").alias("n_rows"))


def table_links(rows: DataFrame) -> DataFrame:
    """table_name, parent_table, n_rows: the foreign keys between the tables of `flatten`."""
    return rows.groupBy("table_name", "parent_table").agg(F.count("*").alias("n_rows"))


def table(rows: DataFrame, name: str, columns: list[str], *, record: str = "raw_id") -> DataFrame:
    """One flat table of `flatten`: record, path, parent_table, parent_path, element_path and the named columns as strings."""
    values = F.map_from_entries(F.transform("columns", lambda c: F.struct(c["name"], c["value"])))
    keys = ["path", "parent_table", "parent_path", "element_path"]
    return rows.where(F.col("table_name") == name).withColumn("_values", values).select(record, *keys, *(F.try_element_at("_values", F.lit(c)).alias(c or "value") for c in columns))


def write_tables(rows: DataFrame, folder: str) -> None:
    """All tables of `flatten` as Parquet, a folder for each: one pass and no shuffle, however many tables there are."""
    rows.write.partitionBy("table_name").parquet(folder)


def texts(rows: DataFrame, *, record: str = "raw_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """record, text_path, parent_path, text: the non-empty strings of the tables under a text key, or at or below `input`.

    The path of a text is the primary key of its row and the name of its column; its parent is its row's foreign key to
    the nearest element of an array.
    """
    c = F.col("c")
    is_text = (c["kind"] == "string") & (c["value"] != "") & (c["below_input"] | c["key"].isin(*TEXT_KEYS))
    found = rows.select(record, *keep, "path", "element_path", F.explode("columns").alias("c")).where(is_text)
    # A scalar element is its row, without a name of its own.
    inlined = ~((c["name"] == "") & F.endswith("path", F.lit("]")))
    path = F.when(inlined & (F.col("path") != ""), F.concat("path", F.lit("."), c["name"])).when(inlined, c["name"]).otherwise(F.col("path"))
    return found.select(record, *keep, path.alias("text_path"), F.col("element_path").alias("parent_path"), c["value"].alias("text"))
