"""Flat tables of nested records against a plain walk, and their keys."""

from __future__ import annotations

import json
import random

import pytest

from siftbed.operators import nested

PAYLOAD = "/root/testdata/sf0.01/raw_sessions.parquet"


def walk(node, path="", element="", key="", below=False):
    """(text_path, parent_path) of all texts, straight from the definition."""
    if isinstance(node, dict):
        here = path if path.endswith("]") else element
        for k, v in node.items():
            yield from walk(v, f"{path}.{k}" if path else k, here, k, below or k == "input")
    elif isinstance(node, list):
        for i, v in enumerate(node):
            yield from walk(v, f"{path}[{i}]", element, key, below)
    elif isinstance(node, str) and node and (below or key in nested.TEXT_KEYS):
        yield path, element


def test_texts_equal_a_plain_walk(spark):
    sessions = spark.read.parquet(PAYLOAD)
    found = nested.texts(nested.flatten(sessions)).collect()
    expected = []
    for r in sessions.collect():
        if document := nested.parse(r.payload):
            expected += [(r.raw_id, *x) for x in walk(document[0])]
    assert sorted((r.raw_id, r.text_path, r.parent_path) for r in found) == sorted(expected) and expected


def test_without_inlining_the_texts_are_the_same(spark):
    sessions = spark.read.parquet(PAYLOAD)
    few = nested.flatten(sessions, most_types=0)
    assert few.where("table_name = 'message'").count() > 0
    key = ["raw_id", "text_path", "parent_path"]
    assert nested.texts(few).select(key).exceptAll(nested.texts(nested.flatten(sessions)).select(key)).count() == 0


def test_every_foreign_key_has_its_row(spark):
    rows = nested.flatten(spark.read.parquet(PAYLOAD)).select("raw_id", "table_name", "path", "parent_table", "parent_path", "element_path")
    keys = rows.select("raw_id", "table_name", "path")
    assert keys.count() == keys.distinct().count()
    hanging = rows.where("parent_table is not null").join(keys.toDF("raw_id", "parent_table", "parent_path"), ["raw_id", "parent_table", "parent_path"], "left_anti")
    loose = rows.where("element_path <> ''").join(keys.select("raw_id", "path").toDF("raw_id", "element_path"), ["raw_id", "element_path"], "left_anti")
    assert hanging.count() == 0 and loose.count() == 0


def test_inlining_and_shared_types(spark):
    payload = json.dumps({"a": {"x": 1, "b": {"y": "z"}}, "list": [{"b": {"y": 2}}, "s", None, []], "text": "", "record": {"text": "t"}, "$": {"text": "u"}, "": "v"})
    rows = {(r.table_name, r.path): (r.parent_table, r.parent_path, r.element_path, {c["name"]: c["value"] for c in r.columns}) for r in nested.flatten(spark.createDataFrame([(1, payload)], "raw_id bigint, payload string")).collect()}
    assert rows == {
        ("$", ""): (None, None, "", {"a.x": "1", "text": "", "record.text": "t", "$.text": "u", "": "v"}),
        ("b", "a.b"): ("$", "", "", {"y": "z"}),
        ("list[]", "list[0]"): ("$", "", "list[0]", {}), ("b", "list[0].b"): ("list[]", "list[0]", "list[0]", {"y": "2"}),
        ("list[]", "list[1]"): ("$", "", "", {"": "s"}), ("list[]", "list[2]"): ("$", "", "", {"": None}),
    }


def test_recursive_types_have_a_table(spark):
    payload = json.dumps({"node": {"text": "a", "node": {"text": "b", "node": {"text": "c"}}}})
    rows = nested.flatten(spark.createDataFrame([(1, payload)], "raw_id bigint, payload string"))
    assert sorted(r.path for r in rows.where("table_name = 'node'").collect()) == ["node", "node.node", "node.node.node"]


@pytest.mark.parametrize("payload", [None, "", "   ", "{", "[1,]", '{"a":1,}', '{"a" 1}', "NaN", '{"a":NaN}', "[01]", "nul", '"open', "[1] 2", '{a:1}', "[" * 5000, "[" * 50_000 + "]" * 49_999])
def test_broken_payloads_have_no_row(spark, payload):
    assert nested.flatten(spark.createDataFrame([(1, payload)], "raw_id bigint, payload string")).count() == 0
    assert not payload or nested.deep_parse(payload) is None


def test_any_depth(spark):
    depth = 2_000
    payloads = ['{"a":' * depth + '{"text":"deep"}' + "}" * depth, '{"text":' + "[" * 20_000 + '"x"' + "]" * 20_000 + "}"]
    with pytest.raises(RecursionError):
        json.loads(payloads[1])
    found = nested.texts(nested.flatten(spark.createDataFrame(list(enumerate(payloads)), "raw_id bigint, payload string"))).collect()
    assert sorted((r.raw_id, r.text_path, r.text) for r in found) == [(0, "a." * depth + "text", "deep"), (1, "text" + "[0]" * 20_000, "x")]


def test_the_deep_parser_equals_the_plain_one():
    rng = random.Random(4)

    def value(depth):
        kind = rng.randint(0, 7 if depth else 4)
        if kind == 5 or kind == 6:
            return {rng.choice(["a", "é\n", "", "text"]): value(depth - 1) for _ in range(rng.randint(0, 3))}
        return [rng.randint(-9, 9), 1.5e10, None, True, 'q"\\€', None, None, [value(depth - 1) for _ in range(rng.randint(0, 3))] if depth else 0][kind]

    for _ in range(300):
        document = value(4)
        text = json.dumps(document, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        assert nested.deep_parse(text) == [document] == nested.parse(text)


def test_empty_table(spark):
    assert nested.texts(nested.flatten(spark.createDataFrame([], "raw_id bigint, payload string"))).count() == 0
