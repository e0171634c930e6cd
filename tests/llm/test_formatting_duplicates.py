"""Copies that differ in formatting, against grouping by brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest

from siftbed.llm import formatting_duplicates as duplicates

SCHEMA = "finding_id bigint, matched_text string, pattern_id string, source_file string, copies int"


def _groups(spark, rows):
    frame = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    return sorted((r.keep_id, r.copy_id, r.copies) for r in duplicates.formatting_duplicates(frame).collect())


def test_formatting_and_field_order(spark):
    rows = [
        (1, "Server=db; User = sa;Password=Ab1", "db_conn", "/a/b.py"), (2, "password=AB1;server=DB;user=SA", "DB-conn", "/A/b.PY"), (3, "server=db;user=sa;password=ab2", "db_conn", "/a/b.py"),
        (4, '{"a": "x", "b": "y"}', "j", "f"), (5, "{'b':'Y','a':'X'}", "j", "f"), (6, "https://h/p?a=1&b=2", "u", "f"), (7, "https://h/p?b=2&a=1", "u", "f"), (8, "https://h/q?b=2&a=1", "u", "f"),
        (9, "ab cd", "p", "f"), (10, "AB-CD", "p", "f"), (11, "cd ab", "p", "f"), (12, None, None, None), (13, "", "", "--"), (14, "x" * 100_000, "p", "f"), (15, "X" * 100_000 + ".", "p", "f"),
    ]
    assert _groups(spark, rows) == [(1, 2, 2), (4, 5, 2), (6, 7, 2), (9, 10, 2), (12, 13, 2), (14, 15, 2)]


def test_links_through_several_readings(spark):
    """Two rows with the same letters read as different fields; a third has the fields of one of them in another order."""
    rows = [(1, "a=1;b=2;c=3", "p", "f"), (2, "c=3;a=1;b=2", "p", "f"), (3, "a=1b;2=c3", "p", "f"), (4, "2c3;a=1=b", "p", "f"), (5, "a1b2c3", "p", "f")]
    key = {r[0]: (re.sub("[^a-z0-9]", "", r[1]), "|".join(sorted(re.sub("[^a-z0-9]", "", x) for x in r[1].split(";"))) if re.search("^[^;=]*=[^;]*;.*=", r[1]) else None) for r in rows}
    # Union of all that share an order or a reading.
    parent = {i: i for i in key}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in key:
        for j in key:
            if key[i][0] == key[j][0] or key[i][1] and key[i][1] == key[j][1]:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    groups = defaultdict(list)
    for i in key:
        groups[root(i)].append(i)
    expected = sorted((min(g), i, len(g)) for g in groups.values() for i in g if i != min(g))
    assert _groups(spark, rows) == expected


@pytest.mark.parametrize("share", [0.0, 0.4])
def test_random_rows_and_a_hot_group(spark, share):
    rng = random.Random(int(share * 10))

    def dressed(text):
        return "".join(rng.choice([c, c.upper(), c + " ", "-" + c]) for c in text)

    rows, key = [], {}
    for i in range(1, 1501):
        text = "hot one" if rng.random() < share else "".join(rng.choices("abc", k=rng.randint(0, 6)))
        rule, file = rng.choice(["p", "q"]) if text != "hot one" else "p", "f"
        key[i] = (re.sub("[^a-z]", "", text), rule, file)
        rows.append((i, dressed(text), dressed(rule), file))
    groups = defaultdict(list)
    for i, k in key.items():
        groups[k].append(i)
    assert _groups(spark, rows) == sorted((g[0], i, len(g)) for g in groups.values() for i in g[1:])


def test_empty_table(spark):
    assert _groups(spark, []) == []
