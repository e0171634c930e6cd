"""Scalar functions at their edges; expected values are written by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftbed.functions import fixed_values as fixed
from siftbed.functions import secrets as S

AT = "@"


@pytest.fixture(scope="module")
def evaluate(spark):
    def run(function, values):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", function(F.col("v")).alias("r")).collect()
        return [row.r for row in sorted(rows, key=lambda row: row.i)]

    return run


CASES = [
    (S.entropy, {"": 0.0, "aaaa": 0.0, "aabb": 1.0, "abcdefgh": 3.0, "0123456789abcdef": 4.0}),
    (S.redacted, {"": "****", "abcd": "****", "abcde": "abcd****", "abcdefghijkl": "abcd****", "abcdefghijklm": "abcd****..."}),
    (S.passes_luhn, {"123456789012": False, fixed.TEST_CARDS[0]: True, fixed.TEST_CARDS[4]: True, "4111111111111112": False, "4222222222222": True, "": False}),
    (S.is_example_database, {f"x://svc:Zk{AT}localhost": True, f"x://user:pass{AT}prod": True, f"x://user:Zk3{AT}prod": False, f"x://user:Zk3{AT}DB": True, f"redis://:pw{AT}localhost": False, f"x://svc:Zk3{AT}[::1]": False, "": False}),
    (S.is_impossible_ssn, {"000-12-3456": True, "666-12-3456": True, "899-12-3456": False, "900-12-3456": True, "212-00-3456": True, "212-12-0000": True, "444-44-4444": True, "123-45-6789": True, "x": True}),
    (S.is_placeholder, {"secret: changeme": True, "p=/etc/x": True, "p=$VAR": True, "p=some_name": True, "changeme": False, "auth: Zk39QmPw2rT7yU1iO5pL": False, "k=" + "ab" * 12: True}),
    (S.has_run, {"k=abcdefg": False, "k=abcdefgh": True, "k=ABCDEFGH": True, "k=12345678": True, "k=hgfedcba": False, "abcdefgh=x": False, "sk_live_abcdefgh": True}),
    (S.has_stepped_hex, {"0a0b0c": False, "0a0b0c0d": True, "0a0b0c0df": True, "77777777": True, "01030709": False, "xdeadbeefx": True}),
    (S.has_fragments, {fixed.SYNTHETIC_FRAGMENTS[0]: False, fixed.SYNTHETIC_FRAGMENTS[0] * 2: False, fixed.SYNTHETIC_FRAGMENTS[0] + fixed.SYNTHETIC_FRAGMENTS[2].upper(): True}),
    (S.is_impersonal_email, {f"jo{AT}gmail.com": True, f"jo{AT}x.gmail.com": False, f"info{AT}a.de": True, f"abbot{AT}a.de": True, f"jo{AT}a.de": False, "none": False}),
    (S.is_fictional_phone, {"(555) 234-1234": True, "212-555-0100": True, "+1 212 555 0100": True, "555-1234": True, "555123": False, "212-456-7890": False}),
    (S.secret_value, {"K=v": "v", 'K: "v"': "v", "K=v==": "", "a=b=c": "c", "plain": "plain", "": ""}),
    (S.is_published_iban, {"DE89 3704 0044 0532 0130 00": True, "DE02120300000000202051": False}),
    (S.is_local_address, {f"http://LOCALHOST/a:b{AT}h": True, f"http://a:b{AT}localhost": False, f"http://oauth2:b{AT}h": True, f"http://a:b{AT}h": False}),
    (S.is_sample_pool, {"us-east-1_ABC123def": True, "us-east-1_other1234": False, "none": False}),
    (S.is_regex_literal, {r"a://[^:]+": True, "a://[::1]": False}),
]


@pytest.mark.parametrize("function,cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_edges(evaluate, function, cases):
    assert evaluate(function, list(cases)) == list(cases.values())


@pytest.mark.parametrize("function", [f for f, _ in CASES], ids=[f.__name__ for f, _ in CASES])
def test_null_and_long_values_dont_fail(evaluate, function):
    evaluate(function, [None, "x=" + "ab1" * 50_000, "\n", "é😀"])


def test_places_and_lines(spark):
    text = "one\ntwo KEY1 x KEY1\n" + "y" * 150
    row = spark.createDataFrame([(text,)], "t string").select(
        S.match_offsets(F.col("t"), F.lit("KEY[0-9]")).alias("m"), S.line_number(F.col("t"), F.lit(8)).alias("line"), S.line_number(F.col("t"), F.lit(3)).alias("end"),
        S.context_line(F.col("t"), F.lit(8), F.lit("KEY1")).alias("context"), S.context_line(F.col("t"), F.lit(20), F.lit("yyyyyyyyyyyyyy")).alias("tail"),
        S.surroundings(F.col("t"), F.lit(8), F.lit(4), 5).alias("near"),
    ).first()
    assert [(m.start, m.match) for m in row.m] == [(8, "KEY1"), (15, "KEY1")]
    assert (row.line, row.end, row.context, row.near) == (2, 1, "two **** x ****", text[3:17])
    assert row.tail == ("yyyy****..." * 9)[: len(row.tail)] and len(row.tail) <= 200


@pytest.mark.parametrize("distance,found", [(199, True), (200, True), (201, False)])
def test_keyword_distance(spark, distance, found):
    key = "tel"
    text = key + "-" * (distance - len(key)) + "MATCHED1"
    near = S.surroundings(F.col("t"), F.lit(distance), F.lit(8))
    row = spark.createDataFrame([(text,)], "t string").select(S.has_keyword(near, F.array(F.lit("TEL"))).alias("k")).first()
    assert row.k is (distance <= 200)
    assert row.k is found


def test_times(spark):
    frame = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T05:04:05+02:00",), ("2024-01-02T03:04:05",), ("2024-13-02T03:04:05Z",), ("x",), (None,)], "v string")
    assert [r.t for r in frame.select(F.unix_seconds(S.iso_instant(F.col("v"))).alias("t")).collect()] == [1704164645] * 3 + [None] * 3
    row = spark.range(1).select(S.epoch_ms(F.lit(1704164645123)).cast("double").alias("a"), S.epoch_ms(F.lit(0)).alias("b"), S.conversation_estimate(F.lit(0), 10).alias("c"), S.conversation_estimate(F.lit(3), 10).alias("d"), S.conversation_estimate(F.lit(25), 10).alias("e")).first()
    assert (row.a, row.b, row.c, row.d, row.e) == (1704164645.123, None, 0, 1, 2)
