"""Timestamps: interpretations at the edges, and the path against trying every path."""

from __future__ import annotations

import itertools
import random
from datetime import datetime, timedelta, timezone

import pytest

from siftbed.operators import timestamps as T

UTC = timezone.utc


def us(*args):
    return int(datetime(*args, tzinfo=UTC).timestamp()) * 1_000_000


@pytest.mark.parametrize("value,zone,order,expected", [
    ("2024-05-01T10:00:00Z", None, None, [us(2024, 5, 1, 10)]), ("2024-05-01T10:00:00.1234567+02:00", None, None, [us(2024, 5, 1, 8) + 123456]),
    ("1714557600", None, None, [us(2024, 5, 1, 10)]), ("1714557600000", None, None, [us(2024, 5, 1, 10)]), ("1714557600000000", None, None, [us(2024, 5, 1, 10)]), ("1714557600000000999", None, None, [us(2024, 5, 1, 10)]),
    ("2024-10-27 02:30:00", "Europe/Berlin", None, [us(2024, 10, 27, 0, 30), us(2024, 10, 27, 1, 30)]), ("2024-10-27 02:30:00 CET", "Europe/Berlin", None, [us(2024, 10, 27, 1, 30)]),
    ("02/03/2024 10:00:00", "UTC", "DMY", [us(2024, 3, 2, 10)]), ("02/03/2024 10:00:00", "UTC", "MDY", [us(2024, 2, 3, 10)]), ("02/03/2024 10:00:00", "UTC", None, [us(2024, 3, 2, 10), us(2024, 2, 3, 10)]),
    ("2024-02-30T10:00:00Z", None, None, []), ("2024-05-01", None, None, []), ("", None, None, []), (None, None, None, []), ("x" * 100_000, None, None, []), ("2024-05-01 10:00:00", None, None, []), ("2024-05-01 10:00:00", "No/Where", None, []),
])
def test_interpretations(value, zone, order, expected):
    assert sorted({x[0] for x in T._possible(T.interpretations(value, zone, order))}) == sorted(expected)


def _cost(path):
    total = 0.0
    for k, (e, f, c, far) in enumerate(path):
        total += c
        if k and not far:
            total += T.SWITCH * (f != path[k - 1][1]) + T.BACKWARD * (e < path[k - 1][0])
    return total


@pytest.mark.parametrize("partitions", [1, 7])
def test_the_path_is_the_best_of_all(spark, partitions):
    rng = random.Random(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows, states = [], {}
        for s in range(12):
            seq = 0
            for k in range(rng.randint(1, 9)):
                seq += rng.choice([0, 1, 1, 5, 40])
                day = datetime(2024, rng.randint(1, 12), rng.randint(1, 15), 10, k, tzinfo=UTC)
                value = rng.choice([day.strftime("%d/%m/%Y %H:%M:%S"), day.strftime("%d/%m/%Y %H:%M:%S"), day.strftime("%Y-%m-%dT%H:%M:%SZ"), "broken"])
                rows.append((len(rows), f"s{s}", None if rng.random() < 0.1 else seq, value))
        sources = spark.createDataFrame([(f"s{s}", "UTC", None) for s in range(12)], "source_key string, zone_name string, date_order string")
        frame = spark.createDataFrame(rows, "message_id bigint, source_key string, seq bigint, ts_raw string")
        got = {r.message_id: r for r in T.normalise_timestamps(frame, sources, distance=16).collect()}
        assert len(got) == len(rows)
        for s in range(12):
            own = sorted((r for r in rows if r[1] == f"s{s}" and r[2] is not None and r[3] != "broken"), key=lambda r: (r[2], r[0]))
            far = [k > 0 and r[2] - own[k - 1][2] > 16 for k, r in enumerate(own)]
            states = [[(e, f, c) for e, f, c, _ in T._possible(T.interpretations(r[3], "UTC", None))] for r in own]
            best = min((_cost([(*x, y) for x, y in zip(p, far)]) for p in itertools.product(*states)), default=0.0)
            chosen = []
            for r, of in zip(own, states):
                chosen.append(next(x for x in of if x[:2] == (got[r[0]].epoch_us, got[r[0]].format)))
            assert _cost([(*x, y) for x, y in zip(chosen, far)]) == pytest.approx(best)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_long_ambiguous_run_over_many_tasks(spark):
    """Without a declared order, one record that has only one reading decides for all around it."""
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        days = [datetime(2024, 1, 1, 12, tzinfo=UTC) + timedelta(days=k // 30, minutes=k % 30) for k in range(360)]
        rows = [(k, "a", k, d.strftime("%d/%m/%Y %H:%M:%S")) for k, d in enumerate(days)]
        sources = spark.createDataFrame([("a", "UTC", None)], "source_key string, zone_name string, date_order string")
        got = T.normalise_timestamps(spark.createDataFrame(rows, "message_id bigint, source_key string, seq bigint, ts_raw string"), sources).collect()
        # Every day up to the 12th reads both ways; the order of time settles all of them.
        assert {r.message_id: r.epoch_us for r in got} == {k: int(d.timestamp()) * 1_000_000 for k, d in enumerate(days)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_accuracy_on_values_made_ambiguous(spark):
    """Messages with a known instant, rewritten in the day-first order of an undeclared source, keep their instant."""
    known = spark.read.parquet("/root/testdata/sf0.01/messages.parquet").where("ts_raw rlike '^[0-9]{13}$'").dropDuplicates(["message_id"]).orderBy("ts_raw")
    truth = {r.message_id: int(r.ts_raw) // 1000 * 1_000_000 for r in known.collect()}
    order = {m: k for k, m in enumerate(truth)}
    rows = [(m, "a", order[m], datetime.fromtimestamp(t // 1_000_000, UTC).strftime("%d/%m/%Y %H:%M:%S")) for m, t in truth.items()]
    sources = spark.createDataFrame([("a", "UTC", None)], "source_key string, zone_name string, date_order string")
    got = T.normalise_timestamps(spark.createDataFrame(rows, "message_id bigint, source_key string, seq bigint, ts_raw string"), sources).collect()
    assert sum(r.epoch_us == truth[r.message_id] for r in got) / len(truth) >= 0.97


def test_nulls_repetitions_and_empty_tables(spark):
    fields = "message_id bigint, source_key string, seq bigint, ts_raw string, epochs int, source string"
    sources = spark.createDataFrame([("a", "UTC", "DMY"), ("a", "UTC", "DMY")], "source_key string, zone_name string, date_order string")
    assert T.normalise_timestamps(spark.createDataFrame([], fields), sources).count() == 0
    rows = [(1, None, None, "2024-05-01T10:00:00Z", 1, "x"), (2, "a", 0, None, 1, "x"), (3, "a", None, "02/03/2024 10:00:00", 1, "x"), (3, "a", None, "02/03/2024 10:00:00", 1, "x"), (4, "b", 1, "2024-05-01 10:00:00", 1, "x")]
    got = sorted((r.message_id, r.epoch_us, r.settled) for r in T.normalise_timestamps(spark.createDataFrame(rows, fields), sources).collect() if r.epoch_us)
    assert got == [(1, us(2024, 5, 1, 10), True)] + [(3, us(2024, 3, 2, 10), True)] * 2
