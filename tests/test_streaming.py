"""The scan over files that arrive: what a batch scan finds, once."""

from __future__ import annotations

from siftbed.operators import matching
from siftbed.streaming import scan


def test_a_stream_finds_what_a_batch_finds(spark, tmp_path):
    messages = spark.read.parquet("/root/testdata/sf0.001/messages.parquet")
    arriving, found = str(tmp_path / "in"), str(tmp_path / "out")
    half = messages.where("message_id % 2 = 0"), messages.where("message_id % 2 = 1")
    for part in (*half, half[0].limit(5)):
        part.coalesce(1).write.mode("append").parquet(arriving)
        scan.write_findings(scan.watched(spark, arriving), found, str(tmp_path / "state"), once=True).awaitTermination()
    columns = ["message_id", "pattern_id", "redacted_text", "match_start", "line_number", "context"]
    got = sorted(map(tuple, scan.read_findings(spark, found).select(columns).collect()))
    assert got == sorted(map(tuple, matching.findings(messages).select(columns).collect())) and got
