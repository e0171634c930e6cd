"""Personal data: labels, thresholds and the ways of the list of names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftbed.llm import personal

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("messages", "given_names", "findings"))


def _found(frame):
    return {(r.message_id, i.type, i.value) for r in frame.collect() for i in r["items"]}


@pytest.fixture(scope="module")
def found(tables):
    return _found(personal.scan_texts(*tables))


def test_recall_of_recorded_findings_by_type(tables, found):
    """Recorded findings of messages that the trees weren't fitted to, false alarms aside: those whose text is one span."""
    messages, _, findings = tables
    kind = F.regexp_replace(F.lower("pattern_id"), "[^a-z]", "")
    rows = findings.where(kind.isin(*personal.FINDING_TYPES) & (F.pmod(F.xxhash64("message_id"), F.lit(personal.HELD)) == 0)).withColumn("kind", kind).collect()
    spans = {(m, t, personal._letters(v)) for m, t, v in found}
    for type_ in ("email", "phone", "id_number"):
        own = [(r.message_id, type_, personal._letters(r.matched_text)) for r in rows if personal.FINDING_TYPES[r.kind] == type_ and len(r.matched_text) < 40 and " at " not in r.matched_text]
        own = [x for x in own if sum(c.isdigit() for c in x[2]) > 5 or type_ == "email" and "example" in x[2]]
        recall = sum(x in spans for x in own) / max(1, len(own))
        print(type_, len(own), f"recall {recall:.3f}")
        assert recall >= 0.9


def test_labels_of_recorded_types_are_no_votes(tables):
    messages, names, findings = tables
    rows = personal.training_rows(messages, findings, names, 1_000, record="message_id", text="text")
    votes = personal.training_rows(messages, None, names, 1_000, record="message_id", text="text")
    email = [y for x, y, _ in rows if x[0] == 1]
    assert 0 < sum(email) < len(email) and {y for _, y, _ in votes} == {0, 1}
    assert sorted(x for x, _, _ in rows) != sorted(x for x, _, _ in votes)
    assert rows == personal.training_rows(messages, findings, names, 1_000, record="message_id", text="text")


def test_the_trees_decide(tables, found, monkeypatch):
    """With trees that know nothing of contexts, machines' addresses and order numbers can't be told from people's."""
    fit = personal.fit
    monkeypatch.setattr(personal, "fit", lambda rows: fit([(x[:6] + (0.0,) * (len(x) - 6), y, h) for x, y, h in rows]))
    assert len(_found(personal.scan_texts(*tables)) ^ found) > 0.05 * len(found)


def test_any_number_of_names(tables, found):
    messages, names, findings = tables
    assert _found(personal.scan_texts(messages, names, findings, most_names=10)) == found


def test_masking_and_edges(spark, tables):
    _, names, findings = tables
    text = "Hi, my name is Laura Whitcombe, write to laura.whitcombe@home.example or call +1 555 201 4477.\r\nShe lives at 12 Alder Street, Apt 3, Northfield, OH 44067."
    rows = [(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "word " * 50_000 + "mail laura.whitcombe@home.example", "x"), (5, "no-reply@mail-2.host.example and order 1234 5678 9012", "x")]
    frame = spark.createDataFrame(rows, "message_id bigint, text string, items string")
    got = personal.scan_texts(frame, names, findings).collect()
    assert len(got) == len(rows)
    one = next(r for r in got if r.message_id == 1)
    assert {i.type for i in one["items"]} == {"name", "email", "phone", "address"}
    assert one.masked == "Hi, my name is [NAME], write to [EMAIL] or call [PHONE].\r\nShe lives at [ADDRESS]."
    assert all(text[i.start : i.start + len(i.value)] == i.value for i in one["items"])
    assert {r.message_id: (r["items"], r.masked) for r in got if r.message_id in (2, 3)} == {2: ([], None), 3: ([], "")}
    assert [i.value for r in got if r.message_id == 4 for i in r["items"]] == ["laura.whitcombe@home.example"]
    assert [r["items"] for r in got if r.message_id == 5] == [[]]
    assert personal.scan_texts(frame.limit(0), names, findings.limit(0)).count() == 0
    assert personal.scan_texts(frame, names.limit(0), None).count() == len(rows)
