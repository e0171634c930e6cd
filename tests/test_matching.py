"""The catalog and the matcher: every rule has a positive and a negative, and the gates lose nothing."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftbed.operators import catalog, matching
from siftbed.operators.catalog import anchors
from tests.strings import matching_string

RULES = catalog.catalog()
EVERY, UNGATED = matching.Matcher(RULES), matching.Matcher(RULES, gated=False)


def test_the_catalog():
    assert len(RULES) == 322 == len({r.rule_id for r in RULES}) == len({r.regex for r in RULES}) == len({r.name for r in RULES})
    assert [r.place for r in RULES] == list(range(1, 323))
    assert Counter(r.severity for r in RULES) == {"critical": 119, "high": 171, "medium": 30, "low": 2}
    assert sum(bool(r.keywords) for r in RULES) == 136 and sum(r.entropy is not None for r in RULES) == 53
    assert Counter(r.category for r in RULES) == {
        "AI Service": 28, "CI/CD": 17, "Cloud Provider": 31, "Communication": 47, "Cryptographic": 13, "Database": 18, "Generic": 6,
        "Infrastructure": 86, "Monitoring": 22, "Payment": 28, "PII": 9, "Version Control": 17,
    }


def _positive(rule, rng) -> str:
    for _ in range(2000):
        text = matching_string(rule.regex, rng)
        if re.search(rule.regex, text):
            return text
    raise AssertionError(rule.rule_id)


@pytest.mark.parametrize("rule", RULES, ids=[r.rule_id for r in RULES])
def test_a_positive_and_a_negative_of_each_rule(rule):
    rng = random.Random(rule.rule_id)
    one = matching.Matcher((rule,))
    keyword = (rule.keywords or [""])[-1]
    for _ in range(5):
        text = f"{keyword} {_positive(rule, rng)} "
        expected = [m.span() for m in re.finditer(rule.regex, text)]
        assert [(m[1], m[1] + len(m[2])) for m in one.matches(text)] == expected and expected
        assert rule.place in [m[0] for m in EVERY.matches(text)]
        found = anchors(rule.regex)
        assert not found or any(a in text.lower() for a in found)
    assert not list(one.matches("nothing to see in these few words"))


def _brute(text: str) -> set:
    return {(r.place, m.start(), m[0]) for r in RULES for m in re.finditer(r.regex, text)}


def test_candidates_equal_a_nested_loop(spark):
    messages = spark.read.parquet("/root/testdata/sf0.001/messages.parquet").dropDuplicates(["message_id"])
    got = {(r.message_id, r.place, r.match_start, r.matched_text) for r in matching.candidates(messages, gated=False).collect()}
    assert got == {(r.message_id, *x) for r in messages.collect() if r.text for x in _brute(r.text)}


def test_letters_that_fold_to_ascii():
    text = "paſſword_b64 = " + "Zk39QmPw2rT7yU1iO5pLZk39QmPw2rT7yU1iO5pL"
    assert _brute(text) == {m[:3] for m in UNGATED.matches(text)} != set()


def test_the_chain_keeps_the_first_surviving_match(spark):
    rng = random.Random(7)
    key = "AKIA" + "".join(rng.choices("QWRTYPSDGHJKLZXCVBNM", k=16))
    rows = [(1, f"a {key} b\nc {key}"), (2, f"x {key}"), (2, f"x {key}"), (3, None), (4, ""), (5, "AKIA" + "EXAMPLE1" * 2), (6, "x" * 100_000 + " " + key)]
    found = matching.findings(spark.createDataFrame(rows, "message_id bigint, text string")).collect()
    assert sorted((r.message_id, r.pattern_id, r.match_start, r.line_number) for r in found) == [
        (1, "aws_access_key_id", 2, 1), (2, "aws_access_key_id", 2, 1), (6, "aws_access_key_id", 100_001, 1),
    ]
    assert all(key not in r.context and r.redacted_text == "AKIA****..." for r in found)
    assert [r.context for r in found if r.message_id == 6] == ["x" * 200]


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "message_id bigint, text string")
    assert matching.findings(empty).count() == 0
    clash = spark.createDataFrame([(1, "no secret", "p", 1)], "message_id bigint, text string, pattern_id string, place int")
    assert matching.findings(clash).count() == 0


def test_rules_of_a_user(spark):
    mine = (catalog.Rule(1, "ticket", "Ticket", "Generic", "low", r"TICKET-[0-9]{4}"),)
    rows = spark.createDataFrame([(1, "see TICKET-8305 and TICKET-8305")], "message_id bigint, text string")
    assert [(r.pattern_id, r.match_start) for r in matching.findings(rows, mine).collect()] == [("ticket", 4)]


def test_context_equals_replacing_in_the_whole_line():
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choices("abc", k=rng.choice([8, 13, 40])))
        text = "".join(rng.choice([" ", "\n", word, "a", "bb", "x" * 90]) for _ in range(rng.randint(1, 12))) + word + rng.choice(["", "\n", " tail" * 30])
        ends = [m.start() for m in re.finditer("\n", text)]
        for m in re.finditer(word, text):
            first, last = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            last = last if last >= 0 else min(len(text), m.end() + 100)
            mask = word[:4] + "****" + ("..." if len(word) > 12 else "")
            assert matching.context(text, ends, *m.span()) == text[first:last].strip().replace(word, mask)[:200]


def test_verdicts_partition_candidates(spark):
    messages = spark.read.parquet("/root/testdata/sf0.001/messages.parquet")
    judged = matching.judged(matching.candidates(messages))
    assert judged.where(F.greatest(*[F.col(v).isNull() for v in matching.verdicts()])).count() == 0
