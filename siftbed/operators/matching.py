"""Messages against the catalog: candidates, the chain of filters, and one finding per message, rule and text.

A nested loop of all rules over all texts would read every text 322 times. Instead, an automaton of the rules' anchors
(literals of which every match has one) reads each text once in an Arrow batch, and only rules whose anchor and keyword
stand in the text run. The rest of the chain is Column expressions over the few candidates: length, examples, tests per
rule, keywords, entropy. Candidates of a message leave the same task, so the dedup combines before its shuffle.

Defined results: a null or empty text has no match; a repeated message id counts as one message if its text is the same
and keeps the first of its matches; columns of the messages besides id and text don't pass through here, so their names
can't clash.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftbed.functions import secrets as S
from siftbed.operators.catalog import Rule, anchors, catalog, catalog_frame
from siftbed.session import spread

#: Characters on each side of a match in which a keyword counts, after it in which a longer key shows, and of a context.
NEAR, AFTER, CONTEXT = 200, 25, 200
#: Candidates of a batch that leaves the task.
BATCH = 4096

# Letters that match an ASCII letter when case is ignored, but aren't lowered to it.
_FOLD = str.maketrans({"ſ": "s", "ı": "i", "İ": "i", "K": "k"})

# A part of a rule's match that is found in one pass; rules that begin with a long run are tried only where it occurs.
_PARTS = {
    "discord_bot_token": r"\.[A-Za-z\d_-]{6}\.[A-Za-z\d_-]{27}",
    "ably_api_key": r"\.[A-Za-z0-9_-]{5,}:[A-Za-z0-9_-]{20}",
    "credit_card": r"[3-6][0-9]{12}",
    "vault_service_token": r"s\.[A-Za-z0-9_-]{24}",
    "asana_pat": r"/[0-9]{16}:",
    "passport_us": r"[0-9]{9}",
    "ssn": r"-\d{2}-\d{4}",
    "drivers_license": r"[A-Z]\d{7}",
}


class Matcher:
    """Compiled rules with their gates; built once in every Python worker."""

    def __init__(self, rules: tuple[Rule, ...], gated: bool = True):
        self.rules, self.gated = rules, gated
        self.compiled = [re.compile(r.regex) for r in rules]
        self.parts = [re.compile(_PARTS[r.rule_id]) if r.rule_id in _PARTS else None for r in rules]
        self.keywords = [tuple(k.lower() for k in r.keywords) for r in rules]
        self.always: list[int] = []
        self.literals: list[tuple[tuple[str, ...], int]] = []
        by_anchor: dict[str, list[int]] = {}
        for i, rule in enumerate(rules):
            found = anchors(rule.regex)
            exact = () if rule.regex.startswith("(?i)") else tuple(anchors(rule.regex, fold=False))
            if found and min(map(len, found)) >= 3:
                for anchor in found:
                    by_anchor.setdefault(anchor, []).append(i)
            elif exact and len(exact) <= 8:
                self.literals.append((exact, i))
            else:
                self.always.append(i)
        self.automaton = ahocorasick.Automaton()
        for anchor, those in by_anchor.items():
            self.automaton.add_word(anchor, tuple(those))
        if by_anchor:
            self.automaton.make_automaton()
        self.has_anchors = bool(by_anchor)

    def candidates(self, text: str) -> list[int]:
        """The rules that may match, in their order."""
        low = text.lower()
        if not low.isascii():
            low = text.translate(_FOLD).lower()
        chosen = set(self.always)
        if self.has_anchors:
            for those in {v for _, v in self.automaton.iter(low)}:
                chosen.update(those)
        chosen.update(i for literals, i in self.literals if any(x in text for x in literals))
        return [i for i in sorted(chosen) if not self.gated or not self.keywords[i] or any(k in low for k in self.keywords[i])]

    def matches(self, text: str) -> Iterator[tuple]:
        """(place, start, match, surroundings, following, line, context) of every match, by rule and start."""
        ends = None
        for i in self.candidates(text):
            if self.parts[i] is not None and not self.parts[i].search(text):
                continue
            for match in self.compiled[i].finditer(text):
                if ends is None:
                    ends = [m.start() for m in re.finditer("\n", text)]
                start, end, found = match.start(), match.end(), match[0]
                yield (
                    self.rules[i].place, start, found, text[max(0, start - NEAR) : end + NEAR], text[end : end + AFTER],
                    bisect_right(ends, start - 1) + 1, context(text, ends, start, end),
                )


def _redacted(text: str) -> str:
    return "****" if len(text) <= 4 else text[:4] + "****" + ("..." if len(text) > 12 else "")


def context(text: str, line_ends: list[int], start: int, end: int) -> str:
    """The line around a match with every occurrence of the match redacted, cut to `CONTEXT` characters.

    Only as much of the line is read as the result needs, so that a text on one long line isn't read for every match.
    """
    before = bisect_right(line_ends, start - 1)
    first = line_ends[before - 1] + 1 if before else 0
    after = bisect_right(line_ends, end - 1)
    last = line_ends[after] if after < len(line_ends) else min(len(text), end + 100)
    while first < last and text[first].isspace():
        first += 1
    while last > first and text[last - 1].isspace():
        last -= 1
    match, mask = text[start:end], _redacted(text[start:end])
    out, size, at = [], 0, first
    while at < last and size < CONTEXT:
        hit = text.find(match, at, min(last, at + CONTEXT + len(match)))
        piece = text[at : hit if hit >= 0 else min(last, at + CONTEXT)]
        out += [piece, mask] if hit >= 0 else [piece]
        size += len(piece) + (len(mask) if hit >= 0 else 0)
        at = hit + len(match) if hit >= 0 else at + len(piece)
    return "".join(out)[:CONTEXT]


@functools.lru_cache(maxsize=4)
def _matcher(rules: tuple[Rule, ...], gated: bool) -> Matcher:
    return Matcher(rules, gated)


_COLUMNS = [
    ("place", pa.int32()), ("match_start", pa.int32()), ("matched_text", pa.string()), ("surroundings", pa.string()),
    ("following", pa.string()), ("line_number", pa.int32()), ("context", pa.string()),
]


def candidates(messages: DataFrame, rules: tuple[Rule, ...] | None = None, key: str = "message_id", text: str = "text", gated: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every match of every rule: `key`, columns to `keep`, place of the rule, offset, match, what surrounds it, line and redacted context.

    `gated` leaves out matches that the keyword filter would turn down anyway, as no keyword stands in the whole text.
    """
    those = catalog() if rules is None else tuple(rules)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(those, gated)
        for batch in batches:
            rows, columns = [], [[] for _ in _COLUMNS]
            for row, value in enumerate(batch.column(1).to_pylist()):
                for one in matcher.matches(value) if value else ():
                    rows.append(row)
                    for column, item in zip(columns, one):
                        column.append(item)
                    if len(rows) >= BATCH:
                        yield _as_batch(batch, rows, columns)
                        rows, columns = [], [[] for _ in _COLUMNS]
            if rows:
                yield _as_batch(batch, rows, columns)

    source = messages.select(key, text, *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for i, f in enumerate(source.schema) if i != 1)
    schema = f"{kept}, place int, match_start int, matched_text string, surroundings string, following string, line_number int, context string"
    return spread(source.where(F.length(text) > 0)).mapInArrow(scan, schema)


def _as_batch(batch: pa.RecordBatch, rows: list[int], columns: list[list]) -> pa.RecordBatch:
    at = pa.array(rows, pa.int64())
    kept = [i for i in range(batch.num_columns) if i != 1]
    arrays = [batch.column(i).take(at) for i in kept] + [pa.array(c, t) for c, (_, t) in zip(columns, _COLUMNS)]
    return pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[i] for i in kept] + [n for n, _ in _COLUMNS])


DATABASE_RULES = ["postgres_uri", "mongodb_uri", "mysql_uri", "redis_uri", "cassandra_uri", "cockroachdb_uri", "connection_string_generic", "neon_db_uri"]


def verdicts() -> dict[str, Column]:
    """The filters over candidates joined with their rules, in order; each is true where the candidate stays."""
    rule, match = F.col("pattern_id"), F.col("matched_text")

    def unless(rules: list[str], turned_down: Column) -> Column:
        return ~(rule.isin(rules) & turned_down)

    return {
        "long_enough": F.char_length(match) >= 8,
        "no_example": F.col("skip_example") | ~S.is_example(match),
        "card": unless(["credit_card"], S.is_test_card(match) | ~S.passes_luhn(match)),
        "email": unless(["email_address"], S.is_impersonal_email(match)),
        "address": unless(["basic_auth_url"], S.is_local_address(match)),
        "ssn": unless(["ssn"], S.is_impossible_ssn(match)),
        "database": unless(DATABASE_RULES, S.is_example_database(match) | S.is_regex_literal(match)),
        "phone": unless(["phone_number_us", "phone_number_intl"], S.is_fictional_phone(match)),
        "iban": unless(["iban"], S.is_published_iban(match)),
        "pool": unless(["aws_cognito_pool"], S.is_sample_pool(match)),
        "short_key": unless(["flutterwave_encryption_key"], S.goes_on_as_key(F.col("following"))),
        "placeholder": unless(["generic_secret"], S.is_placeholder(match)),
        "keyword": S.has_keyword(F.col("surroundings"), F.col("context_keywords")),
        "entropy": F.col("entropy_threshold").isNull() | (S.entropy(S.secret_value(match)) >= F.col("entropy_threshold")),
    }


def judged(found: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """Candidates with the columns of their rule and one boolean for each filter."""
    joined = found.join(F.broadcast(catalog_frame(found.sparkSession, rules).drop("regex", "anchors")), "place")
    return joined.withColumns(verdicts())


def findings(messages: DataFrame, rules: tuple[Rule, ...] | None = None, key: str = "message_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each message, rule and matched text that passes all filters: the first of them that does.

    The columns to `keep` come with it, so nothing has to be joined back; of rows that repeat a key the least of them.
    The raw match stays in `matched_text`; reports leave it out.
    """
    found = candidates(messages, rules, key, text, keep=keep)
    joined = found.join(F.broadcast(catalog_frame(found.sparkSession, rules).drop("regex", "anchors")), "place")
    for passed in verdicts().values():
        joined = joined.where(passed)
    first = F.min(F.struct("match_start", "line_number", "context", *keep))
    kept = joined.groupBy(key, "place", "pattern_id", "pattern_name", "category", "severity", "severity_rank", "matched_text").agg(first.alias("at"))
    return kept.select(
        key, *(F.col(f"at.{c}").alias(c) for c in keep), "place", "pattern_id", "pattern_name", "category", "severity", "severity_rank", "matched_text",
        S.redacted(F.col("matched_text")).alias("redacted_text"), "at.match_start", "at.line_number", "at.context",
    )
