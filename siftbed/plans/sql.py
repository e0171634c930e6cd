"""Pieces of DuckDB SQL for the scalar functions, from which the comparison queries are put together.

They are written for DuckDB's lists and RE2, not translated from the Spark expressions, so that an error of one shows.
"""

from __future__ import annotations

from collections.abc import Iterable

from siftbed.functions import fixed_values as fixed


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(items: Iterable[str]) -> str:
    return "(" + ", ".join(text(i) for i in items) + ")"


def any_part(column: str, parts: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(p)})" for p in parts) + ")"


# RE2's white space is ASCII's; this is Unicode's, with the separators that Python counts as well.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def stripped(t: str) -> str:
    return f"regexp_replace({t}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def parts(t: str) -> str:
    return f"regexp_split_to_array({t}, '[=:]{SPACE}*[''\"]?')"


def secret_value(t: str) -> str:
    return f"(CASE WHEN len({parts(t)}) > 1 THEN trim({stripped(f'{parts(t)}[-1]')}, '''\"') ELSE {t} END)"


def entropy(t: str) -> str:
    return f"(CASE WHEN {t} = '' THEN 0.0 ELSE round(list_aggregate(string_split({t}, ''), 'entropy'), 9) END)"


def redacted(t: str) -> str:
    return f"(CASE WHEN length({t}) <= 4 THEN '****' ELSE {t}[:4] || '****' || CASE WHEN length({t}) > 12 THEN '...' ELSE '' END END)"


def digits(t: str) -> str:
    return f"regexp_replace({t}, '[^0-9]', '', 'g')"


def luhn(t: str) -> str:
    d = digits(t)
    return (
        f"(length({d}) >= 13 AND list_sum(list_transform(range(length({d})), lambda i: "
        f"(CASE WHEN i % 2 = 1 THEN (2 * {d}[length({d}) - i]::INT) // 10 + (2 * {d}[length({d}) - i]::INT) % 10 ELSE {d}[length({d}) - i]::INT END))) % 10 = 0)"
    )


def test_card(t: str) -> str:
    return f"{digits(t)} IN {values(fixed.TEST_CARDS)}"


def run(t: str) -> str:
    body = f"regexp_replace(regexp_replace({secret_value(t)}, '^(?i)[a-z]{{2,6}}[_-]', ''), '^(?i)(v1|api\\d*|live|test|proj|ant|or)[_-]', '')"
    tests = " OR ".join(
        f"len(list_filter(range({len(a) - 7}), lambda i: contains({body}, '{a}'[i + 1 : i + 8]))) > 0"
        for a in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789")
    )
    return f"({tests})"


def stepped_hex(t: str) -> str:
    steps = "list_distinct(list_transform(range(1, length(s) // 2), lambda i: ('0x' || s[2 * i + 1 : 2 * i + 2])::INT - ('0x' || s[2 * i - 1 : 2 * i])::INT))"
    return f"({any_part(f'lower({t})', fixed.SYNTHETIC_HEX)} OR len(list_filter(regexp_extract_all(lower({t}), '[0-9a-f]{{8,}}'), lambda s: len({steps}) = 1)) > 0)"


def fragments(t: str) -> str:
    return f"(len(list_filter({list(f.lower() for f in fixed.SYNTHETIC_FRAGMENTS)}, lambda f: contains(lower({t}), f))) >= 2)"


def example(t: str) -> str:
    return f"({any_part(f'lower({t})', fixed.EXAMPLE_WORDS)} OR {run(t)} OR {stepped_hex(t)} OR {fragments(t)})"


def example_database(t: str) -> str:
    user, password, host = (f"lower(regexp_extract({t}, '://([^:]+):([^@]+)@([^/:?\\s]+)', {i}))" for i in (1, 2, 3))
    return (
        f"({host} <> '' AND ({host} IN ('localhost', '127.0.0.1', '0.0.0.0') OR ({user} IN {values(fixed.DATABASE_USERS)} "
        f"AND {password} IN {values(fixed.DATABASE_PASSWORDS)}) OR {host} IN {values(fixed.DATABASE_HOSTS)}))"
    )


def regex_literal(t: str) -> str:
    return f"(contains({t}, '[^') OR contains({t}, '[\\'))"


def impossible_ssn(t: str) -> str:
    d = f"replace({t}, '-', '')"
    return (
        f"(NOT regexp_full_match({d}, '[0-9]{{9}}') OR {d}[:3] IN ('000', '666') OR {d}[1] = '9' OR {d}[4:5] = '00' OR {d}[6:] = '0000' "
        f"OR {d} IN {values(fixed.PUBLISHED_SSNS)} OR len(list_distinct(string_split({d}, ''))) = 1)"
    )


def placeholder(t: str) -> str:
    value = f"lower({secret_value(t)})"
    return (
        f"(len({parts(t)}) > 1 AND ({value} IN {values(fixed.PLACEHOLDERS)} OR (len(list_distinct(string_split({value}, ''))) <= 3 AND length({value}) >= 20) "
        f"OR {value}[1] IN ('/', '~', '$') OR starts_with({value}, './') OR starts_with({value}, 'process.env') "
        f"OR (regexp_full_match({value}, '[a-z_][a-z0-9_]*') AND length({value}) < 30 AND {entropy(secret_value(t))} < 4.0)))"
    )


def impersonal_email(t: str) -> str:
    low = f"lower({t})"
    return (
        f"({any_part(low, fixed.AUTOMATIC_MAILBOXES)} OR (contains({low}, '@') AND (string_split({low}, '@')[-1] IN {values(fixed.IMPERSONAL_DOMAINS)} "
        f"OR regexp_extract({low}, '(?s)^(.*)@', 1) IN {values(fixed.ROLE_MAILBOXES)})))"
    )


def fictional_phone(t: str) -> str:
    d = digits(t)
    return f"(CASE WHEN length({d}) >= 10 THEN right({d}, 10)[:3] = '555' OR right({d}, 10)[4:6] = '555' WHEN length({d}) >= 7 THEN {d}[:3] = '555' ELSE false END)"


def published_iban(t: str) -> str:
    return f"regexp_replace({t}, '\\s', '', 'g') IN {values(fixed.PUBLISHED_IBANS)}"


def local_address(t: str) -> str:
    return any_part(f"lower({t})", fixed.LOCAL_ADDRESSES + fixed.CLONE_USERS)


def sample_pool(t: str) -> str:
    return f"(contains({t}, '_') AND lower({t}[position('_' in {t}) + 1 :]) IN {values(fixed.SAMPLE_POOLS)})"


def goes_on_as_key(t: str) -> str:
    return f"regexp_matches({t}, '^[a-hA-H0-9]{{20}}-X')"


def surroundings(t: str, start: str, length: str, width: int = 200) -> str:
    return f"{t}[greatest({start} - {width}, 0) + 1 : {start} + {length} + {width}]"


def keyword(t: str, keywords: str) -> str:
    return f"(len({keywords}) = 0 OR len(list_filter({keywords}, lambda k: contains(lower({t}), lower(k)))) > 0)"


def line_number(t: str, start: str) -> str:
    return f"len(string_split({t}[:{start}], chr(10)))"


def context_line(t: str, start: str, match: str) -> str:
    end = f"({start} + length({match}))"
    after = f"{t}[{end} + 1 :]"
    rest = f"(CASE WHEN contains({after}, chr(10)) THEN string_split({after}, chr(10))[1] ELSE {after}[:100] END)"
    line = stripped(f"string_split({t}[:{start}], chr(10))[-1] || {match} || {rest}")
    return f"replace({line}, {match}, {redacted(match)})[:200]"


def severity_rank(t: str) -> str:
    return f"coalesce(list_position(['critical', 'high', 'medium', 'low'], lower(trim({t}))) - 1, 4)"
