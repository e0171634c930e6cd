"""Scalar functions over candidate secrets, as Column expressions that stay in the JVM.

Null in gives null out, unless a function says otherwise; an empty string is a value without characters. Lengths and
offsets count code points. White space is Unicode's, with the four separators that Python counts as well.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftbed.functions import fixed_values as fixed

_SPACE = r"[\s\x1c-\x1f]"
_DELIMITER = rf"(?U)[=:]{_SPACE}*['\"]?"
_EDGES = rf"(?U)^{_SPACE}+|{_SPACE}+$"
_QUOTES = "'\""


def _one_of(column: Column, values: Iterable[str]) -> Column:
    return column.isin(list(values))


def _has_any(column: Column, parts: Iterable[str]) -> Column:
    """Whether one of several literals stands in the column: one `contains` each, in codegen, the first hit ends it."""
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(column, F.lit(part))
    return found


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, _EDGES, "")


def _parts(text: Column) -> Column:
    return F.split(text, _DELIMITER, -1)


def secret_value(text: Column) -> Column:
    """What stands after the last `=` or `:`, without blanks and quotes at its ends; the whole text without either.

    A text that ends in `=` has an empty value.
    """
    last = F.btrim(stripped(F.element_at(_parts(text), -1)), F.lit(_QUOTES))
    return F.when(F.size(_parts(text)) > 1, last).otherwise(text)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character, rounded to 9 digits as the order of the sum differs; 0.0 for an empty text."""
    n = F.char_length(text).cast("double")

    def bits(total: Column, char: Column) -> Column:
        share = (n - F.char_length(F.replace(text, char, F.lit("")))) / n
        return total - share * F.log2(share)

    total = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), bits)
    return F.when(n > 0, F.round(total, 9)).when(text.isNotNull(), F.lit(0.0))


def redacted(text: Column) -> Column:
    """The first four characters and a mask; only the mask for a text of up to four."""
    longer = F.concat(F.substring(text, 1, 4), F.when(F.char_length(text) > 12, "****...").otherwise("****"))
    return F.when(F.char_length(text) <= 4, "****").when(text.isNotNull(), longer)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Whether the digits of a text satisfy the check digit of cards; false for less than 13 digits."""
    bare = digits(number)
    return (F.char_length(bare) >= 13) & F.call_function("luhn_check", bare)


def is_test_card(number: Column) -> Column:
    return _one_of(digits(number), fixed.TEST_CARDS)


def has_run(text: Column) -> Column:
    """Whether the value has eight characters in a row of the alphabet or of the digits, after up to two short prefixes."""
    body = F.regexp_replace(secret_value(text), "^(?i)[a-z]{2,6}[_-]", "")
    body = F.regexp_replace(body, r"^(?i)(v1|api\d*|live|test|proj|ant|or)[_-]", "")
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"]
    return body.rlike("|".join(a[i : i + 8] for a in alphabets for i in range(len(a) - 7)))


def has_stepped_hex(text: Column) -> Column:
    """Whether a known made-up hexadecimal string occurs, or a run of 4 or more byte pairs with a constant step."""
    low = F.lower(text)

    def stepped(run: Column) -> Column:
        pairs = F.transform(F.regexp_extract_all(run, F.lit(".."), F.lit(0)), lambda pair: F.conv(pair, 16, 10).cast("int"))
        step = F.element_at(pairs, 2) - F.element_at(pairs, 1)
        return F.forall(F.sequence(F.lit(2), F.size(pairs)), lambda i: F.element_at(pairs, i.cast("int")) - F.element_at(pairs, i.cast("int") - 1) == step)

    return _has_any(low, fixed.SYNTHETIC_HEX) | F.exists(F.regexp_extract_all(low, F.lit("[0-9a-f]{8,}"), F.lit(0)), stepped)


def has_fragments(text: Column) -> Column:
    """Whether at least two different fragments of made-up keys occur."""
    low = F.lower(text)
    count = F.lit(0)
    for fragment in fixed.SYNTHETIC_FRAGMENTS:
        count = count + F.contains(low, F.lit(fragment.lower())).cast("int")
    return count >= 2


def is_example(text: Column) -> Column:
    """Whether a match is likely an example of documentation or a test, not a live secret."""
    return _has_any(F.lower(text), fixed.EXAMPLE_WORDS) | has_run(text) | has_stepped_hex(text) | has_fragments(text)


def is_example_database(uri: Column) -> Column:
    """Whether a connection string points at this machine or has the user and password, or the host, of an example."""
    shape = r"(?U)://([^:]+):([^@]+)@([^/:?\s\x1c-\x1f]+)"
    user, password, host = (F.lower(F.regexp_extract(uri, shape, i)) for i in (1, 2, 3))
    local = _one_of(host, ["localhost", "127.0.0.1", "0.0.0.0"])
    example = _one_of(user, fixed.DATABASE_USERS) & _one_of(password, fixed.DATABASE_PASSWORDS)
    return (host != "") & (local | example | _one_of(host, fixed.DATABASE_HOSTS))


def is_regex_literal(uri: Column) -> Column:
    return uri.rlike(r"\[[\^\\]")


def is_impossible_ssn(number: Column) -> Column:
    """Whether a social security number can't have been issued or is a published one; true for anything but nine digits."""
    bare = F.replace(number, F.lit("-"), F.lit(""))
    area, group, serial = F.substring(bare, 1, 3), F.substring(bare, 4, 2), F.substring(bare, 6, 4)
    odd = (area == "000") | (area == "666") | (area >= "900") | (group == "00") | (serial == "0000")
    return ~bare.rlike("^[0-9]{9}\\z") | odd | _one_of(bare, fixed.PUBLISHED_SSNS) | bare.rlike(r"^(.)\1*\z")


def is_placeholder(text: Column) -> Column:
    """Whether an assignment holds a placeholder, a path, a variable or a name rather than a secret."""
    original = secret_value(text)
    value = F.lower(original)
    dull = (F.size(F.array_distinct(F.split(value, ""))) <= 3) & (F.char_length(value) >= 20)
    name = value.rlike("^[a-z_][a-z0-9_]*$") & (F.char_length(value) < 30) & (entropy(original) < 4.0)
    started = F.startswith(value, F.lit("/")) | F.startswith(value, F.lit("./")) | F.startswith(value, F.lit("~"))
    variable = F.startswith(value, F.lit("$")) | F.startswith(value, F.lit("process.env"))
    return (F.size(_parts(text)) > 1) & (_one_of(value, fixed.PLACEHOLDERS) | dull | started | name | variable)


def is_impersonal_email(address: Column) -> Column:
    """Whether an address is that of a machine or a role, or at a domain that names no one."""
    low = F.lower(address)
    domain = F.substring_index(low, "@", -1)
    local = F.substring(low, F.lit(1), F.char_length(low) - F.char_length(domain) - 1)
    parted = F.contains(low, F.lit("@")) & (_one_of(domain, fixed.IMPERSONAL_DOMAINS) | _one_of(local, fixed.ROLE_MAILBOXES))
    return _has_any(low, fixed.AUTOMATIC_MAILBOXES) | parted


def is_fictional_phone(number: Column) -> Column:
    """Whether a number has the area or exchange 555: the last ten digits count, or of seven to nine the first three."""
    bare = digits(number)
    n = F.char_length(bare)
    last = F.substring(bare, -10, 10)
    long = (F.substring(last, 1, 3) == "555") | (F.substring(last, 4, 3) == "555")
    return F.when(n >= 10, long).when(n >= 7, F.substring(bare, 1, 3) == "555").when(number.isNotNull(), False)


def is_published_iban(number: Column) -> Column:
    return _one_of(F.regexp_replace(number, rf"(?U){_SPACE}", ""), fixed.PUBLISHED_IBANS)


def is_local_address(url: Column) -> Column:
    """Whether an address with a password is of this machine, or of a clone whose token other rules find."""
    return _has_any(F.lower(url), fixed.LOCAL_ADDRESSES + fixed.CLONE_USERS)


def is_sample_pool(pool: Column) -> Column:
    """Whether what follows the first underscore names a user pool of the documentation; false without one."""
    at = F.instr(pool, "_")
    return (at > 0) & _one_of(F.lower(F.substring(pool, at + 1, F.char_length(pool))), fixed.SAMPLE_POOLS)


def goes_on_as_key(following: Column) -> Column:
    """Whether the text after a short encryption key goes on as the longer secret key, which another rule finds."""
    return F.coalesce(following.rlike("^[a-hA-H0-9]{20}-X"), F.lit(False))


def surroundings(text: Column, start: Column, length: Column, width: int = 200) -> Column:
    """The match at `start` (from 0) with up to `width` characters before and after it."""
    first = F.greatest(start - width, F.lit(0))
    return F.substring(text, first + 1, start + length + width - first)


def has_keyword(text: Column, keywords: Column) -> Column:
    """Whether one of an array of keywords stands in the text in any case; true if there are none."""
    low = F.lower(text)
    return (F.size(keywords) == 0) | F.exists(keywords, lambda k: F.contains(low, F.lower(k)))


def line_number(text: Column, start: Column) -> Column:
    """The line, from 1, of the character at `start`, from 0."""
    before = F.substring(text, F.lit(1), start)
    return F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def context_line(text: Column, start: Column, match: Column, most: int = 200) -> Column:
    """The line of a match with every occurrence of it redacted, cut to `most` characters.

    Without a line end after the match at most 100 characters follow it.
    """
    end = start + F.char_length(match)
    after = F.substring(text, end + 1, F.char_length(text))
    rest = F.when(F.contains(after, F.lit("\n")), F.substring_index(after, "\n", 1)).otherwise(F.substring(after, 1, 100))
    before = F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)
    line = stripped(F.concat(before, match, rest))
    return F.substring(F.replace(line, match, redacted(match)), 1, most)


def match_offsets(text: Column, regex: Column) -> Column:
    """All matches of a regex as an array of (start, match), from the first, none overlapping another.

    The gaps between the matches give the places, so it is one pass of the JVM's regex engine for each of both.
    """
    found, gaps = F.regexp_extract_all(text, regex, F.lit(0)), F.split(text, regex, -1)
    step = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), F.char_length(g).alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,match:string>>").alias("out"))

    def add(state: Column, one: Column) -> Column:
        here = state["at"] + one["g"]
        item = F.struct(here.cast("int").alias("start"), one["m"].alias("match"))
        return F.struct((here + F.char_length(one["m"])).cast("int").alias("at"), F.concat(state["out"], F.array(item)).alias("out"))

    return F.aggregate(step, start, add, lambda state: state["out"])


def occurrences(text: Column, part: str) -> Column:
    """How often `part` stands in the text, without overlaps; at least 1, as a file is one conversation."""
    return F.greatest(F.size(F.split(text, rf"\Q{part}\E", -1)) - 1, F.when(text.isNotNull(), F.lit(1)))


def conversation_estimate(messages: Column, each: int) -> Column:
    """One conversation for every `each` messages, at least one if there are any."""
    return F.when(messages == 0, 0).otherwise(F.greatest(F.floor(messages / each), F.lit(1))).cast("bigint")


def with_home(path: Column, home: str) -> Column:
    return F.replace(path, F.lit(home), F.lit("~"))


def grouped(number: Column) -> Column:
    """A whole number with commas between thousands."""
    return F.format_number(number.cast("bigint"), 0)


def epoch_ms(value: Column) -> Column:
    """The UTC instant of a number of milliseconds; a fraction of one is kept to microseconds, 0 and null give null."""
    return F.when(value != 0, F.timestamp_micros((value * 1000).cast("bigint")))


def iso_instant(value: Column) -> Column:
    """The instant of an ISO 8601 text, `Z` or an offset; UTC without either, null if it is none."""
    shaped = value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(shaped, F.try_to_timestamp(F.regexp_replace(F.replace(value, F.lit(","), F.lit(".")), r"([+-]\d{2})(\d{2})$", "$1:$2")))


def within_days(at: Column, days: int, as_of: Column) -> Column:
    """Whether an instant is at most `days` before `as_of`; true for every instant if `days` is 0, and for null."""
    return F.lit(True) if days <= 0 else at.isNull() | (at >= as_of - F.make_dt_interval(F.lit(days)))
