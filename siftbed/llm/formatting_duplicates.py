"""Records that are the same but for formatting: white space, letter case, punctuation, order of named fields.

Progressive partition refinement: all rows are first put into classes by what is cheap and no formatting changes, the
length of the letters and digits and their histogram. Only rows of classes with several members get the next, costlier
key: the letters and digits in order, with named fields sorted. No class is ever gathered in one task: classes are
counted by partial aggregation, and rows meet the counts by a shuffle join, except those of the few heaviest classes
(each over a thousandth of all rows, so at most a thousand), which meet them by broadcast. Rows with the same letters in
order may read as different fields, and rows with the same fields have different orders: classes that meet that way are
joined until none is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftbed.session import written

#: A class with more than this share of the rows is heavy; there are at most 1 / HEAVY of them.
HEAVY = 0.001

# What separates the fields of a JSON object, of the query of a URL and of a connection string.
_QUOTE = "[\"'`“”‘’]"
_JSON = rf"^[^{{]*\{{\s*\\?{_QUOTE}?[\w.-]+\\?{_QUOTE}?\s*:"
_JSON_COMMA = rf",(?=\s*\\?{_QUOTE}[\w.-]+\\?{_QUOTE}\s*:)|^[^{{]*\{{|\}}[^}}]*$"
_URL = r"^[^?]*\?\s*[\w.~%-]+\s*=[^&]*&"
_PAIRS = r"(?s)^[^;=]*=[^;]*;.*="


def stripped(text: Column) -> Column:
    """The letters and digits of a text in lower case; empty for null."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def histogram(text: Column) -> Column:
    """A 64-bit key of the length and the character histogram of a stripped text."""
    return F.xxhash64(F.length(text), F.array_join(F.array_sort(F.split(text, "")), ""))


def fields_key(text: Column) -> Column:
    """The stripped fields of a JSON object, a URL query or a connection string, sorted; null for any other text."""

    def joined(parts: Column) -> Column:
        kept = F.filter(F.transform(parts, stripped), lambda x: x != "")
        return F.array_join(F.array_sort(kept), "|")

    # The part of a URL before its query keeps its place.
    at = F.instr(text, "?")
    url = F.concat(stripped(F.substring(text, F.lit(1), at)), F.lit("?"), joined(F.split(text.substr(at + 1, F.length(text)), "&")))
    return F.when(text.rlike(_JSON), joined(F.split(text, _JSON_COMMA))).when(text.rlike(_URL), url).when(text.rlike(_PAIRS), joined(F.split(text, ";")))


def _met(rows: DataFrame, classes: DataFrame, key: str, total: int, of: str | None = None) -> DataFrame:
    """Rows with the columns of their class, or only its column `of`; those whose class isn't in `classes` are dropped."""
    heavy = classes.where(F.col("n") > max(1.0, HEAVY * total))
    light = classes.where(F.col("n") <= max(1.0, HEAVY * total))
    if of:
        heavy, light = heavy.select(key, of), light.select(key, of)
    names = [r[0] for r in heavy.select(key).limit(int(1 / HEAVY) + 1).collect()]
    if not names:
        return rows.join(light, key)
    is_heavy = F.col(key).isin(names)
    return rows.where(is_heavy).join(F.broadcast(heavy), key).unionByName(rows.where(~is_heavy).join(light, key))


def formatting_duplicates(
    records: DataFrame, *, record: str = "finding_id", text: str = "matched_text", other: tuple[str, ...] = ("pattern_id", "source_file")
) -> DataFrame:
    """keep_id, copy_id, copies: for every row but the first of its group of copies, the first row and the group's size.

    Rows are copies if `text` and each of the `other` columns have the same letters and digits in the same order; the
    named fields of `text` may be in any order. Nulls count as empty texts, so rows without any letter or digit in all
    columns are copies of each other. Record ids are taken to be unique; ids that aren't give a row for each repetition
    of a later id. Other columns are ignored. An empty table gives no rows.
    """
    parts = [stripped(F.col(c)) for c in (text, *other)]
    rows = records.select(F.col(record).alias("id"), F.col(text).alias("text"), *(p.alias(f"p{k}") for k, p in enumerate(parts)))
    names = [f"p{k}" for k in range(len(parts))]
    cheap = F.xxhash64(histogram(F.col("p0")), *(F.length(p) for p in names[1:]), *(histogram(F.col(p)) for p in names[1:]))
    rows = written(rows.withColumn("class", cheap), "stripped")
    total = rows.count()

    several = rows.groupBy("class").agg(F.count("*").alias("n")).where("n > 1")
    rows = _met(rows, several, "class", total).drop("n", "class")

    in_order = reduce(lambda a, b: F.concat(a, F.lit("|"), b), map(F.col, names))
    rest = reduce(lambda a, b: F.concat(a, F.lit("|"), b), [F.col(p) for p in names[1:]], F.lit(""))
    fields = fields_key(F.col("text"))
    rows = rows.select("id", F.sha2(in_order, 256).alias("in_order"), F.when(fields.isNotNull(), F.sha2(F.concat(fields, F.lit("|"), rest), 256)).alias("by_fields"))
    rows = written(rows, "keyed")
    # One row for each reading of each order, however many copies it has.
    pairs = rows.groupBy("in_order", F.coalesce("by_fields", "in_order").alias("reading")).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    pairs = written(pairs, "readings")
    keys = _classes(pairs, total)
    orders = _met(pairs, keys, "in_order", total, of="key")
    groups = orders.groupBy("key").agg(F.min("first").alias("keep_id"), F.sum("n").alias("copies")).where("copies > 1")
    orders = _met(keys.select("in_order", "key"), groups.withColumn("n", F.col("copies")), "key", total).select("in_order", "keep_id", "copies", F.col("copies").alias("n"))
    found = _met(rows.select("id", "in_order"), orders, "in_order", total)
    return found.where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id"), "copies")


def _classes(pairs: DataFrame, total: int) -> DataFrame:
    """in_order, key, n: the class of every order. Orders of one reading are of one class, and so are readings of one order.

    The least reading spreads over what it meets until nothing changes; an order with several readings is rare, so there
    is mostly nothing to spread.
    """
    keys = pairs.groupBy("in_order").agg(F.min("reading").alias("key"), F.max("reading").alias("last"), F.sum("n").alias("n"))
    several = not keys.where("key <> last").limit(1).isEmpty()
    keys = keys.drop("last")
    while several:
        readings = _met(pairs.select("in_order", "reading"), keys, "in_order", total)
        least = readings.groupBy("reading").agg(F.min("key").alias("least"), F.sum("n").alias("n"))
        spread = _met(pairs.select("in_order", "reading"), least, "reading", total).groupBy("in_order").agg(F.min("least").alias("key"))
        after = written(keys.withColumnRenamed("key", "before").join(spread, "in_order"), "classes")
        several = not after.where("key <> before").limit(1).isEmpty()
        keys = after.select("in_order", "key", "n")
    return keys
