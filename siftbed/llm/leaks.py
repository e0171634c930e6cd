"""Evaluation passages that leak into a corpus, found with an FM-index per shard of documents.

The words of the test passages are an alphabet of bounded size. Every shard of documents becomes one sequence over it:
words that no passage has, and runs of passage words too short to hold a phrase, are one symbol that is never searched.
The shard's FM-index (the Burrows-Wheeler transform in a wavelet matrix) is searched backwards for all phrases of `SEED`
words of the passages at once; occurrences are located by sampled suffix positions, at most one for each word of a
document. Pairs of a document and a passage are compared unless the words that their hits cover, on either side, can't
make a leak, however many passages have a phrase. The hits of a pair are put together in stretches and chained in order,
and enough words of them are a leak. The words of all stretches of hits are the spans to remove. Documents longer than a
shard are searched in pieces whose hits are put together. Shards live within one task, so nothing is shuffled, and
passages are broadcast in blocks of bounded size, each a pass of its own.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from siftbed.session import spread

#: Words of a phrase that is searched.
SEED = 3
#: Matched words that make a leak: a stretch of 20 words with isolated ones changed.
ENOUGH = 14
#: Words that may lie between two matched ones of a stretch, in the document or in the passage.
GAP = 8
#: Matched words of a part of a leak that stands apart from the others.
PART = 6
#: Words from one hit to the next of a stretch, at most; and hits that are compared at once.
REACH, AT_ONCE = GAP + SEED - 1, 1 << 20
#: Symbols of a shard, and the distance of sampled suffix positions.
SHARD, SAMPLE = 1 << 18, 8

_TOKEN = re.compile(r"[^\W_]+")
_MARKER = re.compile(r"(?m)^([ \t>#*|+/-]*)\(?\[?(\d{1,4}|[A-Za-z])[.):|\]]+(?=\s)")


def words(text: str) -> list[str]:
    """The words of a text in lower case, without numbers or letters that mark its lines."""
    return [m[0].lower() for m in _tokens(text)]


def _tokens(text: str) -> Iterator[re.Match]:
    """The words of a text at their places: nothing that changes its length comes before."""
    return _TOKEN.finditer(_MARKER.sub(lambda m: " " * len(m[0]), text))


class FMIndex:
    """The FM-index of a sequence of small integers up to `sigma`, whose last one is 0; 0 may also part its texts."""

    def __init__(self, sequence: np.ndarray, sigma: int):
        # The end has a symbol of its own, below all others: where it was one of several zeros, its place among them in
        # the transform would not be that among the suffixes, and steps back from the others would go astray.
        sequence, sigma = sequence + 1, sigma + 1
        sequence[-1] = 0
        n = len(sequence)
        suffixes = _suffix_array(sequence)
        self.n, self.bits = n, max(1, int(sigma).bit_length())
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=sigma + 1))])
        level = sequence[suffixes - 1].astype(np.int64)  # the transform: what precedes each suffix
        sampled = suffixes % SAMPLE == 0
        self.sampled, self.sample_rank, self.samples = sampled, np.cumsum(sampled) - 1, suffixes[sampled]
        self.zeros: list[np.ndarray] = []
        for b in range(self.bits - 1, -1, -1):
            one = (level >> b) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - one)]))
            level = np.concatenate([level[one == 0], level[one == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first `at` of the transform."""
        start, end = np.zeros_like(at), at
        for k, zeros in enumerate(self.zeros):
            one = (symbol >> (self.bits - 1 - k)) & 1
            all_zeros = zeros[-1]
            start = np.where(one, all_zeros + start - zeros[start], zeros[start])
            end = np.where(one, all_zeros + end - zeros[end], zeros[end])
        return end - start

    def symbol(self, at: np.ndarray) -> np.ndarray:
        """The symbols of the transform at the given places."""
        out = np.zeros_like(at)
        for zeros in self.zeros:
            one = zeros[at + 1] == zeros[at]
            out = out * 2 + one
            at = np.where(one, zeros[-1] + at - zeros[at], zeros[at])
        return out

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of symbols, the range of suffixes that begin with it, found from its last symbol backwards."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, k] + 1
            low, high = self.starts[c] + self.rank(c, low), self.starts[c] + self.rank(c, high)
            high = np.maximum(low, high)
        return low, high

    def locate(self, at: np.ndarray) -> np.ndarray:
        """The positions of suffixes: steps back through the transform until a sampled one is met."""
        at, out, steps = at.copy(), np.full(len(at), -1, dtype=np.int64), 0
        open_ = np.arange(len(at))
        while len(open_):
            met = self.sampled[at[open_]]
            done = open_[met]
            out[done] = self.samples[self.sample_rank[at[done]]] + steps
            open_ = open_[~met]
            c = self.symbol(at[open_])
            at[open_] = self.starts[c] + self.rank(c, at[open_])
            steps += 1
        return out


def _suffix_array(sequence: np.ndarray) -> np.ndarray:
    """The order of the suffixes, by prefix doubling. Its last symbol has to be the smallest; equal ends are told apart by position."""
    n = len(sequence)
    # The end is smaller than anything, so that no suffix runs over it.
    rank, step = sequence.astype(np.int64) + 1, 1
    rank[-1] = 0
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (int(after.max()) + 1) + after
        order = np.argsort(key, kind="stable")
        changed = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = changed
        if changed[-1] == n - 1 or step >= n:
            return order
        step *= 2


@dataclass
class Phrases:
    """The searched phrases of a block of passages. Phrase k stands at the places first[k] to first[k + 1]: number of the passage, word."""

    items: list
    vocabulary: dict[str, int]
    symbols: np.ndarray
    first: np.ndarray
    passage: np.ndarray
    word: np.ndarray


def passages(items: DataFrame, item: str, text: str) -> DataFrame:
    """item, passage: each item's text without a first sentence that it shares with other items, which is an instruction.

    The sentences are counted over all items.
    """
    kind = items.schema[item].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [v or "" for v in batch.column(1).to_pylist()]
            parts = [re.split(r"(?<=[.!?:])\s+", v.strip(), maxsplit=1) for v in texts]
            firsts = [" ".join(words(x[0])) if len(x) > 1 else None for x in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(firsts, pa.string()), pa.array([x[-1] for x in parts], pa.string()), pa.array(texts, pa.string())], ["item", "first", "rest", "whole"])

    split = items.select(item, text).mapInArrow(run, f"item {kind}, first string, rest string, whole string")
    shared = split.where("first IS NOT NULL").groupBy("first").agg(F.count("*").alias("n")).where("n > 1").select("first", F.lit(True).alias("shared"))
    return split.join(shared, "first", "left").select("item", F.when(F.col("shared"), F.col("rest")).otherwise(F.col("whole")).alias("passage"))


def phrases(items: list[tuple[object, str]]) -> Phrases:
    """All phrases of SEED words of (item, passage) pairs; passages with fewer words have none."""
    texts = [words(t) for _, t in items]
    vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for t in texts for w in t}))}
    numbers = [np.array([vocabulary[w] for w in t], dtype=np.int64) for t in texts]
    every = [np.lib.stride_tricks.sliding_window_view(t, SEED) for t in numbers if len(t) >= SEED]
    symbols, phrase = np.unique(np.concatenate([np.zeros((0, SEED), dtype=np.int64), *every]), axis=0, return_inverse=True)
    phrase = phrase.reshape(-1)
    order = np.argsort(phrase, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(phrase, minlength=len(symbols)))])
    sizes = np.array([max(0, len(t) - SEED + 1) for t in texts], dtype=np.int64)
    passage, word = np.repeat(np.arange(len(texts)), sizes), _ranges(np.zeros_like(sizes), sizes)
    return Phrases([i for i, _ in items], vocabulary, symbols, first, passage[order], word[order])


def runs(ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of passage words that are long enough to hold a phrase."""
    inside = np.concatenate([[0], ids > 0, [0]]).astype(np.int8)
    edge = np.flatnonzero(np.diff(inside))
    return [(a, b) for a, b in edge.reshape(-1, 2).tolist() if b - a >= SEED]


def chain(at: np.ndarray, word: np.ndarray) -> int:
    """How many matches of a document word and a passage word, in order, the longest chain has that goes forward in both.

    It is a stretch of the passage, where at most GAP words are unmatched at the end of a part and at the start of the
    next one; any text may stand between them in the document.
    """
    far = 2 * GAP
    if _wide(at):
        top = np.zeros(int(word.max()) + 1 + far, dtype=np.int64)
        before = np.lib.stride_tricks.sliding_window_view(top, far)
        for row in np.split(word, np.flatnonzero(np.diff(at)) + 1):
            n = before[row].max(axis=1) + 1
            top[row + far] = np.maximum(top[row + far], n)
        return int(top.max())
    best: dict[int, int] = {}
    for _, b in sorted(zip(at.tolist(), word.tolist()), key=lambda p: (p[0], -p[1])):
        best[b] = max(best.get(b, 0), 1 + max(best.get(y, 0) for y in range(b - far, b)))
    return max(best.values(), default=0)


def stretches(at: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Which matches of a document word and a passage word, in order, stand in a stretch of at least PART of them.

    A stretch goes forward in both by at most GAP words at a time; a document may hold several of the same words, in any order.
    """
    until, since = _until(at, word), _until(-at[::-1], -word[::-1])[::-1]
    return until + since > PART


def _wide(at: np.ndarray) -> bool:
    """Whether words of the document match many of the passage, as where one word is repeated."""
    return len(at) > 16 * (1 + np.count_nonzero(np.diff(at)))


def _until(at: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The matches of the longest stretch that ends with each match."""
    if _wide(at):
        word = word - word.min()
        # The longest that end at each word of the passage, of the last GAP words of the document and of all of them.
        last = np.zeros((GAP, int(word.max()) + 1 + GAP), dtype=np.int64)
        top = np.zeros(last.shape[1], dtype=np.int64)
        before, out, done = np.lib.stride_tricks.sliding_window_view(top, GAP), [], int(at[0])
        starts = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
        for a, row in zip(at[starts].tolist(), np.split(word, starts[1:])):
            for x in range(max(done, a - GAP), a):
                last[x % GAP] = 0
            last.max(axis=0, out=top)
            out.append(before[row].max(axis=1) + 1)
            last[a % GAP] = 0
            last[a % GAP, row + GAP] = out[-1]
            done = a + 1
        return np.concatenate(out)
    rows: dict[int, dict[int, int]] = defaultdict(dict)
    out = []
    for a, b in zip(at.tolist(), word.tolist()):
        most = 0
        for x in range(a - GAP, a):
            row = rows.get(x, {})
            # A word that the passage repeats has many places; only those within the gap are looked at.
            for y in row if len(row) <= GAP else range(b - GAP, b):
                if b - GAP <= y < b:
                    most = max(most, row.get(y, 0))
        rows[a][b] = most + 1
        out.append(most + 1)
    return np.array(out, dtype=np.int64)


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of every range, one after the other."""
    return np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _covered(passage: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The passages whose hits at the given words, all of a document or all of the passage, cover enough words in parts."""
    if not len(at):
        return passage
    span = int(at.max()) + SEED + GAP
    spots = np.unique((passage * span + at)[:, None] + np.arange(SEED))
    begin = np.flatnonzero(np.concatenate([[True], np.diff(spots) > GAP]))
    sizes = np.diff(np.append(begin, len(spots)))
    which, start = np.unique(spots[begin] // span, return_index=True)
    return which[np.add.reduceat(np.where(sizes >= PART, sizes, 0), start) >= ENOUGH]


def _near(passage: np.ndarray, at: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Which hits, ordered by passage and word of the document, have another one in reach; one alone is no part."""
    near = np.zeros(len(at), dtype=bool)
    for step in range(1, min(len(at), 33)):
        close = (passage[step:] == passage[:-step]) & (at[step:] - at[:-step] <= REACH)
        if near.all() or not close.any():
            break
        # What has so many hits in reach in the document alone stays for the comparison.
        if step < 32:
            close &= np.abs(word[step:] - word[:-step]) <= REACH
        near[step:] |= close
        near[:-step] |= close
    return near


def _compared(hits: list[tuple[int, int]], wanted: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of a passage, document words, passage words) of the hits with the passages that may be repeated.

    What is left out can't make a leak: each match of one stands in a part of at least PART, and has ENOUGH in all.
    """
    if len(hits) * SEED < ENOUGH:
        return
    at, phrase = np.array(sorted(hits, key=lambda h: h[1]), dtype=np.int64).T
    held, begin, times = np.unique(phrase, return_index=True, return_counts=True)
    # First the places of the phrases that the document has, each once, however often it has them.
    sizes = wanted.first[held + 1] - wanted.first[held]
    places, owner = _ranges(wanted.first[held], sizes), np.repeat(np.arange(len(held)), sizes)
    kept = np.bincount(wanted.passage[places])[wanted.passage[places]] * SEED >= ENOUGH
    places, owner = places[kept], owner[kept]
    kept = np.isin(wanted.passage[places], _covered(wanted.passage[places], wanted.word[places]))
    places, owner = places[kept], owner[kept]
    if not len(places):
        return
    order = np.argsort(wanted.passage[places], kind="stable")
    places, owner = places[order], owner[order]
    # Then the hits of the passages that are left, in blocks of whole passages.
    _, start = np.unique(wanted.passage[places], return_index=True)
    before = (np.cumsum(times[owner]) - times[owner])[start] // AT_ONCE
    for rows in np.split(np.arange(len(places)), start[1:][np.diff(before) > 0]):
        n = times[owner[rows]]
        a = at[_ranges(begin[owner[rows]], n)]
        i, b = np.repeat(wanted.passage[places[rows]], n), np.repeat(wanted.word[places[rows]], n)
        order = np.lexsort((b, a, i))
        i, a, b = i[order], a[order], b[order]
        kept = _near(i, a, b)
        i, a, b = i[kept], a[kept], b[kept]
        kept = np.isin(i, np.intersect1d(_covered(i, a), _covered(i, b)))
        i, a, b = i[kept], a[kept], b[kept]
        which, start = np.unique(i, return_index=True)
        for k, x, y in zip(which.tolist(), np.split(a, start[1:]), np.split(b, start[1:])):
            yield k, x, y


def occurrences(pieces: list[tuple[int, int, np.ndarray]], wanted: Phrases) -> Iterator[tuple[int, int, int]]:
    """(document, word, phrase) of every phrase in a shard of (document, first word, word ids), by the shard's FM-index."""
    parts, at, size = [], [], 0
    for d, begin, ids in pieces:
        for a, b in runs(ids):
            parts += [ids[a:b], [0]]
            at.append((size, d, begin + a))
            size += b - a + 1
    if not parts:
        return
    index = FMIndex(np.concatenate(parts).astype(np.int64), len(wanted.vocabulary) + 1)
    low, high = index.search(wanted.symbols)
    found = np.flatnonzero(high > low)
    if not len(found):
        return
    sizes = (high - low)[found]
    rows = _ranges(low[found], sizes)
    where, phrase = index.locate(rows), np.repeat(found, sizes)
    run = np.searchsorted(np.array([x[0] for x in at]), where, side="right") - 1
    for p, k, r in zip(where.tolist(), phrase.tolist(), run.tolist()):
        begin, d, a = at[r]
        yield d, a + p - begin, k


def repeated(hits: list[tuple[int, int]], wanted: Phrases) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(number of a passage, matches) of the passages that one document's (word, phrase) hits repeat.

    One chain through stretches with enough words makes a leak; its matches are those of all stretches, as a
    passage may stand there repeatedly or with its parts in another order. Each word of either side is in them, but
    one that is repeated not with all the words that it matches.
    """
    known: dict[bytes, list[tuple[int, int]]] = {}
    for i, at, word in _compared(hits, wanted):
        # Passages that share some of their words have the same matches but for the words before them.
        first = int(word.min())
        key = np.stack([at, word - first]).tobytes()
        if key not in known:
            width = int(word.max()) - first + SEED
            pairs = np.unique(at * width + word - first + np.arange(SEED)[:, None] * (width + 1))
            a, b = pairs // width, pairs % width
            inside = stretches(a, b)
            a, b = a[inside], b[inside]
            shown = np.union1d(np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1])
            known[key] = list(zip(a[shown].tolist(), b[shown].tolist())) if chain(a, b) >= ENOUGH else []
        if known[key]:
            yield i, [(a, b + first) for a, b in known[key]]


def _matches(texts: list[tuple[object, np.ndarray]], wanted: Phrases, size: int | None = None) -> Iterator[tuple[object, object, list[tuple[int, int]]]]:
    """(document, item, matches) of the leaks of (document, word ids), searched in shards of about `size` symbols.

    Pieces of a long document overlap by less than a phrase, so that each hit is found once.
    """
    size = size or SHARD
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    shard, held = [], 0

    def search() -> None:
        for d, a, k in occurrences(shard, wanted):
            hits[d].append((a, k))

    for d, (_, ids) in enumerate(texts):
        for begin in range(0, len(ids), size):
            piece = ids[begin : begin + size + SEED - 1]
            shard.append((d, begin, piece))
            held += sum(b - a + 1 for a, b in runs(piece))
            if held >= size:
                search()
                shard, held = [], 0
    search()
    for d in sorted(hits):
        for i, path in repeated(hits[d], wanted):
            yield texts[d][0], wanted.items[i], path


@functools.lru_cache(maxsize=1)
def _spots(text: str) -> list[tuple[int, int]]:
    """Where the words of a text stand, kept for all the leaks of one document."""
    return [m.span() for m in _tokens(text)]


def spans(text: str, path: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends in the text of the stretches of matched words, which may have up to GAP others in between."""
    spots = _spots(text)
    out: list[list[int]] = []
    for w, _ in path:
        if out and w - out[-1][2] <= GAP:
            out[-1][1:] = [spots[w][1], w]
        else:
            out.append([*spots[w], w])
    return [s[0] for s in out], [s[1] for s in out]


def _searched(documents: DataFrame, wanted: Broadcast, item_kind: str) -> DataFrame:
    """One pass over all documents with one block of passages."""
    kind = documents.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases_of = wanted.value
        get = phrases_of.vocabulary.get

        def searched(texts: list) -> Iterator[pa.RecordBatch]:
            found = ((record, i, len({p for _, p in path}), *spans(value, path)) for (record, value), i, path in _matches(texts, phrases_of))
            while out := list(itertools.islice(found, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], f.type) for k, f in enumerate(schema)], schema=schema)

        texts, size, schema = [], 0, None
        for batch in batches:
            schema = schema or pa.schema([("record", batch.schema.field(0).type), ("item", item_type), ("n_words", pa.int32()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
            for record, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([get(w, 0) for w in words(value or "")], dtype=np.int64)
                n = sum(b - a + 1 for a, b in runs(ids))
                if n:
                    texts.append(((record, value), ids))
                    size += n
                if size >= SHARD:
                    yield from searched(texts)
                    texts, size = [], 0
        if texts:
            yield from searched(texts)

    item_type = to_arrow_type(_parse_datatype_string(item_kind))
    return documents.mapInArrow(run, f"record {kind}, item {item_kind}, n_words int, starts array<int>, ends array<int>")


def leaks(documents: DataFrame, items: DataFrame, *, record: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block: int = 20_000) -> DataFrame:
    """record, item, n_words, starts, ends: one row for each document and item whose passage it repeats, wholly or in part.

    `starts` and `ends` are the character offsets in the document of the merged spans to remove, those of every copy.
    `n_words` counts the words of the passage in them. The passages are held by every executor in blocks of about
    `block`; each block is a pass over the documents, so any number of items is searched. Null and empty texts have no
    leaks; items with fewer words than a leak needs can't be found; repeated documents have a row each, and so have
    repeated items.
    """
    context = documents.sparkSession.sparkContext
    texts = passages(items, item, item_text)
    blocks = max(1, -(-items.count() // block))
    kind = items.schema[item].dataType.simpleString()
    passes = []
    for k in range(blocks):
        rows = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("passage"), F.lit(blocks)) == k)
        wanted = phrases([tuple(r) for r in rows.collect()])
        passes.append(_searched(spread(documents.select(record, text)), context.broadcast(wanted), kind))
    return functools.reduce(DataFrame.unionByName, passes).withColumnRenamed("record", record).withColumnRenamed("item", item)
