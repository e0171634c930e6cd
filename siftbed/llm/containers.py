"""Documents packed into containers of fixed capacity, measured by the tokens of a public tokenizer.

Every task packs its own documents as they come, once for each kind of container, by best fit among a bounded number of
open containers. These are kept in a bitset keyed by free space: the lowest set bit at or above what a document needs is
the container that it leaves least room in. Where none has the room, a new one is opened, and the fullest is closed if
there are too many. Nothing is shuffled, and a task holds its open containers only.
"""

from __future__ import annotations

import base64
import functools
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftbed.llm.credentials import TOKENIZER_DIR
from siftbed.session import spread

#: Containers of one kind that a task holds open at once.
OPEN = 64

_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def _encoder(directory: str):
    """The byte-level vocabulary in `directory`, applied to words, numbers and marks as it was trained."""
    import tiktoken

    with open(f"{directory}/byte_bpe_50k.tiktoken", "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("words", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: str | None, directory: str = TOKENIZER_DIR) -> int:
    """The tokens of a text; 0 for null."""
    return len(_encoder(directory).encode_ordinary(text)) if text else 0


class Packer:
    """Best fit into at most `most_open` open containers of one capacity; containers are numbered as they are opened."""

    def __init__(self, capacity: int, most_open: int = OPEN):
        self.capacity, self.most_open, self.opened, self.n_open = capacity, most_open, 0, 0
        self.bits, self.free = 0, defaultdict(list)

    def _take(self, least: int) -> tuple[int, int] | None:
        """(free space, number) of the fullest open container with room for `least`, which is no longer kept; None without one."""
        fitting = self.bits >> least
        if not fitting:
            return None
        room = least + (fitting & -fitting).bit_length() - 1
        number = self.free[room].pop()
        if not self.free[room]:
            del self.free[room]
            self.bits ^= 1 << room
        self.n_open -= 1
        return room, number

    def put(self, size: int) -> int:
        """The container of something of `size`, which is at most the capacity."""
        at = self._take(size)
        if at is None:
            if self.n_open == self.most_open:
                self._take(0)
            at = self.capacity, self.opened
            self.opened += 1
        room = at[0] - size
        if room:
            self.free[room].append(at[1])
            self.bits |= 1 << room
            self.n_open += 1
        return at[1]


def pieces(size: int, capacity: int) -> list[tuple[int, int]]:
    """(first token, tokens) of the pieces of a document: one, if it fits, else full ones and the rest."""
    return [(at, min(capacity, size - at)) for at in range(0, size, capacity)] or [(0, 0)]


def packed(documents: DataFrame, container_sizes: DataFrame, *, record: str = "doc_id", text: str = "text", most_open: int = OPEN, block: int = 100, directory: str = TOKENIZER_DIR) -> DataFrame:
    """container_kind, container_id, record, piece, start_token, n_tokens: for each kind the container of every document.

    Documents over the capacity have a row for each piece, in order from 0; all others have one. Null and empty texts
    have no tokens and take no room. `container_id` is unique within its kind. Rows of `container_sizes` without a kind
    or a positive capacity are left out, and of several capacities of a kind the least holds. The kinds are packed in
    blocks of `block`, each a pass over the documents, so any number of them is.
    """
    kept = container_sizes.where("container_kind IS NOT NULL AND capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").alias("capacity"))
    blocks = max(1, -(-kept.count() // block))
    passes = []
    for k in range(blocks):
        own = kept if blocks == 1 else kept.where(F.pmod(F.xxhash64("container_kind"), F.lit(blocks)) == k)
        passes.append(_packed(documents, sorted((r[0], r[1]) for r in own.collect()), record, text, most_open, directory))
    return functools.reduce(DataFrame.unionByName, passes)


def _packed(documents: DataFrame, sizes: list[tuple[str, int]], record: str, text: str, most_open: int, directory: str) -> DataFrame:
    kind = documents.schema[record].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        packers = [(name, Packer(capacity, most_open)) for name, capacity in sizes]
        for batch in batches:
            counts = [n_tokens(v, directory) for v in batch.column(1).to_pylist()]
            rows = [(name, base + p.put(n), k, piece, at, n) for k, size in enumerate(counts) for name, p in packers for piece, (at, n) in enumerate(pieces(size, p.capacity))]
            names, ids, places, *rest = zip(*rows) if rows else [()] * 6
            arrays = [pa.array(names, pa.string()), pa.array(ids, pa.int64()), batch.column(0).take(pa.array(places, pa.int64())), *(pa.array(x, pa.int32()) for x in rest)]
            yield pa.RecordBatch.from_arrays(arrays, ["container_kind", "container_id", "record", "piece", "start_token", "n_tokens"])

    fields = f"container_kind string, container_id bigint, record {kind}, piece int, start_token int, n_tokens int"
    return spread(documents.select(record, text)).mapInArrow(run, fields).withColumnRenamed("record", record)
