"""Documents in containers."""

from __future__ import annotations

import random
from collections import defaultdict

import __spark_entry__
from siftbed.llm import containers
from siftbed.session import get_spark


def test_best_fit_among_open_containers():
    rng = random.Random(5)
    for most_open in (1, 3, 64):
        packer, open_, plain_opened = containers.Packer(50, most_open), {}, 0
        for size in [rng.randint(0, 50) for _ in range(400)]:
            number = packer.put(size)
            fits = [free for free in open_.values() if free >= size]
            if fits:
                assert open_[number] == min(fits)
            else:
                if len(open_) == most_open:
                    fullest = min(open_.values())
                    still = {n for v in packer.free.values() for n in v}
                    del open_[next(n for n, f in open_.items() if f == fullest and n not in still)]
                assert number == plain_opened
                plain_opened += 1
                open_[number] = 50
            open_[number] -= size
            if not open_[number]:
                del open_[number]
            assert packer.n_open == len(open_) <= most_open


def test_every_document_has_its_containers():
    assert "p6_containers" in __spark_entry__.queries()
    spark = get_spark(master="local[2]")
    texts = {1: "one two three", 2: None, 3: "", 4: "word " * 500, 5: "größer 漢字 🙂", 6: "a b c d e f g h"}
    sizes = {"small": 16, "large": 100}
    documents = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = containers.packed(documents, spark.createDataFrame(list(sizes.items()), "container_kind string, capacity_tokens int")).collect()
    filled, of = defaultdict(int), defaultdict(list)
    for r in rows:
        filled[r.container_kind, r.container_id] += r.n_tokens
        of[r.container_kind, r.doc_id].append((r.piece, r.start_token, r.n_tokens))
    assert all(n <= sizes[k] for (k, _), n in filled.items())
    for kind, capacity in sizes.items():
        for doc, text in texts.items():
            n, found = containers.n_tokens(text), sorted(of[kind, doc])
            assert [p for p, _, _ in found] == list(range(max(1, -(-n // capacity))))
            assert [(s, x) for _, s, x in found] == containers.pieces(n, capacity) and sum(x for _, _, x in found) == n


def test_containers_are_full_and_no_document_is_split_that_fits(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sizes = spark.read.parquet("/root/testdata/sf0.1/container_sizes.parquet")
    capacity = {r.container_kind: r.capacity_tokens for r in sizes.collect()}
    rows = containers.packed(documents, sizes).toPandas()
    filled = rows.groupby(["container_kind", "container_id"])["n_tokens"].sum().reset_index()
    whole = rows.groupby(["container_kind", "doc_id"]).agg(n=("n_tokens", "sum"), pieces=("piece", "count")).reset_index()
    assert len(whole) == 3 * documents.count()
    for kind, most in capacity.items():
        own = filled[filled.container_kind == kind]["n_tokens"]
        print(kind, f"fill {own.sum() / (most * len(own)):.4f}")
        assert own.max() <= most and own.sum() / (most * len(own)) >= 0.97
        of = whole[whole.container_kind == kind]
        assert (of.pieces == (-(-of.n // most)).clip(lower=1)).all()


def test_odd_kinds_and_empty_tables(spark):
    documents = spark.createDataFrame([(1, "one two", "x"), (1, "one two", "x")], "doc_id bigint, text string, container_kind string")
    sizes = spark.createDataFrame([("a", 8), ("a", 4), (None, 5), ("b", None), ("c", 0), ("d", -1)], "container_kind string, capacity_tokens int")
    rows = containers.packed(documents, sizes).collect()
    assert [(r.container_kind, r.doc_id, r.n_tokens) for r in rows] == [("a", 1, 2)] * 2
    assert containers.packed(documents.limit(0), sizes).count() == 0 == containers.packed(documents, sizes.limit(0)).count()
    many = spark.createDataFrame([(f"k{i}", 10 + i) for i in range(7)], "container_kind string, capacity_tokens int")
    assert containers.packed(documents, many, block=2).select("container_kind").distinct().count() == 7
