"""Positions in the FM-index and the spans of leaks."""

from __future__ import annotations

import numpy as np

from siftbed.llm import leaks


def test_locate_gives_the_position_of_every_suffix():
    rng = np.random.default_rng(7)
    sequences = [[5, 0, 3, 0]] + [[x for _ in range(40) for x in [*rng.integers(1, 9, rng.integers(3, 7)), 0]] for _ in range(20)]
    for sequence in map(np.array, sequences):
        n = len(sequence)
        index = leaks.FMIndex(sequence, 9)
        # Bounded steps back from every row, as a wrong mapping can go round for ever.
        rows = np.arange(n)
        c = index.symbol(rows)
        step = index.starts[c] + index.rank(c, rows)
        assert sorted(step.tolist()) == list(range(n))
        at, seen = 0, []
        for _ in range(n):
            seen.append(at)
            at = int(step[at])
        assert len(set(seen)) == n
        assert sorted(index.locate(rows).tolist()) == list(range(n))
        assert index.locate(rows).tolist() == leaks._suffix_array(np.append(sequence[:-1] + 1, 0)).tolist()
        # All occurrences of a phrase, against a plain search.
        for phrase in {tuple(sequence[k : k + 2].tolist()) for k in range(n - 1)}:
            if 0 not in phrase:
                low, high = index.search(np.array([phrase]))
                plain = [k for k in range(n - 1) if tuple(sequence[k : k + 2].tolist()) == phrase]
                assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == plain


def test_hits_are_credited_to_the_document_that_holds_them():
    items = [(1, " ".join(f"w{k:02d}" for k in range(30)))]
    wanted = leaks.phrases(items)
    ids = {w: k for w, k in wanted.vocabulary.items()}
    rng = np.random.default_rng(3)
    words = sorted(ids, reverse=True)
    noise = [(f"n{d}", [x for _ in range(20) for x in [*(words[k] for k in rng.integers(0, 30, 4)), "other"]]) for d in range(20)]
    texts = noise + [("leak", ["other", *items[0][1].split(), "other"])]
    shard = [(d, np.array([ids.get(w, 0) for w in t], dtype=np.int64)) for d, t in texts]
    found = [(d, item, [p for p, _ in path]) for d, item, path in leaks._matches(shard, wanted)]
    assert [(d, item) for d, item, _ in found] == [("leak", 1)]
    assert found[0][2] == list(range(1, 31))


def _document_words(text: list[str], passage: list[str]) -> list[int]:
    wanted = leaks.phrases([(1, " ".join(passage))])
    shard = [("d", np.array([wanted.vocabulary.get(w, 0) for w in text], dtype=np.int64))]
    return sorted({a for _, _, path in leaks._matches(shard, wanted) for a, _ in path})


def test_every_copy_of_a_passage_is_removed():
    passage, between = [f"w{k:02d}" for k in range(24)], [f"x{k}" for k in range(20)]
    assert _document_words([*passage, *between, *passage], passage) == [*range(24), *range(44, 68)]
    assert _document_words(passage * 3, passage) == list(range(72))
    # Copies with a word changed at different places, of which one chain would take parts.
    changed = passage.copy()
    changed[12] = "changed"
    assert _document_words([*passage, *between, *changed], passage) == [*range(24), *(44 + k for k in range(24) if k != 12)]


def test_parts_in_reversed_order_are_removed():
    passage, between = [f"w{k:02d}" for k in range(40)], [f"x{k}" for k in range(20)]
    assert _document_words([*passage[22:], *between, *passage[:22]], passage) == [*range(18), *range(38, 60)]
    assert _document_words([*between, *passage[:10], *between], passage) == []


def test_rules_of_lines_take_no_time():
    assert leaks.words("+" + "-" * 60 + "\n| > 1. one\n  - b) two") == ["one", "two"]


def _found(text: str, items: list[tuple[int, str]]) -> dict[int, list[int]]:
    wanted = leaks.phrases(items)
    ids = np.array([wanted.vocabulary.get(w, 0) for w in leaks.words(text)], dtype=np.int64)
    return {item: sorted({a for a, _ in path}) for _, item, path in leaks._matches([("d", ids)], wanted)}


def test_passages_are_found_however_many_share_their_phrases():
    shared = " ".join(f"w{k}" for k in range(24))
    own = [" ".join(f"v{i}x{k}" for k in range(i % 7 + 5)) for i in range(60)]
    items = [(i, [shared, f"{shared} {own[i]}", f"{own[i]} {shared}"][i % 3]) for i in range(60)]
    assert _found(f"before {shared} after", items) == {i: list(range(1, 25)) for i in range(60)}
    # A word in one of them that the others don't have.
    assert set(_found(f"before {shared} {own[1]} after", items)) == set(range(60))
    assert _found("before " + " ".join(shared.split()[:9]) + " after", items) == {}


def test_passages_of_one_phrase_are_found():
    assert _found("before " + "la " * 20 + "after", [(1, "la " * 20), (2, "la " * 40), (3, "la " * 9)]) == {1: list(range(1, 21)), 2: list(range(1, 21))}
    assert _found("before " + "la " * 9 + "after", [(1, "la " * 20)]) == {}


def test_what_is_left_out_before_the_comparison_is_no_leak(monkeypatch):
    """Against the comparison of every passage with all hits, in texts of few words that most passages share."""
    rng = np.random.default_rng(8)
    number = 0
    for words, at_once in ((3, 1), (8, 100), (12, 1 << 20), (20, 1 << 20), (20, 1)) * 4:
        monkeypatch.setattr(leaks, "AT_ONCE", at_once)
        said = [f"w{k}" for k in range(words)]
        passages = [[said[k] for k in rng.integers(0, words, rng.integers(0, 40))] for _ in range(40)]
        passages += [[*p[:12], *q[:12]] for p, q in zip(passages[:20], passages[20:])]
        pieces = [p[k : k + 14] for p, k in zip(passages, rng.integers(0, 9, 60))]
        text = [w for k in rng.permutation(60)[:25] for w in [*pieces[k], *(said[j] for j in rng.integers(0, words, 4)), *["other"] * int(rng.integers(0, 12))]]
        wanted = leaks.phrases([(i, " ".join(p)) for i, p in enumerate(passages)])
        phrase = {tuple(p): k for k, p in enumerate(wanted.symbols.tolist())}
        ids = [wanted.vocabulary.get(w, 0) for w in text]
        hits = [(a, phrase[t]) for a in range(len(ids)) if (t := tuple(ids[a : a + leaks.SEED])) in phrase]
        plain = {}
        for i, p in enumerate(passages):
            places = [(a, b) for a in range(len(text) - 2) for b in range(len(p) - 2) if text[a : a + 3] == p[b : b + 3]]
            at, word = np.array(sorted({(a + j, b + j) for a, b in places for j in range(3)}), dtype=np.int64).reshape(-1, 2).T
            inside = leaks.stretches(at, word)
            if leaks.chain(at[inside], word[inside]) >= leaks.ENOUGH:
                plain[i] = set(at[inside].tolist()), set(word[inside].tolist())
        assert {i: ({a for a, _ in path}, {b for _, b in path}) for i, path in leaks.repeated(hits, wanted)} == plain
        number += len(plain)
    assert number > 100


def test_stretches_and_chains_of_repeated_words(monkeypatch):
    rng = np.random.default_rng(9)
    for share in (0.02, 0.1, 0.4, 0.9, 1) * 4:
        at, word = np.nonzero(rng.random((60, 50)) < share)
        at = at + 30 * (at > 40)
        results = []
        for wide in (True, False):
            monkeypatch.setattr(leaks, "_wide", lambda _, wide=wide: wide)
            inside = leaks.stretches(at, word)
            results.append((inside.tolist(), leaks._until(at, word).tolist(), leaks.chain(at, word), leaks.chain(at[inside], word[inside]) if inside.any() else 0))
        assert results[0] == results[1]
        pairs, plain = list(zip(at.tolist(), word.tolist())), {}
        for a, b in pairs:
            plain[a, b] = 1 + max((plain.get((x, y), 0) for x in range(a - 8, a) for y in range(b - 8, b)), default=0)
        assert results[0][1] == list(plain.values())


def test_halves_apart_are_found_but_not_phrases_of_different_places():
    passage, between = [f"w{k}" for k in range(60)], [f"x{k}" for k in range(50)]
    items = [(1, " ".join(passage))]
    assert _found(" ".join([*passage[10:20], *between, *passage[20:30]]), items) == {1: [*range(10), *range(60, 70)]}
    assert _found(" ".join([*passage[2:10], *between, *passage[40:48]]), items) == {}


def _vocabulary() -> tuple[list[str], list[tuple[int, str]]]:
    import pyarrow.parquet as pq

    items = pq.read_table("/root/testdata/sf0.01/eval_items.parquet").to_pydict()
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_pydict()["text"]
    return [w for t in texts[:300] for w in leaks.words(t)], list(zip(items["item_id"], items["text"]))


def test_recall_of_planted_stretches():
    """Stretches of 20 to 40 words with about one in eight changed, left out or added, between words of the corpus."""
    corpus, items = _vocabulary()
    wanted = leaks.phrases(items)
    rng = np.random.default_rng(5)
    found = trials = wrong = 0
    for item, text in items:
        passage = leaks.words(text)
        if len(passage) < 20:
            continue
        n = int(rng.integers(20, min(41, len(passage) + 1)))
        at = int(rng.integers(0, len(passage) - n + 1))
        stretch, last = [], -3
        for k, w in enumerate(passage[at : at + n]):
            kind = rng.integers(0, 24) if k - last > 2 else 9
            stretch += [["changed"], [], [w, "added"]][kind] if kind < 3 else [w]
            last = k if kind < 3 else last
        begin = int(rng.integers(0, len(corpus) - 200))
        document = [*corpus[begin : begin + 100], *stretch, *corpus[begin + 100 : begin + 200]]
        ids = np.array([wanted.vocabulary.get(w, 0) for w in document], dtype=np.int64)
        got = {i for _, i, _ in leaks._matches([("d", ids)], wanted)}
        trials, found, wrong = trials + 1, found + (item in got), wrong + len(got - {item})
    print(f"recall {found / trials:.3f} of {trials}, {wrong} other items")
    assert trials > 100 and found / trials >= 0.97


def test_long_documents_are_searched_in_pieces():
    corpus, items = _vocabulary()
    wanted = leaks.phrases(items)
    rng = np.random.default_rng(6)
    for item, text in items[:40]:
        begin = int(rng.integers(0, len(corpus) - 600))
        document = [*corpus[begin : begin + 300], *leaks.words(text), *corpus[begin + 300 : begin + 600]]
        ids = np.array([wanted.vocabulary.get(w, 0) for w in document], dtype=np.int64)
        whole = list(leaks._matches([("d", ids)], wanted))
        assert item in [i for _, i, _ in whole]
        for size in (7, 50, 1000):
            assert list(leaks._matches([("d", ids)], wanted, size)) == whole


def test_tables(spark):
    passage = " ".join(f"word{k}" for k in range(30))
    items = spark.createDataFrame([(1, f"Read this. {passage}"), (2, "Read this. " + " ".join(f"term{k}" for k in range(25))), (3, None), (4, "short"), (5, f"Read this. {passage}")], "item_id bigint, text string")
    text = "İntro\n- 1. " + passage.upper().replace("WORD7 ", "word7,\n> ") + " end"
    documents = spark.createDataFrame([(1, text, 9), (2, None, 9), (3, "", 9), (4, "Read this. nothing", 9), (1, text, 9)], "doc_id bigint, text string, item_id bigint")
    for block in (1, 20_000):
        rows = leaks.leaks(documents, items, block=block).collect()
        assert sorted((r.doc_id, r.item_id) for r in rows) == [(1, 1), (1, 1), (1, 5), (1, 5)]
        assert {(text[r.starts[0] : r.ends[-1]], r.n_words) for r in rows} == {(text[text.index("WORD0") : -4], 30)}
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks.leaks(documents, empty).count() == 0 == leaks.leaks(documents.limit(0), items).count()


def test_leaks_are_the_same_in_blocks_of_any_size(spark):
    passage = " ".join(f"word{k}" for k in range(30))
    items = spark.createDataFrame([(k, f"own{k} {passage} last{k}") for k in range(40)], "item_id bigint, text string")
    documents = spark.createDataFrame([(1, f"before {passage} after")], "doc_id bigint, text string")
    for block in (15, 20_000):
        rows = leaks.leaks(documents, items, block=block).collect()
        assert sorted((r.item_id, r.n_words, r.starts, r.ends) for r in rows) == [(k, 30, [7], [7 + len(passage)]) for k in range(40)]
