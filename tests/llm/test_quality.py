"""Kinds of texts by the nearest structural profile."""

from __future__ import annotations

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from siftbed.llm import quality

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labelled():
    texts = dict(zip(*(pq.read_table(f"{FOLDER}/documents.parquet").to_pydict()[c] for c in ("doc_id", "text"))))
    labels = pq.read_table(f"{FOLDER}/doc_labels.parquet").to_pydict()
    both = sorted({(d, x) for d, x in zip(labels["doc_id"], labels["label"]) if x})
    once = [d for d, _ in both]
    return [(x, texts[d]) for d, x in both if once.count(d) == 1]


def _accuracy(train, test) -> float:
    profiles, kinds = quality.fit_profiles(train)
    found = quality.assigned(np.array([quality.described(t)[0] for _, t in test]), profiles, kinds)[1]
    return sum(f == x for f, (x, _) in zip(found, test)) / len(test)


def test_held_out_accuracy(labelled):
    """About four in a hundred labels are wrong, in the held-out half too."""
    rows = labelled.copy()
    random.Random(1).shuffle(rows)
    half = len(rows) // 2
    result = [_accuracy(rows[:half], rows[half:]), _accuracy(rows[half:], rows[:half])]
    print("held-out accuracy", result)
    assert min(result) >= 0.93
    # Without any label the seeds alone decide.
    assert _accuracy([], rows) >= 0.6


def test_the_divergences_decide(labelled, monkeypatch):
    """Without the profiles' distributions of words, characters and lines the kinds are lost."""
    train, test = labelled[::2], labelled[1::2]
    whole = _accuracy(train, test)
    without = {k: (n, 0.0 if k in ("line_kinds", "cells", "line_starts", "line_ends", "line_words") else w) for k, (n, w) in quality.DISTRIBUTIONS.items()}
    monkeypatch.setattr(quality, "DISTRIBUTIONS", without)
    assert _accuracy(train, test) < whole
    monkeypatch.setattr(quality, "DISTRIBUTIONS", {k: (n, w if k in ("repeated", "broken") else 0.0) for k, (n, w) in without.items()})
    assert _accuracy(train, test) < 0.8


PROSE = [
    "Când am ajuns în sat era deja întuneric. Nu era nimeni în piață, dar o femeie ne-a deschis ușa și ne-a dat de mâncare.",
    "Da vi kom frem til landsbyen, var det allerede mørkt. Der var ingen på torvet, men en kvinde åbnede døren for os.",
    "Amikor a faluba értünk, már sötét volt. A téren nem volt senki, de egy asszony ajtót nyitott nekünk.",
    "Коли ми прийшли до села, було вже темно. На площі нікого не було, але одна жінка відчинила нам двері.",
    "Il gatto dorme sul divano mentre fuori piove.", "Сегодня мы ходили в лес и собирали грибы.", "今天天气很好，我们一起去公园散步吧。",
    "De kat slaapt op de bank terwijl het buiten regent.",
]


@pytest.mark.parametrize("text", PROSE)
@pytest.mark.parametrize("fitted", [False, True])
def test_prose_of_any_language(labelled, text, fitted):
    profiles, kinds = quality.fit_profiles(labelled if fitted else [])
    assert quality.assigned(quality.described(text)[0][None, :], profiles, kinds)[1] == ["prose"]


def test_divergence():
    rng = np.random.default_rng(1)
    p, q = rng.dirichlet(np.ones(5), 3), rng.dirichlet(np.ones(5), 4)
    m = (p[:, None] + q[None]) / 2
    plain = ((p[:, None] * np.log2(p[:, None] / m)).sum(2) + (q[None] * np.log2(q[None] / m)).sum(2)) / 2
    assert np.allclose(quality.divergences(p, q), plain)
    assert quality.divergence(p[0], p[0]) == pytest.approx(0, abs=1e-9) and quality.divergence(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1, abs=1e-6)


def test_tables(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, "a" * 200_000, "x"), (5, "One calm day followed another, and nobody asked why.", "x"), (5, "One calm day followed another, and nobody asked why.", "x"), (6, "퟿\x00\x01", "x")]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, kind string")
    labels = spark.createDataFrame([(5, "prose"), (5, "table"), (5, None), (4, "odd"), (99, "list")], "doc_id bigint, label string")
    for given in (labels, labels.limit(0), None):
        got = quality.text_statistics(documents, given).collect()
        assert len(got) == len(rows)
        kinds = {r.doc_id: r.kind for r in got}
        assert kinds[1] == kinds[2] == kinds[3] == kinds[4] == "junk" and kinds[5] == "prose"
        assert {r.n_words for r in got if r.doc_id == 5} == {9}
    assert quality.text_statistics(documents.limit(0), labels).count() == 0
