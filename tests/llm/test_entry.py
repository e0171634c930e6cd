"""The registry of queries."""

from __future__ import annotations

import importlib
import sys

import pytest

import __spark_entry__


def test_an_import_error_of_the_text_problems_shows(monkeypatch):
    import siftbed.llm

    monkeypatch.delattr(siftbed.llm, "queries", raising=False)
    monkeypatch.setitem(sys.modules, "siftbed.llm.queries", None)
    with pytest.raises(ImportError):
        importlib.reload(__spark_entry__)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
    assert {name[:2] for name in __spark_entry__.queries()} >= {f"p{n}" for n in range(1, 9)}
