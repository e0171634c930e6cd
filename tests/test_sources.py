"""Sources of all tools in a home directory made here, trees, reports and the command line."""

from __future__ import annotations

import json
import os
import random
import sqlite3
from datetime import datetime, timedelta, timezone

import pytest

from siftbed import scan
from siftbed.operators import reports
from siftbed.sources import files, tools

NOW = datetime(2026, 1, 31, 12, tzinfo=timezone.utc)
OLD = NOW - timedelta(days=40)
KEY = "AKIA" + "".join(random.Random(5).choices("QWRTYPSDGHJKLZXCVBNM", k=16))


def ms(at):
    return int(at.timestamp() * 1000)


@pytest.fixture(scope="module")
def home(tmp_path_factory):
    root = tmp_path_factory.mktemp("home")

    def put(path, content, at=NOW):
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content if isinstance(content, bytes) else content.encode())
        os.utime(target, (at.timestamp(), at.timestamp()))

    lines = [
        {"timestamp": ms(NOW), "display": f"use {KEY} please", "sessionId": "s1"}, {"timestamp": ms(OLD), "display": "too old"},
        {"display": "no time at all"}, {"timestamp": "not a number", "display": "text as time"}, {"display": ""}, {"display": 5},
    ]
    put(".claude/history.jsonl", "\n".join(map(json.dumps, lines)) + "\n\n{broken\n[1]\n")
    blocks = [{"text": "block text"}, {"text": ""}, {"input": {"a": "long enough input", "b": "short", "c": {"d": "nested is not read"}}}, "bare"]
    projects = [
        {"timestamp": NOW.isoformat(), "sessionId": "s1", "message": {"role": "user", "content": "plain"}},
        {"timestamp": ms(NOW), "message": {"role": "assistant", "content": blocks}}, {"content": "twenty characters and more", "timestamp": NOW.isoformat().replace("+00:00", "Z")}, {"timestamp": OLD.isoformat(), "message": {"content": "old"}},
    ]
    put(".claude/projects/p/a.jsonl", "\n".join(map(json.dumps, projects)))
    nested = {"message": "top level message", "a": {"b": {"c": {"d": "is at depth four", "e": {"f": "is at depth five"}}}}, "short": "0123456789", "list": ["eleven char"] * 501}
    put(".cursor/x/chat.json", json.dumps(nested))
    put(".cursor/x/other.json", '{"unrelated": "nothing of that here at all"}')
    put(".cursor/broken.json", "{chat broken")
    put(".continue/sessions/s.json", json.dumps({"history": [{"content": "first turn", "role": "user"}, {"text": "second turn"}, {"content": ""}], "messages": [{"content": "not read"}]}))
    put(".continue/dev.log", "a log\r\nof two lines")
    put(".config/github-copilot/c.json", "not json at all")
    put(".codeium/w.json", '["a windsurf text"]')
    put(".windsurf/bad.json", "not json at all")
    put(".aider.chat.history.md", "# aider chat started\nhello\n# aider chat again\n")
    put(".aider/n.md", "notes")
    codex = [
        {"type": "response_item", "payload": {"role": "user", "content": [{"text": "six ch"}, {"text": "five5"}]}}, {"type": "event_msg", "payload": {"message": "an event"}},
        {"type": "tool_call", "payload": {"input": {"cmd": "a long command", "n": 1}, "arguments": "long arguments"}}, {"type": "other", "payload": {"message": "not read"}},
    ]
    put(".codex/sessions/d/s.jsonl", "\n".join(map(json.dumps, codex)))
    (root / ".codex").mkdir(exist_ok=True)
    with sqlite3.connect(root / ".codex/state_4.sqlite") as db:
        db.execute("CREATE TABLE logs (message TEXT, ts INTEGER)")
        db.executemany("INSERT INTO logs VALUES (?, ?)", [("m" * 21, int(NOW.timestamp())), ("m" * 20, int(NOW.timestamp())), ("o" * 30, int(OLD.timestamp())), ("n" * 25, None)])
    put(".kiro/index.json", json.dumps([{"sessionId": "a"}, {"sessionId": "b"}]))
    put(".kiro/s.json", json.dumps({"history": [{"message": {"role": "user", "content": "text"}}, {"message": {"role": "assistant", "content": [{"text": "block1"}, "bare12", "tiny"]}}]}))
    put(".config/Claude/Local Storage/leveldb/1.log", b"\xff\xfe" + b"leveldb bytes of some length\r\n")
    put(".config/Claude/Session Storage/2.ldb", b"short")
    put(".config/Claude/config.json", '{"a": 1}', OLD)
    put(".roo/t.json", '{"task": "a task of some length"}')
    put(".roo/n.md", "a note of more than twenty characters")
    put(".gemini/l.jsonl", '{"a": "line text long"}\n{"a": {"b": {"c": {"d": "depth four text"}}}}\n')
    put(".gemini/f.json", '{"a": {"b": {"c": {"d": "depth four text"}}}}')
    put(".aws/amazonq/q.json", "plain text of more than twenty")
    put(".aws/amazonq/q.jsonl", '{"a": "an amazon q text"}')
    put(".zsh_history", "old history", OLD)
    put(".bash_history", f"export K={KEY}")
    put(".bashrc", "old settings stay", OLD)
    put(".env", f"A={KEY}\r\nB=2", OLD)
    return root


@pytest.fixture(scope="module")
def scanned(spark, home):
    scope = tools.Scope(spark, str(home), 30, NOW)
    sources = tools.collect_sources(scope)
    return tools.source_table(spark, sources).collect(), tools.message_table(spark, sources).collect()


TEXTS = {
    "claude": ["block text", "long enough input", "no time at all", "plain", "text as time", "twenty characters and more", f"use {KEY} please"],
    "cursor": ["eleven char"] * 500 + ["is at depth four", "top level message", "{chat broken"],
    "continue": ["a log\nof two lines", "first turn", "second turn"],
    "copilot": ["not json at all"],
    "windsurf": ["a windsurf text"],
    "aider": ["# aider chat started\nhello\n# aider chat again\n", "notes"],
    "codex": ["a long command", "an event", "long arguments", "m" * 21, "n" * 25, "six ch"],
    "kiro": ["bare12", "block1", "text"],
    "claude-desktop": ["{\"a\": 1}", "\ufffd\ufffdleveldb bytes of some length\r\n"],
    "roo": ["a note of more than twenty characters", "a task of some length"],
    "gemini-cli": ["depth four text", "line text long"],
    "amazon-q": ["an amazon q text", "plain text of more than twenty"],
    "shell": [f"export K={KEY}", "old settings stay"],
    "env": [f"A={KEY}\nB=2"],
}


@pytest.mark.parametrize("tool", TEXTS)
def test_messages_of_each_tool(scanned, tool):
    assert sorted(r.text for r in scanned[1] if r.source_key == tool) == sorted(TEXTS[tool])


def test_ids_are_unique(scanned):
    assert len({r.message_id for r in scanned[1]}) == len(scanned[1])


def test_counts_of_conversations(scanned):
    counts = {r.source_key: (r.found, r.conversation_count, r.message_count) for r in scanned[0]}
    assert list(counts) == list(tools.TOOLS)
    assert counts["aider"] == (True, 3, 2) and counts["cursor"] == (True, 50, 503) and counts["roo"] == (True, 1, 2)
    assert counts["codex"] == (True, 1, 6) and counts["gemini-cli"] == (True, 1, 2) and counts["shell"] == (True, 2, 2)


def test_a_home_without_tools(spark, tmp_path):
    sources = tools.collect_sources(tools.Scope(spark, str(tmp_path), 30, NOW))
    assert not any(s.found for s in sources)
    assert tools.message_table(spark, sources).count() == 0
    assert {(r.found, r.message_count, r.conversation_count) for r in tools.source_table(spark, sources).collect()} == {(False, 0, 0)}


def test_trees_and_files(spark, tmp_path):
    for name in ("a.py", "b.bin", "noext", ".env", "sub/c.MD", ".hidden/d.py", "node_modules/e.py", "sub/build/f.py", "_g.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "broken").symlink_to(tmp_path / "missing")
    scope = tools.Scope(spark, str(tmp_path), 0)
    tree = tools.tree(scope, str(tmp_path))
    assert sorted(r.text for r in tree.messages.collect()) == sorted(["a.py", "noext", ".env", "sub/c.MD", "_g.txt"])
    assert sorted(r.text for r in tools.tree(scope, str(tmp_path), most_files=2).messages.collect()) == [".env", "_g.txt"]
    assert [r.text for r in tools.tree(scope, str(tmp_path / "b.bin")).messages.collect()] == ["b.bin"]
    assert sorted(r.text for r in tools.tree(scope, f"file://{tmp_path}").messages.collect()) == ["a.py", "noext", "sub/c.MD"]
    missing = tools.tree(scope, str(tmp_path / "none"))
    assert not missing.found and missing.error


def test_long_files_are_cut_by_characters(spark, tmp_path):
    (tmp_path / "x.txt").write_text("é" * 100)
    row = files.whole_texts(files.manifest(spark, [str(tmp_path)]), 30).first()
    assert row.content == "é" * 30


def test_the_command_line(spark, home, capsys):
    argv = ["--home", str(home), "--days", "0", "--tool", "env", "--tool", "shell"]
    assert scan.main([*argv, "--json"], spark) == 1
    report = json.loads(capsys.readouterr().out)
    assert report["total_secrets"] == 2 and [s["secrets_found"] for s in report["sources"]] == [1, 1]
    assert report["by_severity"] == {"critical": 2} and report["scan_period_days"] == 0
    assert KEY not in json.dumps(report) and set(report["sources"][0]["findings"][0]) == set(reports.REPORTED)
    assert scan.main([*argv, "--verbose"], spark) == 1
    out = capsys.readouterr().out
    assert "2 secrets" in out and "[critical] AWS Access Key ID" in out and KEY not in out
    assert scan.main(["--home", str(home), "--tool", "windsurf"], spark) == 0
    assert scan.main(["--path", str(home / "none")], spark) == 0
    with pytest.raises(SystemExit):
        scan.main(["--tool", "unknown"], spark)


def test_scan_of_one_text(spark):
    rows = scan.scan_text(spark, f"a\n{KEY}", source_file="f", source_tool="t").collect()
    assert [(r.pattern_id, r.line_number, r.source_file, r.source_tool) for r in rows] == [("aws_access_key_id", 2, "f", "t")]


def test_numbering_and_reports(spark):
    rows = spark.createDataFrame([(i, ["a", "b", None][i % 3]) for i in range(200)], "i int, g string")
    got = {(r.g, r.i): r.n for r in reports.numbered(rows, "g", "i", name="n").collect()}
    assert got == {(["a", "b", None][i % 3], i): i // 3 + 1 for i in range(200)}
    empty = spark.createDataFrame([], "severity string, category string, pattern_name string")
    assert reports.summary(empty)["total_secrets"] == 0
