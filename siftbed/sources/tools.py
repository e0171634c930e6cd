"""The chat histories of fourteen tools and of any file or tree, as one table of messages and one of sources.

Each tool is a function of the home directory that plans a DataFrame; nothing is read before an action. A tool without
its directory isn't found. A bad record or file is left out, and one tool's error doesn't touch the others. All times
are UTC, and the look-back takes its end as a parameter, so that results repeat.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftbed.functions import secrets as S
from siftbed.sources import files, layouts

MESSAGES = ["source_key", "source_tool", "source_file", "conversation_id", "ts", "role", "seq", "part", "text"]
_SCHEMA = "source_key string, source_tool string, source_file string, conversation_id string, ts timestamp, role string, seq bigint, part int, text string"

#: Sizes: files of tools and of trees that are skipped, and characters that are read at most, as the tools' formats need.
TOOL_FILE, TREE_FILE, TREE_FILES = 50_000_000, 10_000_000, 10_000
JSON_CHARS, LOG_CHARS, HISTORY_CHARS, ENV_CHARS = 5_000_000, 2_000_000, 10_000_000, 1_000_000

# Words of which a file must have one to hold a chat.
CURSOR_WORDS = ["message", "prompt", "completion", "chat", "conversation"]
ROO_WORDS = ["message", "prompt", "content", "task", "conversation"]


@dataclass(frozen=True)
class Scope:
    """What a scan covers: the home directory, the days of look-back (0 is all) and the instant it looks back from."""

    spark: SparkSession
    home: str
    days: int = 30
    as_of: datetime | None = None
    linux: bool = True

    @property
    def now(self) -> Column:
        return F.current_timestamp() if self.as_of is None else F.lit(self.as_of)

    def recent(self, at: str = "modified") -> Column:
        return S.within_days(F.col(at), self.days, self.now)

    def bases(self, *paths: str, mac: tuple[str, ...] = (), linux: tuple[str, ...] = ()) -> list[str]:
        """Those of a tool's directories that exist; one inside another is left out, so no file is read twice."""
        found = [os.path.join(self.home, p) for p in (*paths, *(linux if self.linux else mac))]
        found = [p for p in dict.fromkeys(found) if os.path.exists(p)]
        return [p for p in found if not any(p != q and p.startswith(q + os.sep) for q in found)]

    def manifest(self, roots: list[str], pattern: str, recursive: bool = True, recent: bool = True, most: int | None = None) -> DataFrame:
        found = files.manifest(self.spark, roots, pattern, recursive=recursive)
        found = found.where(F.col("size") <= most) if most else found
        return found.where(self.recent()) if recent else found


@dataclass
class Source:
    """A tool's header; `messages` is planned, not read. `estimate` counts conversations from messages where files don't say."""

    key: str
    name: str
    path: str
    found: bool = False
    messages: DataFrame | None = None
    conversations: Callable[[DataFrame], Column] | None = field(default=None, repr=False)
    error: str | None = None


def _named(df: DataFrame, key: str, name: str) -> DataFrame:
    """Columns of `MESSAGES`, missing ones null; messages take the time of their file where they have none."""
    have = set(df.columns)
    defaults = {"conversation_id": F.lit(None).cast("string"), "role": F.lit(None).cast("string"), "seq": F.lit(0).cast("bigint"), "part": F.lit(0), "ts": F.col("modified") if "modified" in have else F.lit(None).cast("timestamp")}
    df = df.withColumns({c: v for c, v in defaults.items() if c not in have})
    return df.select(F.lit(key).alias("source_key"), F.lit(name).alias("source_tool"), *MESSAGES[2:])


def _whole(df: DataFrame, least: int = -1) -> DataFrame:
    return df.withColumnRenamed("content", "text").where(F.char_length("text") > least)


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _each(n: int) -> Callable[[DataFrame], Column]:
    return lambda df: S.conversation_estimate(F.count("*"), n)


def _sessions(df: DataFrame) -> Column:
    return F.count_distinct("conversation_id")


def _per_file(df: DataFrame) -> Column:
    return F.count_distinct("source_file")


_KEPT = ("source_file", "modified", "seq")


def claude(s: Scope) -> Source:
    """A command history and project conversations in lines; the look-back is on each record's own time."""
    base = os.path.join(s.home, ".claude")
    found = os.path.isdir(base)
    history = files.lines(s.manifest([os.path.join(base, "history.jsonl")], "*", recent=False))
    projects = files.lines(s.manifest([os.path.join(base, "projects")], "*.jsonl", recent=False))
    rows = _union([
        layouts.display_messages(layouts.parsed(history), *_KEPT),
        layouts.project_messages(layouts.parsed(projects), *_KEPT),
    ]).where(s.recent("ts"))
    return Source("claude", "Claude Code", base, found, rows, _sessions)


def _json_tool(s: Scope, key: str, name: str, bases: list[str], default: str, fallback: int | None, estimate: int, words: list[str] | None = None) -> Source:
    texts = files.whole_texts(s.manifest(bases, "*.json", most=TOOL_FILE), JSON_CHARS)
    texts = texts.where(files.has_keyword(F.col("content"), words)) if words else texts
    rows = layouts.recursive_messages(layouts.parsed(texts), "source_file", "modified", fallback=fallback)
    return Source(key, name, bases[-1] if bases else default, bool(bases), rows, _each(estimate))


def cursor(s: Scope) -> Source:
    mac = ("Library/Application Support/Cursor", "Library/Application Support/Cursor/User/workspaceStorage")
    bases = s.bases(".cursor", ".cursor-tutor", mac=mac, linux=(".config/Cursor", ".config/Cursor/User/workspaceStorage"))
    return _json_tool(s, "cursor", "Cursor", bases, os.path.join(s.home, ".cursor"), -1, 10, CURSOR_WORDS)


def continue_dev(s: Scope) -> Source:
    """Session files and logs; a session file is a conversation, a log is none."""
    bases = s.bases(".continue", mac=("Library/Application Support/Continue",), linux=(".config/continue",))
    sessions = files.whole_texts(s.manifest([os.path.join(b, "sessions") for b in bases], "*.json"))
    turns = layouts.history_messages(layouts.parsed(sessions), "source_file", "modified").withColumn("conversation_id", F.col("source_file"))
    logs = _whole(files.whole_texts(s.manifest(bases, "*.log"), LOG_CHARS))
    return Source("continue", "Continue.dev", bases[-1] if bases else os.path.join(s.home, ".continue"), bool(bases), _union([turns, logs]), _sessions)


def copilot(s: Scope) -> Source:
    bases = s.bases(mac=("Library/Application Support/GitHub Copilot", "Library/Application Support/GitHub Copilot Chat"), linux=(".config/github-copilot",))
    extensions = os.path.join(s.home, ".vscode", "extensions")
    if os.path.isdir(extensions):
        bases += [e.path for e in sorted(os.scandir(extensions), key=lambda e: e.name) if "copilot" in e.name.lower()]
    return _json_tool(s, "copilot", "GitHub Copilot", bases, os.path.join(s.home, "Library/Application Support/GitHub Copilot"), -1, 5)


def windsurf(s: Scope) -> Source:
    bases = s.bases(".codeium", ".windsurf", mac=("Library/Application Support/Windsurf",))
    return _json_tool(s, "windsurf", "Windsurf", bases, os.path.join(s.home, ".windsurf"), None, 10)


def aider(s: Scope) -> Source:
    """One history in Markdown, whose sessions are marked, and a directory of such files."""
    history, folder = os.path.join(s.home, ".aider.chat.history.md"), os.path.join(s.home, ".aider")
    one = _whole(files.whole_texts(s.manifest([history], "*"), HISTORY_CHARS)).withColumn("weight", S.occurrences(F.col("text"), "# aider chat"))
    many = _whole(files.whole_texts(s.manifest([folder], "*.md"), JSON_CHARS)).withColumn("weight", F.lit(1))
    found = os.path.exists(history) or os.path.isdir(folder)
    return Source("aider", "Aider", folder, found, _union([one, many]), lambda df: F.coalesce(F.sum("weight"), F.lit(0)))


def codex(s: Scope) -> Source:
    """Session lines with a type, and the newest log entries of the first database that is there."""
    base = os.path.join(s.home, ".codex")
    sessions = files.lines(s.manifest([os.path.join(base, "sessions")], "*.jsonl"))
    rows = layouts.typed_messages(layouts.parsed(sessions), *_KEPT)
    logs = files.sqlite_logs(s.spark, [os.path.join(base, d) for d in ("state_5.sqlite", "state_4.sqlite", "state.sqlite")])
    logs = logs.where(s.recent("ts")).withColumn("role", F.lit("system"))
    return Source("codex", "Codex CLI", base, os.path.isdir(base), _union([rows.withColumn("ts", F.col("modified")), logs]), lambda df: F.least(F.count("part"), F.lit(1)))


def kiro(s: Scope) -> Source:
    bases = s.bases(".kiro", mac=("Library/Application Support/Kiro",), linux=(".config/Kiro",))
    sessions = files.whole_texts(s.manifest(bases, "*.json", most=TOOL_FILE))
    rows = layouts.session_messages(layouts.parsed(sessions), "source_file", "modified")
    return Source("kiro", "Kiro", bases[-1] if bases else os.path.join(s.home, ".kiro"), bool(bases), rows, _per_file)


def claude_desktop(s: Scope) -> Source:
    """Raw bytes of two key-value stores read as text, and a configuration file of any age."""
    bases = s.bases(mac=("Library/Application Support/Claude",), linux=(".config/Claude",))
    stores = [os.path.join(b, d) for b in bases for d in ("Local Storage/leveldb", "Session Storage")]
    parts = [_whole(files.whole_texts(s.manifest(stores, p, recursive=False), HISTORY_CHARS, newlines=False, binary=True), 20) for p in ("*.log", "*.ldb")]
    parts.append(_whole(files.whole_texts(s.manifest([os.path.join(b, "config.json") for b in bases], "*", recent=False), ENV_CHARS)))
    default = os.path.join(s.home, "Library/Application Support/Claude")
    return Source("claude-desktop", "Claude Desktop", bases[-1] if bases else default, bool(bases), _union(parts), _each(5))


def roo(s: Scope) -> Source:
    """Chat files in JSON and notes in Markdown; notes are conversations, else the messages are counted."""
    store = "Code/User/globalStorage/rooveterinaryinc.roo-cline"
    bases = s.bases(".roo", mac=(f"Library/Application Support/{store}",), linux=(f".config/{store}",))
    one = _json_tool(s, "roo", "Roo Code", bases, os.path.join(s.home, ".roo"), None, 10, ROO_WORDS)
    notes = _whole(files.whole_texts(s.manifest(bases, "*.md"), JSON_CHARS), 20).withColumn("conversation_id", F.col("source_file"))
    one.messages = _union([one.messages, notes])
    one.conversations = lambda df: F.when(F.count_distinct("conversation_id") > 0, F.count_distinct("conversation_id")).otherwise(S.conversation_estimate(F.count("*"), 10))
    return one


def gemini(s: Scope) -> Source:
    """Lines to depth 4 and files to depth 5; a file of lines is a conversation."""
    bases = s.bases(".gemini", mac=("Library/Application Support/gemini",), linux=(".config/gemini", ".local/share/gemini"))
    rows = layouts.recursive_messages(layouts.parsed(files.lines(s.manifest(bases, "*.jsonl"))), *_KEPT, max_depth=4).withColumn("conversation_id", F.col("source_file"))
    whole = files.whole_texts(s.manifest(bases, "*.json", most=TOOL_FILE))
    return Source("gemini-cli", "Gemini CLI", bases[-1] if bases else os.path.join(s.home, ".gemini"), bool(bases), _union([rows, layouts.recursive_messages(layouts.parsed(whole), "source_file", "modified")]), _sessions)


def amazon_q(s: Scope) -> Source:
    store = "Code/User/globalStorage/amazonwebservices.amazon-q-vscode"
    mac = ("Library/Application Support/amazon-q", "Library/Application Support/aws.amazon.q", f"Library/Application Support/{store}")
    bases = s.bases(".aws/amazonq", ".aws/codewhisperer", mac=mac, linux=(".config/amazon-q", f".config/{store}"))
    one = _json_tool(s, "amazon-q", "Amazon Q", bases, os.path.join(s.home, ".aws/amazonq"), 20, 10)
    rows = layouts.recursive_messages(layouts.parsed(files.lines(s.manifest(bases, "*.jsonl"))), *_KEPT, max_depth=4)
    one.messages = _union([one.messages, rows])
    return one


def shell(s: Scope) -> Source:
    """Histories within the look-back, and configuration files of any age; their names begin with a dot."""
    histories, settings = [".zsh_history", ".bash_history"], [".zshrc", ".bashrc", ".bash_profile", ".profile"]
    paths = [[os.path.join(s.home, n) for n in names] for names in (histories, settings)]
    listed = s.manifest(paths[0], "*").unionByName(s.manifest(paths[1], "*", recent=False))
    return Source("shell", "Shell History", s.home, any(map(os.path.exists, paths[0] + paths[1])), _whole(files.whole_texts(listed, HISTORY_CHARS)), _per_file)


def env(s: Scope) -> Source:
    paths = [os.path.join(s.home, n) for n in (".env", ".env.local", ".env.production", ".env.development")]
    rows = _whole(files.whole_texts(s.manifest(paths, "*", recent=False), ENV_CHARS))
    return Source("env", ".env Files", s.home, any(map(os.path.exists, paths)), rows, _per_file)


TOOLS: dict[str, Callable[[Scope], Source]] = {
    "claude": claude, "cursor": cursor, "continue": continue_dev, "copilot": copilot, "windsurf": windsurf, "aider": aider, "codex": codex,
    "kiro": kiro, "claude-desktop": claude_desktop, "roo": roo, "gemini-cli": gemini, "amazon-q": amazon_q, "shell": shell, "env": env,
}


def tree(s: Scope, path: str, most_files: int | None = TREE_FILES) -> Source:
    """Any file, or a tree: by extension, size and age, without hidden and generated directories, in the order of paths.

    `most_files` is the tool's limit on a tree; None reads all of it. A URI is listed by Spark.
    """
    name = f"Custom: {path}"
    if "://" in path:
        texts = files.stored_texts(s.spark, path, JSON_CHARS)
        kept = texts.where(files.is_scanned(F.col("source_file")) & ~files.is_pruned(F.col("source_file"), path) & (F.col("size") <= TREE_FILE) & s.recent())
        return Source("path", name, path, True, _whole(kept.drop("size")), _per_file)
    whole = os.path.realpath(os.path.expanduser(path))
    if not os.path.exists(whole):
        return Source("path", name, whole, error=f"Path does not exist: {path}")
    if os.path.isfile(whole):
        return Source("path", name, whole, True, _whole(files.whole_texts(s.manifest([whole], "*", recent=False), HISTORY_CHARS)), _per_file)
    listed = files.manifest(s.spark, [whole], prune=True).where(files.is_scanned(F.col("source_file")) & (F.col("size") <= TREE_FILE) & s.recent())
    listed = listed if most_files is None else listed.orderBy("source_file").limit(most_files)
    rows = _whole(files.whole_texts(listed, JSON_CHARS)).withColumn("ts", F.lit(None).cast("timestamp"))
    return Source("path", name, whole, True, rows, _per_file)


def collect_sources(s: Scope, tools: list[str] | None = None) -> list[Source]:
    """The headers of all or the chosen tools in their order; a tool that can't be planned is a source with its error."""
    out = []
    for key, plan in TOOLS.items():
        if tools and key not in tools:
            continue
        try:
            out.append(plan(s))
        except OSError as error:
            out.append(Source(key, key, ".", error=str(error)))
    return out


def message_table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """The messages of all found sources in one table, with an id from their place: source, file, line and part."""
    parts = [_named(s.messages, s.key, s.name) for s in sources if s.found and s.messages is not None]
    rows = functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], _SCHEMA)
    return rows.withColumn("message_id", F.md5(F.concat_ws("\x1f", "source_key", "source_file", "seq", "part")))


def source_table(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """One row per source with its counts; a source without messages has zeros."""
    out = []
    for place, s in enumerate(sources):
        header = {"place": F.lit(place), "source_key": F.lit(s.key), "name": F.lit(s.name), "path": F.lit(s.path), "found": F.lit(s.found), "error": F.lit(s.error).cast("string")}
        rows = s.messages if s.found and s.messages is not None else spark.createDataFrame([], "source_file string, conversation_id string, part int, weight int")
        rows = rows if "conversation_id" in rows.columns else rows.withColumn("conversation_id", F.lit(None).cast("string"))
        rows = rows if "part" in rows.columns else rows.withColumn("part", F.lit(0))
        count = s.conversations(rows) if s.found and s.conversations else F.lit(0)
        out.append(rows.agg(F.count("*").alias("message_count"), count.cast("bigint").alias("conversation_count")).select(*[v.alias(k) for k, v in header.items()], "conversation_count", "message_count"))
    schema = "place int, source_key string, name string, path string, found boolean, error string, conversation_count bigint, message_count bigint"
    return functools.reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], schema)
