"""Files of any kind as rows: a manifest of paths, and readers that keep dotfiles, broken bytes and long files in hand.

Spark's own file listing passes over names that begin with a dot or an underscore without a word, and the histories of
tools have such names. So a manifest of paths (name, size, time) is built by walking directories in the executors, and
the files are read from it in Arrow batches. All executors must see the paths; for object stores `stored_texts` uses
Spark's listing instead.
"""

from __future__ import annotations

import fnmatch
import os
import re
import sqlite3
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftbed.functions import secrets as S

MANIFEST = "source_file string, size bigint, modified timestamp"

# Extensions that a scan of a tree reads, beside files without one.
SCANNED_EXTENSIONS = [
    ".json", ".jsonl", ".txt", ".md", ".log", ".env", ".cfg", ".ini", ".yaml", ".yml", ".toml", ".conf", ".sh", ".bash", ".zsh",
    ".py", ".js", ".ts", ".rb", ".go", ".rs", ".java", ".kt", ".swift", ".c", ".cpp", ".h", ".hpp", ".cs", ".php", ".pl",
    ".r", ".sql", ".xml", ".html", ".css", ".scss", ".dockerfile", ".tf", ".hcl", ".gradle", ".properties",
]
# Directories that a scan of a tree doesn't enter, beside hidden ones.
PRUNED_DIRECTORIES = ["node_modules", "__pycache__", "venv", ".git", "target", "build"]


def _listed(path: str) -> tuple | None:
    try:
        stat = os.stat(path)
    except OSError:
        return None
    return path, stat.st_size, datetime.fromtimestamp(stat.st_mtime, tz=timezone.utc)


def _walked(root: str, pattern: str, prune: bool, recursive: bool) -> Iterator[str]:
    for folder, folders, files in os.walk(root):
        if not recursive:
            folders[:] = []
        elif prune:
            folders[:] = [d for d in folders if not d.startswith(".") and d not in PRUNED_DIRECTORIES]
        yield from (os.path.join(folder, f) for f in files if fnmatch.fnmatchcase(f, pattern))


def manifest(spark: SparkSession, roots: list[str], pattern: str = "*", prune: bool = False, recursive: bool = True) -> DataFrame:
    """The files under `roots` whose name fits `pattern`: each first-level directory is walked by a task of its own.

    Broken links and unreadable files have no row; a root that is missing or empty gives none.
    """
    tops, files = [], []
    for root in roots:
        if os.path.isfile(root):
            files.append(root)
            continue
        for entry in sorted(os.scandir(root), key=lambda e: e.name) if os.path.isdir(root) else []:
            if entry.is_dir() and not (prune and (entry.name.startswith(".") or entry.name in PRUNED_DIRECTORIES)):
                tops += [entry.path] if recursive else []
            elif entry.is_file() and fnmatch.fnmatchcase(entry.name, pattern):
                files.append(entry.path)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                paths = _walked(top, pattern, prune, True) if whole else [top]
                rows = [row for row in map(_listed, paths) if row]
                columns = list(zip(*rows)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.timestamp("us", "UTC"))], names=["source_file", "size", "modified"])

    starts = [(t, True) for t in tops] + [(f, False) for f in files]
    frame = spark.createDataFrame(starts, "path string, whole boolean")
    return frame.repartition(max(1, min(len(starts), 512))).mapInArrow(walk, MANIFEST)


def _decoded(raw: bytes, newlines: bool = True) -> str:
    """Bytes as UTF-8 with U+FFFD for broken ones; line ends are brought to one character."""
    text = raw.decode("utf-8", errors="replace")
    return text.replace("\r\n", "\n").replace("\r", "\n") if newlines else text


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


_STAMP = pa.timestamp("us", "UTC")


def whole_texts(files: DataFrame, most: int | None = None, newlines: bool = True, binary: bool = False) -> DataFrame:
    """One row per file with its `content`: the first `most` characters (of a binary file, bytes); unreadable files have none.

    `most` bounds what one row holds; the default reads all of a file.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, modified in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with open(path, "rb") as f:
                        raw = f.read(-1 if most is None else most if binary else most * 4)
                except OSError:
                    continue
                text = _decoded(raw, newlines)
                yield _batch([(path, modified, text if binary or most is None else text[:most])], ["source_file", "modified", "content"], [pa.string(), _STAMP, pa.string()])

    return files.select("source_file", "modified").mapInArrow(read, "source_file string, modified timestamp, content string")


def lines(files: DataFrame) -> DataFrame:
    """One row per line that isn't blank, with its number from 0 as `seq`; a file is read as a stream."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["source_file", "modified", "seq", "content"], [pa.string(), _STAMP, pa.int64(), pa.string()]
        for batch in batches:
            for path, modified in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size = [], 0
                try:
                    with open(path, encoding="utf-8", errors="replace") as f:
                        for seq, line in enumerate(f):
                            if line.strip():
                                rows.append((path, modified, seq, line.strip()))
                                size += len(line)
                            if size > 1 << 22:
                                yield _batch(rows, names, types)
                                rows, size = [], 0
                except OSError:
                    pass
                if rows:
                    yield _batch(rows, names, types)

    return files.select("source_file", "modified").mapInArrow(read, "source_file string, modified timestamp, seq bigint, content string")


def sqlite_logs(spark: SparkSession, databases: list[str], newest: int = 5000) -> DataFrame:
    """The newest messages longer than 20 characters of the first database of the list that exists.

    Filter, order and limit run inside SQLite. A missing or broken database gives no row.
    """
    found = [d for d in databases if os.path.isfile(d)][:1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = "SELECT message, ts FROM logs WHERE message IS NOT NULL AND length(message) > 20 ORDER BY ts DESC LIMIT ?"
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as connection:
                        rows = connection.execute(query, (newest,)).fetchall()
                except sqlite3.Error:
                    continue
                stamps = [datetime.fromtimestamp(ts, tz=timezone.utc) if ts else None for _, ts in rows]
                if rows:
                    columns = [(path, i, str(m), t) for i, ((m, _), t) in enumerate(zip(rows, stamps))]
                    yield _batch(columns, ["source_file", "seq", "text", "ts"], [pa.string(), pa.int64(), pa.string(), _STAMP])

    schema = "source_file string, seq bigint, text string, ts timestamp"
    return spark.createDataFrame([(d,) for d in found], "path string").mapInArrow(read, schema)


def stored_texts(spark: SparkSession, root: str, most: int | None = None) -> DataFrame:
    """Files under a URI of any storage Spark reads, by Spark's parallel listing; names that begin with `.` or `_` are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    content = F.col("content") if most is None else F.substring("content", 1, most * 4)
    text = F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")
    return raw.select(F.col("path").alias("source_file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), (text if most is None else F.substring(text, 1, most)).alias("content"))


def extension(path: Column) -> Column:
    """The lower-case extension with its dot; empty for names without one and for dotfiles."""
    return F.lower(F.regexp_extract(path, r"[^/\\](\.[^./\\]+)$", 1))


def is_scanned(path: Column) -> Column:
    """Whether a scan of a tree reads a file: by extension, or without one."""
    return extension(path).isin([*SCANNED_EXTENSIONS, ""])


def is_pruned(path: Column, root: str = "") -> Column:
    """Whether a directory of the path (below `root`) is hidden or one that holds no text of people."""
    names = "|".join(re.escape(d) for d in PRUNED_DIRECTORIES)
    below = F.replace(path, F.lit(root), F.lit("")) if root else path
    return below.rlike(rf"(^|[/\\])(\.[^/\\]+|{names})[/\\]")


def has_keyword(content: Column, words: list[str]) -> Column:
    """Whether one of the words occurs in any case: the gate before a file is parsed."""
    return S.has_keyword(content, F.array(*[F.lit(w) for w in words]))


def exists(path: str | Path) -> bool:
    return os.path.exists(path)
