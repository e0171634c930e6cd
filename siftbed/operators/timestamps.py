"""Mixed timestamp formats and time zones, brought to UTC instants.

Every value gets an array of all its valid interpretations: numeric dates in either order, epoch numbers by magnitude,
local times by the offset or abbreviation written, else by the source's zone, where a time shown twice by the clock has
two instants and a skipped one is moved over the gap. A Viterbi path over each source's records in reading order then
takes one interpretation per value; it pays for format switches, backward jumps, undeclared orders and skipped times.

The path is exact, and no source, block or run of equal positions is gathered in one task. An interpretation that costs
so much more than another that no neighbours make up for it is left out. Records with one interpretation cut the path:
what is before and after them doesn't depend on each other. So only the few ambiguous records and their neighbours are
sorted, by range over source and position, and a task decodes each run of ambiguous records between two cuts as it
streams by. Runs at the edges of a task's range report a small matrix, the cost of their best path between each of their
first and last interpretations; the matrices of a run that spans tasks, two a task at most, are chained, and the run's
pieces are then decoded between the ends found.
"""

from __future__ import annotations

import datetime
import functools
import itertools
import re
import zoneinfo
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from siftbed.session import small, spread, written

# The English month names in order.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

#: Costs of a path.
SWITCH, BACKWARD, OTHER_ORDER, SKIPPED, NO_ORDER = 1.0, 2.0, 40.0, 20.0, 3.0

# Shapes of a value. A zone part is an offset, an abbreviation or a zone name in brackets.
_CLOCK = r"(?P<hour>\d{1,2}):(?P<minute>\d{2}):(?P<second>\d{2})(?:[.,](?P<fraction>\d+))?\s*(?P<half>[AaPp][Mm])?"
_ZONE = r"\s*(?P<zone>Z|z|(?:UTC|GMT)?[+-]\d{1,2}:?(?:\d{2})?|[A-Z]{2,5}|\[[A-Za-z0-9_/+-]+\])?"
_NAME = r"(?P<name>[A-Za-z]{3,9})\.?"
_WEEKDAY = r"(?:[A-Za-z]{3,9},?\s+)?"
_SHAPES = {
    "iso": rf"(?P<year>\d{{4}})[-/](?P<a>\d{{1,2}})[-/](?P<b>\d{{1,2}})[Tt ]\s*{_CLOCK}{_ZONE}",
    "epoch": r"(?P<whole>-?\d{8,19})(?:\.(?P<fraction>\d+))?",
    "dmy": rf"(?P<a>\d{{1,2}})([/.-])(?P<b>\d{{1,2}})\2(?P<year>\d{{4}})[T,]?\s+{_CLOCK}{_ZONE}",
    "day_first": rf"{_WEEKDAY}(?P<b>\d{{1,2}})[ -]{_NAME}[ -](?P<year>\d{{4}}),?\s+{_CLOCK}{_ZONE}",
    "month_first": rf"{_WEEKDAY}{_NAME}\s+(?P<b>\d{{1,2}}),?\s+(?P<year>\d{{4}}),?\s+{_CLOCK}{_ZONE}",
    "compact": rf"(?P<year>\d{{4}})(?P<a>\d{{2}})(?P<b>\d{{2}})[Tt ](?P<hour>\d{{2}})(?P<minute>\d{{2}})(?P<second>\d{{2}})(?:[.,](?P<fraction>\d+))?(?P<half>){_ZONE}",
}
_SHAPES = {name: re.compile(shape, re.ASCII) for name, shape in _SHAPES.items()}
_OFFSET = re.compile(r"(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?", re.ASCII)

#: Number of a format: the state that the path pays to switch. A numeric date has the format of the order it is read in.
FORMATS = {name: number for number, name in enumerate(["epoch", "iso", "compact", "dmy", "mdy", "day_first", "month_first"])}

_EPOCH = datetime.datetime(1970, 1, 1)
_DAY = datetime.timedelta(days=1)
_MICROSECOND = datetime.timedelta(microseconds=1)


@functools.lru_cache(maxsize=1024)
def _zone(name: str) -> zoneinfo.ZoneInfo | None:
    try:
        return zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None


@functools.lru_cache(maxsize=1024)
def _abbreviations(name: str) -> dict[str, tuple[int, ...]]:
    """Abbreviations of a zone, with their offsets in seconds since 1990."""
    found: dict[str, set[int]] = {}
    if zone := _zone(name):
        for year in range(1990, 2038):
            for month in (1, 4, 7, 10):
                local = datetime.datetime(year, month, 15, tzinfo=zone)
                found.setdefault(local.tzname(), set()).add(int(local.utcoffset().total_seconds()))
    return {abbreviation: tuple(sorted(offsets)) for abbreviation, offsets in found.items()}


def _offsets(written: str, zone_name: str | None) -> tuple[int, ...]:
    """Offsets in seconds that a written zone part names; none if it isn't understood."""
    if written.upper() in ("Z", "UTC", "GMT"):
        return (0,)
    if m := _OFFSET.fullmatch(written):
        digits, rest = m[2], m[3] or "00"
        seconds = (int(digits) * 60 + int(rest)) * (-60 if m[1] == "-" else 60)
        return (seconds,) if int(rest) < 60 and abs(seconds) <= 18 * 3600 else ()
    return _abbreviations(zone_name or "").get(written, ())


def _by_clock(local: datetime.datetime, zone: zoneinfo.ZoneInfo) -> tuple[list[int], bool]:
    """The instants at which a zone's clock shows a local time; if it skips that time, the instant past the gap and False."""
    trials = {local - local.replace(tzinfo=zone, fold=fold).utcoffset() for fold in (0, 1)}
    utc = datetime.timezone.utc
    shown = sorted(u for u in trials if u.replace(tzinfo=utc).astimezone(zone).replace(tzinfo=None) == local)
    return [(u - _EPOCH) // _MICROSECOND for u in shown or [max(trials)]], bool(shown)


def interpretations(value: str | None, zone_name: str | None, order: str | None) -> list[tuple[int, int, float, bool]]:
    """(epoch_us, format, cost, exact) of every valid interpretation of one written timestamp.

    Empty for null, for anything that isn't a valid date with a time, and for an abbreviation that isn't one of the
    source's zone. The order of a numeric date that the source doesn't declare costs OTHER_ORDER; without a declaration
    both orders cost NO_ORDER. A time the clock skipped isn't exact.
    """
    text = (value or "").strip()
    name, m = next(((name, m) for name, shape in _SHAPES.items() if (m := shape.fullmatch(text))), (None, None))
    if m is None:
        return []
    if name == "epoch":
        whole, fraction = m["whole"], (m["fraction"] or "").ljust(6, "0")
        digits, sign = len(whole.lstrip("-")), -1 if whole[0] == "-" else 1
        if digits <= 11:
            instant = int(whole) * 1_000_000 + sign * int(fraction[:6])
        elif digits <= 14:
            instant = int(whole) * 1_000 + sign * int(fraction[:3])
        else:
            instant = int(whole) if digits <= 17 else int(whole) // 1_000
        return [(instant, FORMATS["epoch"], 0.0, True)]
    hour, half = int(m["hour"]), (m["half"] or "").lower()
    if half:
        if not 1 <= hour <= 12:
            return []
        hour = hour % 12 + 12 * (half == "pm")
    readings = [(name, m["a"], m["b"], 0.0)] if "a" in m.re.groupindex else []
    if name == "dmy":
        declared = (order or "").upper()
        cost = {o: NO_ORDER if declared not in ("DMY", "MDY") else OTHER_ORDER * (declared != o) for o in ("DMY", "MDY")}
        readings = [("dmy", m["b"], m["a"], cost["DMY"]), ("mdy", m["a"], m["b"], cost["MDY"])]
    elif "name" in m.re.groupindex:
        month = m["name"][:3].lower()
        readings = [(name, MONTHS.index(month) + 1, m["b"], 0.0)] if month in MONTHS else []
    written, found = m["zone"] or "", []
    for reading, month, day, cost in readings:
        try:
            local = datetime.datetime(int(m["year"]), int(month), int(day), hour, int(m["minute"]), int(m["second"]), int((m["fraction"] or "")[:6].ljust(6, "0")))
            if written and written[0] != "[":
                instants, exact = [(local - _EPOCH) // _MICROSECOND - s * 1_000_000 for s in _offsets(written, zone_name)], True
            elif zone := _zone(written.strip("[]") or zone_name or ""):
                instants, exact = _by_clock(local, zone)
            else:
                continue
        except (ValueError, OverflowError):
            continue
        found += [(u, FORMATS[reading], cost + SKIPPED * (not exact), exact) for u in instants]
    return found


#: No two neighbours together change the cost of an interpretation by more than this.
_MOST = 2 * (SWITCH + BACKWARD)


def _possible(found: list[tuple[int, int, float, bool]]) -> list[tuple[int, int, float, bool]]:
    """The interpretations that some neighbours can make the best."""
    least = min((c for _, _, c, _ in found), default=0.0)
    return [x for x in found if x[2] <= least + _MOST]


def _interpreted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """record, source, seq of each row, with the interpretations of its value as arrays."""
    for batch in batches:
        found = [interpretations(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("value", "zone_name", "date_order")))]
        # An order that the source doesn't write is no second instant of a value.
        settled = [len({u for u, _, cost, exact in x if exact and cost < OTHER_ORDER}) == 1 for x in found]
        found = [_possible(x) for x in found]
        arrays = [pa.array([[c[k] for c in x] for x in found], pa.list_(kind)) for k, kind in enumerate((pa.int64(), pa.int32(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("record"), batch.column("source"), batch.column("seq"), *arrays, pa.array(settled)], ["record", "source", "seq", "epochs", "formats", "costs", "settled"]
        )


def _steps(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Cost of going from each interpretation of one record to each of the next."""
    switch = before[:, None, 1] != after[None, :, 1]
    backward = after[None, :, 0] < before[:, None, 0]
    return SWITCH * switch + BACKWARD * backward + after[None, :, 2]


def _decoded(states: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> list[int]:
    """The best path through the interpretations of a run, given what each of its first and of its last costs besides."""
    cost, back = start + states[0][:, 2], []
    for before, after in zip(states, states[1:]):
        total = cost[:, None] + _steps(before, after)
        back.append(total.argmin(axis=0))
        cost = total.min(axis=0)
    choice = [int((cost + end).argmin())]
    for link in reversed(back):
        choice.append(int(link[choice[-1]]))
    return choice[::-1]


def _matrix(states: list[np.ndarray]) -> np.ndarray:
    """Cost of the best path through a piece of a run from each of its first to each of its last interpretations."""
    cost = np.where(np.eye(len(states[0]), dtype=bool), states[0][:, 2][:, None], np.inf)
    for before, after in zip(states, states[1:]):
        cost = np.min(cost[:, :, None] + _steps(before, after)[None, :, :], axis=1)
    return cost


def _into(cut: np.ndarray | None, first: np.ndarray) -> np.ndarray:
    """What each interpretation costs after the record before it; nothing where there is none."""
    return np.zeros(len(first)) if cut is None else _steps(cut, first * [1, 1, 0])[0]


def _out_of(last: np.ndarray, cut: np.ndarray | None) -> np.ndarray:
    return np.zeros(len(last)) if cut is None else _steps(last, cut * [1, 1, 0])[:, 0]


_NEAR = ["record", "source", "seq", "epochs", "formats", "costs", "settled"]
# A row that a task streams out is a chosen interpretation, a record of a piece of a run, or an edge: what the driver has
# to know of the range's ends, as rows with `edge` set, in order: a cut, a gap, or a piece with its matrix.
_STREAMED = (
    "record {kind}, settled boolean, epoch_us bigint, format int, part int, piece int, place int, epochs array<bigint>, formats array<int>, costs array<double>, "
    "edge string, source string, first_seq bigint, last_seq bigint, first array<double>, last array<double>, matrix array<double>"
)


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _streamed(distance: int, schema: pa.Schema):
    """The function that decodes sorted rows as they stream by: closed runs at once, those at the edges of the range as pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        order = itertools.count()
        out: list[dict] = []
        pending: list[tuple] = []
        last: tuple | None = None  # (source, seq, states) of the record before
        left: tuple | None = None  # what is before the pending run: None for the edge of the range, else (cut or gap, its states, its seq)

        def edge(kind: str, source: str, first: tuple, final: tuple, matrix: np.ndarray | None = None, place: int | None = None) -> None:
            states = [None if s is None else s.ravel().tolist() for _, s in (first, final)]
            out.append({"edge": kind, "source": source, "first_seq": first[0], "last_seq": final[0], "first": states[0], "last": states[1], "matrix": None if matrix is None else matrix.ravel().tolist(), "part": part, "piece": place, "place": next(order)})

        def flush(right: tuple | None) -> None:
            """Ends the pending run before `right`: (cut or gap, states, seq), or None for the edge of the range."""
            if not pending:
                return
            states = [r[-1] for r in pending]
            if left is not None and right is not None:
                choice = _decoded(states, _into(left[1], states[0]), _out_of(states[-1], right[1]))
                out.extend({"record": r[0], "settled": r[6], "epoch_us": int(s[k, 0]), "format": int(s[k, 1])} for r, s, k in zip(pending, states, choice))
            else:
                source, number = pending[0][1], next(order)
                if left is not None:
                    edge(left[0], source, (left[2], left[1]), (left[2], left[1]))
                edge("piece", source, (pending[0][2], states[0]), (pending[-1][2], states[-1]), _matrix(states), number)
                if right is not None:
                    edge(right[0], source, (right[2], right[1]), (right[2], right[1]))
                out.extend({"record": r[0], "settled": r[6], "part": part, "piece": number, "place": k, "epochs": r[3], "formats": r[4], "costs": r[5]} for k, r in enumerate(pending))
            pending.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _NEAR)):
                states = np.array([row[3], row[4], row[5]], dtype=float).T
                far = last is not None and not _neighbours(last[0], last[1], row[1], row[2], distance)
                if far:
                    flush(("gap", None, None))
                if len(states) == 1:
                    flush(("cut", states, row[2]))
                    if last is None:
                        edge("cut", row[1], (row[2], states), (row[2], states))
                else:
                    if not pending:
                        left = None if last is None else ("gap", None, None) if far else ("cut", last[2], last[1])
                    pending.append((*row, states))
                last = (row[1], row[2], states)
                if len(out) >= 10_000:
                    yield _table(out, schema)
                    out.clear()
        if pending:
            flush(None)
        elif last is not None:
            edge("cut", last[0], (last[1], last[2]), (last[1], last[2]))
        if out:
            yield _table(out, schema)

    return run


def _neighbours(source: str, seq: int | None, next_source: str, next_seq: int | None, distance: int) -> bool:
    return source == next_source and seq is not None and next_seq is not None and next_seq - seq <= distance


def _chained(edges: list, distance: int) -> list[tuple[int, int, int, int]]:
    """(part, piece, first, last): the interpretations at the ends of each piece, on the best path of the run it is of.

    Edges are in order; pieces that follow each other are of one run, unless they are of two sources or too far apart.
    """
    out, run = [], []
    shaped = [(e, *(None if x is None else np.array(x).reshape(-1, 3) for x in (e["first"], e["last"]))) for e in edges]

    def ends(after: np.ndarray | None) -> None:
        if not run:
            return
        best, back = np.zeros(1), []
        for k, (e, first, last, before) in enumerate(run):
            into = _into(before, first)[None, :] if k == 0 else _steps(run[k - 1][2], first * [1, 1, 0])
            total = best[:, None, None] + into[:, :, None] + np.array(e["matrix"]).reshape(len(first), len(last))[None, :, :]
            pick = total.reshape(-1, len(last)).argmin(axis=0)
            back.append(np.unravel_index(pick, total.shape[:2]))
            best = total.min(axis=(0, 1))
        end = int((best + _out_of(run[-1][2], after)).argmin())
        for (e, *_), (before, first) in zip(reversed(run), reversed(back)):
            out.append((e["part"], e["piece"], int(first[end]), end))
            end = int(before[end])
        run.clear()

    previous = None
    for e, first, last in shaped:
        joined = previous is not None and previous[0]["edge"] != "gap" and e["edge"] != "gap" and _neighbours(previous[0]["source"], previous[0]["last_seq"], e["source"], e["first_seq"], distance)
        if e["edge"] == "piece":
            if not joined:
                ends(None)
            run.append((e, first, last, previous[2] if joined and not run else None))
        else:
            ends(first if joined else None)
        previous = (e, first, last)
    ends(None)
    return out


def _piece(part: pd.DataFrame) -> pd.DataFrame:
    """The interpretations of a piece between the given ones of its ends."""
    part = part.sort_values("place")
    states = [np.array([e, f, c], dtype=float).T for e, f, c in zip(part["epochs"], part["formats"], part["costs"])]
    fixed = [np.where(np.arange(len(s)) == k, 0.0, np.inf) for s, k in ((states[0], part["head"].iloc[0]), (states[-1], part["tail"].iloc[0]))]
    choice = _decoded(states, *fixed)
    part = part.assign(epoch_us=[int(s[k, 0]) for s, k in zip(states, choice)], format=[int(s[k, 1]) for s, k in zip(states, choice)])
    return part[["record", "epoch_us", "format", "settled"]]


def normalise_timestamps(
    records: DataFrame,
    sources: DataFrame,
    *,
    record: str = "message_id",
    source: str = "source_key",
    value: str = "ts_raw",
    seq: str = "seq",
    distance: int = 256,
    most_sources: int = 100_000,
    most_blocks: int = 100_000,
) -> DataFrame:
    """record, epoch_us, format, settled: the interpretation chosen for the value of each row.

    `sources` holds `source`, zone_name and date_order. `settled` says that the value names that one instant by itself
    and the source's declared settings; else the path chose among several, or moved a skipped time. Values without any
    interpretation (null, empty, broken) have null in epoch_us and format and false in settled. Records of a source are
    neighbours on the path if they follow each other in `seq`, ties by record, at most `distance` apart; a record
    without `seq` has none. Rows that repeat in all of these columns count once on the path. A null source is a source
    of its own; a source missing from `sources` leaves local times without an instant. The table of sources is
    broadcast up to `most_sources` rows and shuffled beyond, and so are the places of ambiguous records up to
    `most_blocks`. The interpretations and what is decoded at once are written into the shared folder.
    """
    declared = small(sources.select(F.col(source).alias("source"), "zone_name", "date_order").dropDuplicates(["source"]), most_sources)
    rows = records.select(F.col(record).alias("record"), F.col(source).alias("source"), F.col(seq).cast("bigint").alias("seq"), F.col(value).alias("value"))
    rows = spread(rows).join(declared, "source", "left").withColumn("source", F.coalesce("source", F.lit("")))
    kind = rows.schema["record"].dataType.simpleString()
    rows = rows.mapInArrow(_interpreted, f"record {kind}, source string, seq bigint, epochs array<bigint>, formats array<int>, costs array<double>, settled boolean")
    rows = written(rows, "interpretations")
    alone = rows.where(F.size("epochs") <= 1).select("record", F.try_element_at("epochs", F.lit(1)).alias("epoch_us"), F.try_element_at("formats", F.lit(1)).alias("format"), "settled")

    # What ambiguous records can be neighbours of: the block of positions that they are in and the ones beside it.
    block = F.floor(F.col("seq") / distance)
    places = rows.where("size(epochs) > 1 AND seq IS NOT NULL").select("source", F.explode(F.array(block - 1, block, block + 1)).alias("block")).distinct()
    near = rows.where("size(epochs) > 0 AND seq IS NOT NULL").withColumn("block", block).join(small(places, most_blocks), ["source", "block"], "left_semi").drop("block")
    near = near.unionByName(rows.where("size(epochs) > 1 AND seq IS NULL")).select(*_NEAR).distinct()
    ordered = near.repartitionByRange("source", "seq", "record").sortWithinPartitions("source", "seq", "record")
    schema = to_arrow_schema(_parse_datatype_string(_STREAMED.format(kind=kind)))
    streamed = written(ordered.mapInArrow(_streamed(distance, schema), _STREAMED.format(kind=kind)), "paths")
    edges = streamed.where("edge IS NOT NULL").orderBy("part", "place").collect()
    ends = records.sparkSession.createDataFrame(_chained(edges, distance), "part int, piece int, head int, tail int")
    chosen = streamed.where("edge IS NULL AND part IS NULL").select("record", "epoch_us", "format", "settled")
    pieces = streamed.where("edge IS NULL AND part IS NOT NULL").select("record", "settled", "part", "piece", "place", "epochs", "formats", "costs").join(F.broadcast(ends), ["part", "piece"])
    decoded = pieces.groupBy("part", "piece").applyInPandas(_piece, f"record {kind}, epoch_us bigint, format int, settled boolean")
    return alone.unionByName(chosen).unionByName(decoded).withColumnRenamed("record", record)
