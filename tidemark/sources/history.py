"""Reading shell histories and commit logs.

Histories are a data source of their own: a file is cut into ranges of bytes,
each range is decoded by one task as a stream of lines, and a record belongs to
the range in which its command begins. So a task first looks for a place near
its range where a record must begin, whatever stands before it.
"""

from __future__ import annotations

import fnmatch
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.functions.text import HOOKS, clean_command

SPLIT = 64 << 20  # bytes of a range
BACK = 1 << 16  # bytes looked at first in the search for a record's beginning; four times as many each further time
BATCH = 4096  # records that go to the JVM together
SCHEMA = pa.schema([("path", pa.string()), ("mtime", pa.int64()), ("position", pa.int64()), ("timestamp", pa.int64()), ("duration", pa.int64()), ("command", pa.string())])
_ZSH = re.compile(r"^:\s*(\d+):(\d+);(.*)$", re.S)
_BASH = re.compile(r"^#(\d{10})$")
Record = tuple[int, int | None, int | None, str]  # place of the command in bytes, time, duration, text


def _long(digits: str) -> int | None:
    return int(digits) if len(digits) < 19 else None


class Lines:
    """The lines of a file from a place on, of which the next is known; records may begin before ``end``."""

    def __init__(self, file: BinaryIO, at: int, end: int):
        file.seek(at)
        self.file, self.next, self.end, self.more = file, at, end, True
        self._read()

    def _read(self) -> None:
        raw = self.file.readline()
        self.at, self.line, self.last = self.next, raw.removesuffix(b"\n").decode("utf-8", "replace"), not raw.endswith(b"\n")
        self.next += len(raw)

    def take(self) -> str:
        line = self.line
        self.more = not self.last
        if self.more:
            self._read()
        return line

    @property
    def owned(self) -> bool:
        return self.more and self.at < self.end


def _joined(lines: Lines, mark: str, stop: re.Pattern | None, first: str) -> str | None:
    """The command that starts with ``first`` and goes on while lines end with ``mark``; null if a hook cuts in."""
    parts = [first]
    while lines.more and parts[-1].rstrip().endswith(mark) and not (stop and stop.match(lines.line)):
        line = lines.take()
        if any(h in line.lower() for h in HOOKS):
            return None
        parts[-1] = parts[-1].rstrip()[:-1]
        parts.append(line)
    return " ".join(parts)


def _zsh(lines: Lines, stamped: bool) -> Iterator[Record]:
    """Stamped records; plain lines count before the first stamp only, and later ones if they start with ``::``."""
    while lines.owned:
        at, found, line = lines.at, _ZSH.match(lines.line), lines.take()
        if found:
            stamped = True
            text = _joined(lines, "\\", _ZSH, found[3])
            if text:
                yield at, _long(found[1]), _long(found[2]), text
        elif not stamped or line.startswith("::"):
            text = _joined(lines, "\\", _ZSH, line)
            if text:
                yield at, None, None, text


def _bash(lines: Lines, _: bool) -> Iterator[Record]:
    """``#`` stamps apply to the next command; of several in a row the last counts."""
    stamp = None
    while lines.owned:
        at, line = lines.at, lines.take()
        found = _BASH.match(line.strip())
        if found:
            stamp = int(found[1])
        elif line.strip():
            text = _joined(lines, "\\", _BASH, line)
            if text:
                yield at, stamp, None, text
            stamp = None


def _fish(lines: Lines, _: bool) -> Iterator[Record]:
    """A command and, below it, its time."""
    at, command, when = 0, None, None
    while lines.owned or (lines.more and command):
        place, line = lines.at, lines.take()
        if line.startswith("- cmd: "):
            if command:
                yield at, when, None, command
            escapes = lambda m: "\n" if m[1] == "n" else "\\"
            at, command, when = place, re.sub(r"\\(n|\\)", escapes, line[7:]) if place < lines.end else None, None
        elif line.startswith("  when: ") and line[8:].strip().isdecimal():
            when = _long(line[8:].strip())
    if command:
        yield at, when, None, command


def _powershell(lines: Lines, _: bool) -> Iterator[Record]:
    while lines.owned:
        at, line = lines.at, lines.take()
        text = _joined(lines, "`", None, line)
        if text and text.strip():
            yield at, None, None, text


DECODERS = {"zsh": _zsh, "bash": _bash, "fish": _fish, "powershell": _powershell}
MARKS = {"zsh": "\\", "bash": "\\", "powershell": "`"}
HEADS = {"zsh": _ZSH, "bash": _BASH}


def kind_of(path: str) -> str:
    """The format that a file's name stands for."""
    name = path.rsplit("/", 1)[-1].lower()
    if "zsh" in name:
        return "zsh"
    if "fish_history" in name:
        return "fish"
    return "powershell" if "consolehost_history.txt" in name else "bash"


def _closes(line: str, kind: str) -> bool:
    """Whether a record begins after ``line``, whatever stands before it."""
    if line.rstrip().endswith(MARKS[kind]):
        return False
    return kind != "bash" or bool(line.strip() and not _BASH.match(line.strip()))


def beginning(file: BinaryIO, at: int, kind: str) -> int:
    """The last place up to ``at``, which begins a line, where a record must begin.

    Lines that go on and the stamps over a command are passed by, so the search
    is as long as they are. A fish record begins with a sign of its own.
    """
    if kind == "fish":
        return at
    back, head = BACK, HEADS.get(kind)
    while at:
        low = max(0, at - back)
        file.seek(low)
        before = file.read(at - low).split(b"\n")[:-1][1 if low else 0 :]
        line, place = file.readline().decode("utf-8", "replace").removesuffix("\n"), at
        for raw in reversed(before):
            previous = raw.decode("utf-8", "replace")
            if (head and head.match(line)) or _closes(previous, kind):
                return place
            line, place = previous, place - len(raw) - 1
        if not low:
            return 0
        back *= 4
    return 0


def settled(file: BinaryIO, size: int, kind: str) -> int:
    """Up to where a growing file's records are whole: open lines, and commands that may still go on, are left for later."""
    back, mark = BACK, b"\n- cmd: " if kind == "fish" else b"\n"
    while size:
        low = max(0, size - back)
        file.seek(low)
        found = file.read(size - low).rfind(mark)
        if found >= 0:
            return beginning(file, low + found + 1, kind)
        if not low:
            break
        back *= 4
    return 0


def records(file: BinaryIO, kind: str, start: int, end: int, stamped: bool) -> Iterator[Record]:
    """The records whose command begins at ``start`` or later, and before ``end``."""
    at = start
    if start:
        file.seek(start - 1)
        file.readline()
        at = file.tell()
    if at < end:
        yield from (r for r in DECODERS[kind](Lines(file, beginning(file, at, kind), end), stamped) if r[0] >= at)


def _stamped_before(file: BinaryIO, end: int) -> bool:
    """Whether a zsh stamp begins before ``end``; it is the first line as a rule."""
    file.seek(0)
    while file.tell() < end:
        if _ZSH.match(file.readline().decode("utf-8", "replace")):
            return True
    return False


@dataclass
class Range(InputPartition):
    """Bytes of one file."""

    base: str
    inner: str
    path: str
    kind: str
    mtime: int
    start: int
    end: int


def _opened(base: str) -> tuple[fs.FileSystem, str]:
    local = re.sub(r"^file:(//)?", "", base)
    return fs.FileSystem.from_uri(base) if "://" in local else (fs.LocalFileSystem(), local)


def _file(base: str, inner: str) -> BinaryIO:
    return io.BufferedReader(_opened(base)[0].open_input_file(inner), 1 << 20)


def _ignored(inner: str, base: str) -> bool:
    """Spark's own marks and checksums; other hidden files are histories like any."""
    name = inner.rsplit("/", 1)[-1]
    return inner != base and (name.startswith("_") or name.endswith(".crc"))


def listed(given: str, kind: str | None) -> list[Range]:
    """All files of a path: a file, a folder with all below it, or a pattern with ``*``, ``?`` and ``[]``; hidden ones too."""
    base = given if not re.search(r"[*?\[]", given) else re.split(r"[*?\[]", given, maxsplit=1)[0].rsplit("/", 1)[0]
    system, inner = _opened(base)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(given)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    out = []
    for x in found:
        path = base + x.path[len(inner) :]
        if x.type == fs.FileType.File and not _ignored(x.path, inner) and (base == given or fnmatch.fnmatchcase(path, given)):
            out.append(Range(base, x.path, path, kind or kind_of(path), x.mtime_ns // 10**9, 0, x.size))
    return sorted(out, key=lambda r: r.path)


def _cut(part: Range, size: int) -> list[Range]:
    """Ranges of ``size`` bytes. A zsh file whose first line has no stamp stays whole: what a plain line means there depends on all before it."""
    if part.kind == "zsh" and part.start == 0 and part.end > size:
        with _file(part.base, part.inner) as file:
            if not _ZSH.match(file.readline().decode("utf-8", "replace")):
                return [part]
    return [Range(part.base, part.inner, part.path, part.kind, part.mtime, at, min(at + size, part.end)) for at in range(part.start, part.end, size)]


def _decoded(part: Range) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    with _file(part.base, part.inner) as file:
        stamped = part.kind == "zsh" and part.start > 0 and _stamped_before(file, part.start)
        for record in records(file, part.kind, part.start, part.end, stamped):
            rows.append((part.path, part.mtime, *record))
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)


class HistoryReader(DataSourceReader):
    def __init__(self, paths: list[str], kind: str | None, size: int):
        self.paths, self.kind, self.size = paths, kind, size

    def partitions(self) -> list[Range]:
        return [r for path in self.paths for whole in listed(path, self.kind) for r in _cut(whole, self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _decoded(partition)


class HistoryStreamReader(HistoryReader, DataSourceStreamReader):
    """An offset says of each file up to where it has been read; a file that became shorter is read anew."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for r in (r for path in self.paths for r in listed(path, self.kind)):
            with _file(r.base, r.inner) as file:
                out[r.path] = [r.base, r.inner, r.kind, r.mtime, settled(file, r.end, r.kind)]
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, (base, inner, kind, mtime, to) in sorted(end.items()):
            begun = start.get(path, [0])[-1]
            out += _cut(Range(base, inner, path, kind, mtime, begun if begun <= to else 0, to), self.size)
        return out

    def commit(self, end: dict) -> None:
        pass


class HistorySource(DataSource):
    """Shell histories, batch or stream. Options: paths (a list as JSON), kind, splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "shell_history"

    def schema(self) -> str:
        return "path string, mtime long, position long, timestamp long, duration long, command string"

    def _arguments(self) -> tuple[list[str], str | None, int]:
        return json.loads(self.options["paths"]), self.options.get("kind") or None, int(self.options.get("splitBytes", SPLIT))

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(*self._arguments())

    def streamReader(self, schema) -> HistoryStreamReader:
        return HistoryStreamReader(*self._arguments())


def _loaded(spark: SparkSession, reader, paths: str | list[str], kind: str | None, split_bytes: int) -> DataFrame:
    spark.dataSource.register(HistorySource)
    options = {"paths": json.dumps([paths] if isinstance(paths, str) else list(paths)), "kind": kind or "", "splitBytes": str(split_bytes)}
    rows = reader.format(HistorySource.name()).options(**options).load()
    return rows.withColumn("command", clean_command(F.col("command"))).where("command <> ''")


def read_histories(spark: SparkSession, paths: str | list[str], kind: str | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """path, mtime, position, timestamp, duration, command: all histories, cleaned, hooks dropped.

    ``paths`` are files, folders (with all below) or patterns, hidden files
    included. The format is ``kind`` (zsh, bash, fish, powershell) or follows
    from the file's name. ``position`` is the command's place in the file, in
    bytes. The rows do not depend on ``split_bytes``. Bytes that are no UTF-8
    become replacement signs, times of 19 digits or more null; empty files have
    no rows, and a path without a file is an error.
    """
    return _loaded(spark, spark.read, paths, kind, split_bytes)


def stream_histories(spark: SparkSession, paths: str | list[str], kind: str | None = None, split_bytes: int = SPLIT) -> DataFrame:
    """``read_histories`` as a stream over files that grow.

    A batch takes the records that are whole: a line without its end, a command
    whose line goes on, stamps without a command, and a file's last fish command,
    whose time may still come, wait for the next one.
    """
    return _loaded(spark, spark.readStream, paths, kind, split_bytes)


def merge_histories(histories: DataFrame, keys: list[str]) -> DataFrame:
    """One row per time and command, the first by file and position; rows without a time all stay."""
    stamped = histories.where("timestamp IS NOT NULL")
    first = stamped.groupBy(*keys, "timestamp", "command").agg(F.min_by(F.struct("path", "position", "duration"), F.struct("path", "position")).alias("x")).select(*keys, "timestamp", "command", "x.*")
    return first.unionByName(histories.where("timestamp IS NULL").select(*first.columns))


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """hash, timestamp, message from ``hash|epoch|subject`` lines; malformed lines are dropped."""
    parts = F.split("value", r"\|", 3)
    rows = spark.read.text(path).where(F.size(parts) == 3).select(parts[0].alias("hash"), parts[1].try_cast("long").alias("timestamp"), parts[2].alias("message"))
    return rows.where("timestamp IS NOT NULL AND hash <> ''")


def read_change_volume(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines added and deleted from numstat lines (- counts as none)."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(parts) == 3)
    return rows.agg(F.coalesce(F.sum(parts[0].try_cast("long")), F.lit(0)).alias("added"), F.coalesce(F.sum(parts[1].try_cast("long")), F.lit(0)).alias("deleted"))


def merged_branches(messages: DataFrame) -> DataFrame:
    """Names of merged branches from commit messages (message, position), in first-seen order."""
    m = F.col("message")
    name = F.coalesce(*[F.nullif(F.regexp_extract(m, p, 1), F.lit("")) for p in (r"Merge branch '([^']+)'", r"Merge pull request #\d+ from \S+?/(\S+)", r"Merge remote-tracking branch '([^']+)'")])
    return messages.select(name.alias("branch"), "position").where("branch IS NOT NULL").groupBy("branch").agg(F.min("position").alias("position"))
