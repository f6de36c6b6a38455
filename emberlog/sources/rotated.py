"""A log and its rotated siblings as a Spark data source, read whole or followed.

    spark.dataSource.register(RotatedLog)
    spark.read.format("rotated_log").load("/var/log/auth.log")
    spark.readStream.format("rotated_log").load("/var/log/auth.log")

Rows: file (name at the time of reading), place (byte at which the line starts, in the plain text), line, modified (the
file's). Files are reached through pyarrow.fs, so a path may be a URI of any store that it knows. Options: `since`, an
ISO time before which files were last written that are left out; `split`, the bytes of a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, GreaterThan, GreaterThanOrEqual, InputPartition

SPLIT, BLOCK, HEAD = 64 << 20, 1 << 20, 1024
#: What follows the name of a log in those of its siblings: a number or a date, and the packing.
SIBLING = re.compile(r"(?:\.(\d{1,4})|-(\d{8}))?(\.gz)?")
#: In a stream's offset: the whole of a packed file, which does not grow.
WHOLE = -1


@dataclass
class Log:
    path: str
    size: int
    modified: datetime
    packed: bool

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]


@dataclass
class Piece(InputPartition):
    """The lines of a log that start from `start` on and before `stop` (WHOLE: up to its end)."""

    path: str
    packed: bool
    modified: datetime
    start: int
    stop: int


def siblings(store: fs.FileSystem, path: str, since: datetime | None = None) -> list[Log]:
    """The log and its rotated siblings (path.1, path.2.gz, path-20240501), oldest first; names that go on otherwise (.bak) are others."""
    folder, base = path.rsplit("/", 1)
    found = []
    for x in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        m = SIBLING.fullmatch(x.base_name[len(base) :]) if x.type == fs.FileType.File and x.base_name.startswith(base) else None
        if m and not (since and x.mtime and x.mtime < since):
            order = (0, int(m[2])) if m[2] else (1, -int(m[1])) if m[1] else (2, 0)
            found.append((order, Log(x.path, x.size, x.mtime, bool(m[3]))))
    return [log for _, log in sorted(found, key=lambda f: (f[0], f[1].path))]


def opened(store: fs.FileSystem, path: str, packed: bool):
    return store.open_input_stream(path, compression="gzip" if packed else None)


def first_line(store: fs.FileSystem, log: Log) -> str | None:
    """A name for a log's content that stays when it is renamed or packed: a digest of its first line (of HEAD bytes at most)."""
    with opened(store, log.path, log.packed) as f:
        head = f.read(HEAD)
    return hashlib.sha1(head.split(b"\n", 1)[0]).hexdigest() if b"\n" in head or len(head) == HEAD else None


def last_line_end(store: fs.FileSystem, log: Log) -> int:
    """Where the last whole line ends; what a writer has not finished is left for later."""
    with store.open_input_file(log.path) as f:
        stop = log.size
        while stop:
            start = max(0, stop - BLOCK)
            f.seek(start)
            if (at := f.read(stop - start).rfind(b"\n")) >= 0:
                return start + at + 1
            stop = start
    return 0


def _blocks(store: fs.FileSystem, p: Piece) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of a piece's text from its start on, in blocks."""
    at = p.start
    if p.packed:
        with opened(store, p.path, True) as f:
            skip = p.start
            while skip and (b := f.read(min(skip, BLOCK))):
                skip -= len(b)
            while b := f.read(BLOCK):
                yield at, b
                at += len(b)
    else:
        with store.open_input_file(p.path) as f:
            f.seek(at)
            while b := f.read(BLOCK):
                yield at, b
                at += len(b)


def read_piece(store: fs.FileSystem, p: Piece) -> Iterator[pa.RecordBatch]:
    """The lines that start in the piece. A line belongs to the piece in which it starts, so a piece begins after the first
    line feed from the byte before its start on. Lines end at line feeds; a carriage return before one goes."""
    begin = max(0, p.start - 1)
    held, at, skip = b"", begin, p.start > 0
    stop = float("inf") if p.stop == WHOLE else p.stop
    name = p.path.rsplit("/", 1)[-1]

    def rows(places: list[int], found: list[bytes]) -> pa.RecordBatch:
        text = [x.removesuffix(b"\r").decode(errors="replace") for x in found]
        keep = [k for k, x in enumerate(text) if x]
        return pa.RecordBatch.from_pydict({"file": pa.array([name] * len(keep)), "place": pa.array([places[k] for k in keep], pa.int64()), "line": pa.array([text[k] for k in keep], pa.string()), "modified": pa.array([p.modified] * len(keep), pa.timestamp("us", "UTC"))})

    for _, block in _blocks(store, Piece(p.path, p.packed, p.modified, begin, p.stop)):
        held += block
        if skip:
            if (first := held.find(b"\n")) < 0:
                at, held = at + len(held), b""
                continue
            at, held, skip = at + first + 1, held[first + 1 :], False
        *whole, held = held.split(b"\n")
        places, found = [], []
        for x in whole:
            if at >= stop:
                break
            places.append(at)
            found.append(x)
            at += len(x) + 1
        if found:
            yield rows(places, found)
        if at >= stop:
            return
    if held and at < stop and not skip:
        yield rows([at], [held])


class _Source:
    def __init__(self, options: dict):
        path = options["path"]
        self.store, self.path = fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)
        self.split = int(options.get("split", SPLIT))
        self.since = datetime.fromisoformat(options["since"]).replace(tzinfo=UTC) if options.get("since") else None

    def pieces(self, log: Log, start: int, stop: int) -> list[Piece]:
        if log.packed:
            return [Piece(log.path, True, log.modified, start, WHOLE)]
        return [Piece(log.path, False, log.modified, at, min(stop, at + self.split)) for at in range(start, stop, self.split)]

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # without pieces Spark asks once for none
            yield from read_piece(self.store, partition)


class RotatedReader(_Source, DataSourceReader):
    """All lines there are; filters on `modified` leave files out before any is opened."""

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            if isinstance(f, GreaterThan | GreaterThanOrEqual) and f.attribute == ("modified",):
                self.since = max(x for x in (self.since, f.value.replace(tzinfo=f.value.tzinfo or UTC)) if x)
            yield f  # Spark goes on to test the rows

    def partitions(self) -> list[Piece]:
        return [p for log in siblings(self.store, self.path, self.since) for p in self.pieces(log, 0, log.size)]


class RotatedStream(_Source, DataSourceStreamReader):
    """Whole lines as they are written. An offset holds, by the content's name, how far each log is read; so a log that is
    renamed or packed in between goes on where it was, and each line comes once, over restarts too."""

    def _logs(self) -> dict[str, Log]:
        """By content; of a log that is there twice, plain and packed, the packed one."""
        found: dict[str, Log] = {}
        for log in siblings(self.store, self.path, self.since):
            name = first_line(self.store, log)
            if name and (name not in found or log.packed):
                found[name] = log
        return found

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {name: WHOLE if log.packed else last_line_end(self.store, log) for name, log in self._logs().items()}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out, logs = [], self._logs()
        for name, stop in end.items():
            begin = start.get(name, 0)
            log = logs.get(name)
            if log is None or begin in (stop, WHOLE):
                continue
            if log.packed and stop != WHOLE:  # packed since the offset was taken: only up to there
                out.append(Piece(log.path, True, log.modified, begin, stop))
            else:
                out += self.pieces(log, begin, stop)
        return out

    def commit(self, end: dict) -> None:
        pass


class RotatedLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rotated_log"

    def schema(self) -> str:
        return "file string, place long, line string, modified timestamp"

    def reader(self, schema) -> RotatedReader:
        return RotatedReader(dict(self.options))

    def streamReader(self, schema) -> RotatedStream:
        return RotatedStream(dict(self.options))
