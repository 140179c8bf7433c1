"""Files of any size as chunks of text.

A folder of any file system that ``pyarrow.fs`` opens (a mounted folder, HDFS, S3, GCS, ...) is listed with names that Spark's own file sources
leave out (``_x.py``, ``__init__.py``, ``.env``). Reads are planned by bytes: small files share a task up to ``taskBytes``, and a file longer than ``rangeBytes`` is cut into ranges that
different tasks read. A range yields the lines that begin in it, so a chunk never cuts a line, and the chunks of a file in the order of ``part`` are the file.

Rows are ``path, part, content``. ``content`` is binary; it is null for weight files, which are judged by name, and for files that can no longer be read.

There are two ways to them. :func:`read_chunks` lists and plans in tasks: the plan lies in the shared folder, which ``pyarrow.fs`` must open too, and the driver holds a number for each task and the name of each file of the plan.
The data source, ``spark.dataSource.register(FilesSource)`` and ``spark.read.format("wardspark_files")``, needs no shared folder, but Spark has it plan on the driver, which then holds every file: it is for folders that a driver can list.
"""

import math
import os
import sys
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import accumulate, islice

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wardspark.catalog import patterns as cat
from wardspark.functions.text import decode_text
from wardspark.plans.storage import new_location, written
from wardspark.sources.local import local_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "wardspark_files"
RANGE_BYTES, TASK_BYTES = 64 << 20, 64 << 20
#: Bytes that are looked through at a time for the end of a line; rows and bytes of a batch; folders that are listed at a time.
_STEP, _ROWS, _BATCH, _LISTERS = 1 << 20, 256, 8 << 20, 16
#: Entries after which a listing task leaves further folders to others; folders that it is given; pieces of a share, at most.
_ENTRIES, _FOLDERS, _PIECES = 10_000, 4096, 10_000
_SCHEMA = "path string, part int, content binary"
_PLAN = pa.schema([("path", pa.string()), ("part", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])
_LISTED = pa.schema([("folder", pa.string()), ("plan", pa.string()), ("shares", pa.int64()), ("left", pa.int64())])


def opened(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    if "://" in folder:
        return pa.fs.FileSystem.from_uri(folder)
    return pa.fs.FileSystem.from_uri("file://" + os.path.abspath(folder.removeprefix("file:")))


def is_scannable(name: str, extensions: list[str]) -> bool:
    """As ``artifacts.scannable``, for the name of a file."""
    return name.startswith(".env") or _suffix(name) in extensions


def _suffix(name: str) -> str:
    stem, dot, last = name.rpartition(".")
    return f".{last}".lower() if stem and dot and last else ""


def list_files(folder: str, extensions: list[str], skipped: list[str]) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the files below a folder that are looked at, or of the folder itself if it is a file. Hidden and ignored folders are not entered."""
    system, info = _top(folder)
    if info.type == pa.fs.FileType.File:
        yield info.path, info.size
        return
    yield from walk(system, [info.path], extensions, skipped)


def _top(folder: str) -> tuple[pa.fs.FileSystem, pa.fs.FileInfo]:
    system, top = opened(folder)
    info = system.get_file_info(top)
    if info.type == pa.fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    return system, info


def walk(system: pa.fs.FileSystem, folders: Iterable[str], extensions: list[str], skipped: list[str], most: float = math.inf) -> Iterator[tuple[str, int | None]]:
    """(path, bytes) of the files in folders that are looked at, and below them until ``most`` entries were seen; from then on (path, None) of the folders that are left.

    What is held: the folders to enter, and the entries of as many folders as are listed at a time. That is one after a folder of many entries, and twice as many after any other.
    """
    given, below, seen, width = iter(folders), [], 0, 1
    with ThreadPoolExecutor(_LISTERS) as pool:
        while at := list(islice(given, width)) or [below.pop() for _ in range(min(width, len(below)))]:
            listed = 0
            for entries in pool.map(lambda folder: system.get_file_info(pa.fs.FileSelector(folder)), at):
                listed, seen = listed + len(entries), seen + len(entries)
                for entry in sorted(entries, key=lambda e: e.path):
                    if entry.type == pa.fs.FileType.Directory:
                        if entry.base_name not in skipped and not entry.base_name.startswith("."):
                            below.append(entry.path)
                    elif entry.type == pa.fs.FileType.File and is_scannable(entry.base_name, extensions):
                        yield entry.path, entry.size
                if seen >= most:
                    yield from ((path, None) for path in below)
                    below.clear()
            width = min(2 * width, _LISTERS) if listed < _ENTRIES else 1


class _Shares:
    """Files dealt out to tasks in the order in which they come. A share is a list of (path, part, start, stop)."""

    def __init__(self, range_bytes: int, task_bytes: int) -> None:
        self.range_bytes, self.task_bytes, self.pieces, self.held = range_bytes, task_bytes, [], 0

    def add(self, path: str, size: int) -> Iterator[list[tuple[str, int, int, int]]]:
        """The shares that are full before the last range of this file."""
        for part, start in enumerate(range(0, max(size, 1), self.range_bytes)):
            stop = min(size, start + self.range_bytes)
            if self.pieces and (self.held + stop - start > self.task_bytes or len(self.pieces) >= _PIECES):
                yield from self.rest()
            self.pieces.append((path, part, start, stop))
            self.held += stop - start

    def rest(self) -> Iterator[list[tuple[str, int, int, int]]]:
        """The share that is not full, if any."""
        share, self.pieces, self.held = self.pieces, [], 0
        if share:
            yield share


def plan(files: Iterator[tuple[str, int]], range_bytes: int, task_bytes: int) -> list[list[tuple[str, int, int, int]]]:
    """Tasks as lists of (path, part, start, stop): ranges of long files, and small files next to each other up to the bytes of a task."""
    shares = _Shares(range_bytes, task_bytes)
    return [share for file in sorted(files) for share in shares.add(*file)] + list(shares.rest())


class _Plan:
    """A file of shares, each a batch by itself, so that a task reads its own and no other. It is written once the first share is full."""

    def __init__(self, place: str, range_bytes: int, task_bytes: int, unread: list[str]) -> None:
        self.place, self.unread, self.shares, self.count = place, unread, _Shares(range_bytes, task_bytes), 0
        self.name, self.stream, self.writer = f"{uuid.uuid4().hex}.arrow", None, None

    def add(self, path: str, size: int) -> None:
        """Weight files are listed and not read."""
        self._write(self.shares.add(path, 0 if _suffix(path.rpartition("/")[2]) in self.unread else size))

    def close(self) -> int:
        """The number of shares; there is no file if there are none."""
        self._write(self.shares.rest())
        if self.writer:
            self.writer.close()
            self.stream.close()
        return self.count

    def _write(self, shares: Iterator[list[tuple[str, int, int, int]]]) -> None:
        for share in shares:
            if not self.writer:
                system, top = opened(self.place)
                system.create_dir(top, recursive=True)
                self.stream = system.open_output_stream(f"{top}/{self.name}", compression=None)
                self.writer = pa.ipc.new_file(self.stream, _PLAN, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            self.writer.write_batch(pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*share), _PLAN)], schema=_PLAN))
            self.count += 1


def _planned(spark: SparkSession, folder: str, extensions: list[str], range_bytes: int, task_bytes: int) -> tuple[str, list[tuple[str, int]]]:
    """A folder of plans, and each plan with its number of shares. Tasks list folders and plan the files in them, in rounds: a task enters the folders that it finds
    until it has seen many entries, and leaves the others to the next round, which deals them out again. A task that ran twice leaves a plan that nobody reads."""
    place, skipped, unread = new_location(spark, "plan"), list(cat.IGNORED_DIRECTORIES), list(cat.BINARY_EXTENSIONS)
    info = _top(folder)[1]
    if info.type == pa.fs.FileType.File:
        own = _Plan(place, range_bytes, task_bytes, unread)
        own.add(info.path, info.size)
        return place, [(own.name, own.close())]

    def list_some(batches):
        system, own, left, n_left = opened(folder)[0], _Plan(place, range_bytes, task_bytes, unread), [], 0
        rows = lambda folders, summary=(None, None, None): pa.RecordBatch.from_pylist([{"folder": f} for f in folders] or [dict(zip(_LISTED.names[1:], summary))], schema=_LISTED)
        for path, size in walk(system, (f for batch in batches for f in batch.column(0).to_pylist()), extensions, skipped, _ENTRIES):
            if size is not None:
                own.add(path, size)
                continue
            left.append(path)
            if len(left) == _ENTRIES:
                yield rows(left)
                left, n_left = [], n_left + len(left)
        if left:
            yield rows(left)
        yield rows([], (own.name, own.close(), n_left + len(left)))

    waiting, count, plans = local_table(spark, [{"folder": info.path}], "folder string"), 1, []
    while count:
        tasks = min(count, max(spark.sparkContext.defaultParallelism, math.ceil(count / _FOLDERS)))
        found = written(waiting.repartition(tasks).mapInArrow(list_some, "folder string, plan string, shares long, left long"), "listed")
        done = found.where("plan is not null").select("plan", "shares", "left").collect()
        plans += [(r.plan, r.shares) for r in done if r.shares]
        waiting, count = found.where("folder is not null").select("folder"), sum(r.left for r in done)
    return place, plans


def read_range(system: pa.fs.FileSystem, path: str, start: int, stop: int) -> bytes:
    """The lines that begin between two offsets: whatever stands before the first line end belongs to the range before, and the last line is read to its end."""
    with system.open_input_file(path) as handle:
        size = handle.size()
        if start:
            start = _after_line_end(handle, start - 1, size)
        stop = _after_line_end(handle, stop - 1, size) if 0 < stop < size else stop
        return handle.read_at(max(0, stop - start), start) if start < stop else b""


def _after_line_end(handle, at: int, size: int) -> int:
    """The place behind the first line end from ``at`` on; the end of the file if there is none."""
    while at < size:
        found = handle.read_at(min(_STEP, size - at), at).find(b"\n")
        if found >= 0:
            return at + found + 1
        at += _STEP
    return size


class _Share(InputPartition):
    def __init__(self, pieces: list[tuple[str, int, int, int]]) -> None:
        super().__init__(pieces)


class FilesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.range_bytes, self.task_bytes = int(options.get("rangebytes", RANGE_BYTES)), int(options.get("taskbytes", TASK_BYTES))
        self.extensions = options["extensions"].split(",") if options.get("extensions") else list(cat.SCAN_EXTENSIONS)
        self.skipped, self.unread = list(cat.IGNORED_DIRECTORIES), list(cat.BINARY_EXTENSIONS)

    def partitions(self) -> list[InputPartition]:
        """One task for each share of the bytes. Weight files are listed and not read."""
        sized = ((path, 0 if _suffix(path.rpartition("/")[2]) in self.unread else size) for path, size in list_files(self.folder, self.extensions, self.skipped))
        return [_Share(pieces) for pieces in plan(sized, self.range_bytes, self.task_bytes)] or [_Share([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from _read(opened(self.folder)[0], partition.value, self.unread)


def _read(system: pa.fs.FileSystem, pieces: Iterable[tuple[str, int, int, int]], unread: list[str]) -> Iterator[pa.RecordBatch]:
    paths, parts, contents, held = [], [], [], 0
    for path, part, start, stop in pieces:
        try:
            content = None if _suffix(path.rpartition("/")[2]) in unread else read_range(system, path, start, stop)
        except OSError:
            content = None
        paths.append(path)
        parts.append(part)
        contents.append(content)
        held += len(content or b"")
        if held >= _BATCH or len(paths) >= _ROWS:
            yield _batch(paths, parts, contents)
            paths, parts, contents, held = [], [], [], 0
    if paths:
        yield _batch(paths, parts, contents)


def _batch(paths: list[str], parts: list[int], contents: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(parts, pa.int32()), pa.array(contents, pa.binary())], names=["path", "part", "content"])


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> FilesReader:
        return FilesReader({k.lower(): v for k, v in self.options.items()})


def read_chunks(spark: SparkSession, folder: str, extensions: list[str] | None = None, range_bytes: int = RANGE_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Files below a folder as ``path, target, part, content`` with text as content; ``operators.chunks`` scans them. The folder is listed at once, the files are read whenever the rows are."""
    unread = list(cat.BINARY_EXTENSIONS)
    place, plans = _planned(spark, folder, list(extensions or cat.SCAN_EXTENSIONS), range_bytes, task_bytes)
    firsts = [0, *accumulate(count for _, count in plans)]

    def read_shares(batches):
        system, (store, top) = opened(folder)[0], opened(place)
        for share in (i for batch in batches for i in batch.column(0).to_pylist()):
            at = bisect_right(firsts, share) - 1
            with store.open_input_file(f"{top}/{plans[at][0]}") as handle:
                pieces = pa.ipc.open_file(handle).get_batch(share - firsts[at]).to_pydict()
            yield from _read(system, zip(*pieces.values()), unread)

    rows = spark.range(0, firsts[-1], 1, max(1, firsts[-1])).mapInArrow(read_shares, _SCHEMA)  # a task a share
    return rows.select("path", F.lit(folder).alias("target"), "part", decode_text(F.col("content")).alias("content"))
