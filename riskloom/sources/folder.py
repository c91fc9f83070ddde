"""Directories as a data source: ``spark.read.format("riskloom_folder")`` and ``spark.readStream`` of the same name.

Call :func:`register` once per session. Names that start with a dot or an underscore, which Spark's
own file sources drop, are files like any other. The folder must be mounted on the driver and all executors.
"""

from __future__ import annotations

import os
import time
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
    StringStartsWith,
)
from pyspark.sql.types import StructType

from ..functions import paths
from .tree import _is_skipped_dir, _read_ignore_file

FORMAT = "riskloom_folder"
SCHEMA = "path string, size long, changed_at timestamp, content string, problem string"
_ARROW = pa.schema(
    [("path", pa.string()), ("size", pa.int64()), ("changed_at", pa.timestamp("us", "UTC")), ("content", pa.string()), ("problem", pa.string())]
)
FILES_PER_PARTITION = 2_000
_BATCH_BYTES = 8 << 20
_BATCH_ROWS = 2_000


@dataclass
class FolderPart(InputPartition):
    """The files of one folder whose names fall on ``share`` of ``shares``, changed after ``after`` up to ``until``."""

    folder: str
    share: int
    shares: int
    after: int | None = None
    until: int | None = None


class FolderFiles:
    """Listing and reading of one directory; travels to the tasks.

    Options: ``path``; ``exclude``, names of folders that are not entered, comma-separated, instead of the usual ones;
    ``filters`` ``false`` to keep folders and file types that a scan leaves out; ``maxBytes``, beyond which a file has no
    content; ``filesPerPartition``.
    """

    def __init__(self, options: dict[str, str]):
        options = {name.lower(): value for name, value in options.items()}
        if "path" not in options:
            raise ValueError("the folder to read is given as path")
        path = options["path"]
        if "://" in path and not path.startswith("file://"):
            raise ValueError("a directory scan needs a mounted folder; read other stores as a table")
        self.root = os.path.abspath(path.removeprefix("file://").removeprefix("file:"))
        self.filtered = options.get("filters", "true").lower() != "false"
        self.max_bytes = int(options.get("maxbytes", paths.MAX_FILE_BYTES))
        self.per_part = int(options.get("filesperpartition", FILES_PER_PARTITION))
        ignored_dirs, self.ignored_names = _read_ignore_file(self.root) if self.filtered else (set(), set())
        named = options.get("exclude")
        usual = paths.EXCLUDED_DIRS if named is None else [n.strip() for n in named.split(",") if n.strip()]
        self.exclude = frozenset(usual) | ignored_dirs
        self.suffixes: list[str] = []  # of pushed filters: all hold
        self.prefixes: list[str] = []
        self.names: list[frozenset[str]] = []
        self.sizes: list[tuple[type, int]] = []

    def push(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take over what names and sizes decide; the rest stays with Spark."""
        for f in filters:
            column, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if column == ("path",) and isinstance(f, StringEndsWith):
                self.suffixes.append(value)
            elif column == ("path",) and isinstance(f, StringStartsWith):
                self.prefixes.append(value)
            elif column == ("path",) and isinstance(f, (EqualTo, In)):
                self.names.append(frozenset([value] if isinstance(f, EqualTo) else value))
            elif column == ("size",) and isinstance(f, (LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.sizes.append((type(f), value))
            else:
                yield f

    def _may_hold(self, folder: str) -> bool:
        """Whether files below a folder can pass the filters on names."""
        start = folder + "/" if folder else ""
        prefixes = all(start.startswith(p) or p.startswith(start) for p in self.prefixes)
        return prefixes and all(any(n.startswith(start) for n in names) for names in self.names)

    def _wanted(self, name: str) -> bool:
        base = name.rsplit("/", 1)[-1]
        if self.filtered and (base in self.ignored_names or os.path.splitext(base)[1].lower() in paths.BINARY_SUFFIXES):
            return False
        return (
            all(name.endswith(s) for s in self.suffixes)
            and all(name.startswith(p) for p in self.prefixes)
            and all(name in names for names in self.names)
        )

    def _fits(self, size: int) -> bool:
        tests = {
            LessThan: int.__lt__, LessThanOrEqual: int.__le__, GreaterThan: int.__gt__,
            GreaterThanOrEqual: int.__ge__, EqualTo: int.__eq__,
        }
        return all(tests[kind](size, value) for kind, value in self.sizes)

    def folders(self) -> Iterator[tuple[str, int, int]]:
        """``(folder, files, newest change)`` of the folders that are entered; names are counted and not kept."""
        left = [""]
        while left:
            folder = left.pop()
            n, newest = 0, 0
            try:
                with os.scandir(os.path.join(self.root, folder)) as entries:
                    for entry in entries:
                        name = f"{folder}/{entry.name}" if folder else entry.name
                        try:
                            if entry.is_dir():
                                if not (self.filtered and _is_skipped_dir(entry.name, self.exclude)) and self._may_hold(name):
                                    left.append(name)
                            elif entry.is_file() and self._wanted(name):
                                n += 1
                                newest = max(newest, entry.stat().st_ctime_ns)
                        except OSError:
                            n += 1  # the task that reads it reports it
            except FileNotFoundError:
                continue
            except OSError:
                n = 1
            if n:
                yield folder, n, newest

    def parts(self, after: int | None = None, until: int | None = None) -> list[FolderPart]:
        out = []
        for folder, n, newest in self.folders():
            if after is None or newest > after:
                shares = -(-n // self.per_part)
                out += [FolderPart(folder, k, shares, after, until) for k in range(shares)]
        return out

    def read(self, part: FolderPart) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for row in self._rows(part):
            rows.append(row)
            held += len(row[3] or "")
            if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    def _rows(self, part: FolderPart) -> Iterator[tuple]:
        try:
            with os.scandir(os.path.join(self.root, part.folder)) as entries:
                for entry in entries:
                    name = f"{part.folder}/{entry.name}" if part.folder else entry.name
                    if zlib.crc32(entry.name.encode("utf-8", "surrogateescape")) % part.shares != part.share:
                        continue
                    try:
                        if not entry.is_file() or not self._wanted(name):
                            continue
                        stat = entry.stat()
                    except OSError as error:
                        yield name, None, None, None, f"unreadable: {error.strerror}"
                        continue
                    if part.until is not None and not (part.after or 0) < stat.st_ctime_ns <= part.until:
                        continue
                    if self._fits(stat.st_size):
                        yield (name, stat.st_size, stat.st_ctime_ns // 1000, *self._content(name, stat.st_size))
        except OSError as error:
            if part.share == 0:
                yield part.folder or ".", None, None, None, f"unreadable: {error.strerror}"

    def _content(self, name: str, size: int) -> tuple[str | None, str | None]:
        if size > self.max_bytes:
            return None, "too large"
        try:
            with open(os.path.join(self.root, name), "rb") as source:
                return source.read().decode("utf-8"), None
        except UnicodeDecodeError:
            return None, "not UTF-8"
        except OSError as error:
            return None, f"unreadable: {error.strerror}"


class FolderReader(DataSourceReader):
    def __init__(self, files: FolderFiles):
        self.files = files

    def partitions(self) -> list[InputPartition]:
        return self.files.parts() or [FolderPart("", 0, 1)]

    def read(self, partition: FolderPart) -> Iterator[pa.RecordBatch]:
        return self.files.read(partition)


class FilteringFolderReader(FolderReader):
    """Takes filters on path and size over from Spark, so that folders and files they rule out are not opened."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return list(self.files.push(filters))


class FolderStreamReader(DataSourceStreamReader):
    """Files as they arrive, by the time the file system last changed them.

    An offset is a time: a batch holds the files changed after the one and up to the other. The end stays
    ``settleSeconds`` behind the clock, so a file that is still being written waits until it has been left alone
    for that long; one that changes again is read again. Moving a file into the folder counts as a change, whatever
    the time stamps it brought along.
    """

    def __init__(self, files: FolderFiles, settle: float):
        self.files = files
        self.settle = int(settle * 1e9)

    def initialOffset(self) -> dict:
        return {"changed_ns": 0}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - self.settle
        newest = 0
        for _, _, changed in self.files.folders():
            newest = max(newest, changed)
        # Without a change there is no new offset, and so no empty batch.
        return {"changed_ns": min(newest, settled)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if end["changed_ns"] <= start["changed_ns"]:
            return []
        return self.files.parts(start["changed_ns"], end["changed_ns"])

    def read(self, partition: FolderPart) -> Iterator[pa.RecordBatch]:
        return self.files.read(partition)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        pushed = self.options.get("pushFilters", "false").lower() == "true"
        return (FilteringFolderReader if pushed else FolderReader)(FolderFiles(dict(self.options)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FolderStreamReader(FolderFiles(dict(self.options)), float(self.options.get("settleSeconds", "2")))


def register(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(FolderSource)


def folder_files(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Files below a folder: :data:`SCHEMA`, with why a file has no content. Filters reach the listing.

    Spark 4.1 leaves the filters of one query with the relation when the next has none to push. Here each
    has one, as no path is null; with ``spark.read.format`` alone filters are pushed only where the option
    ``pushFilters`` asks for it, which suits relations that serve one query.
    """
    register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    given = {k: str(v) for k, v in options.items()} | {"pushFilters": "true"}
    return spark.read.format(FORMAT).options(**given).load(path).filter("path is not null")


def folder_stream(spark: SparkSession, path: str, *, scan_id: str = "scan", **options: object) -> DataFrame:
    """Text files as they arrive in a folder, as :func:`riskloom.streaming.scan.scan_stream` takes them.

    Files without content, too large, not UTF-8 or unreadable, are left out.
    """
    register(spark)
    rows = spark.readStream.format(FORMAT).options(**{k: str(v) for k, v in options.items()}).load(path)
    return rows.filter("problem is null").select(F.lit(scan_id).alias("scan_id"), "path", "content", F.col("changed_at").alias("arrived_at"))
