"""Report documents of many scans in one folder: ``format("riskloom_documents")``, written and read by Spark.

Tasks write their fragments, in order, to files of their own with an index beside each, and hand the driver
the name of the file only. A save counts from the moment the driver lists its files, in one step, so a document is there
whole or not at all, whatever executors were lost. The folder must be mounted on the driver and all executors.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "riskloom_documents"
SCHEMA = "scan_id string, part int, save string, file int, line long, fragment string"
_ARROW = pa.schema(
    [("scan_id", pa.string()), ("part", pa.int32()), ("save", pa.string()), ("file", pa.int32()), ("line", pa.int64()), ("fragment", pa.string())]
)
_BATCH_BYTES = 4 << 20
_BATCH_ROWS = 2_000


@dataclass
class DocumentFile(WriterCommitMessage):
    name: str
    file: int
    rows: int


@dataclass
class DocumentPart(InputPartition):
    save: str
    name: str
    file: int


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, root: str, replaces: bool):
        self.root, self.replaces = root, replaces
        self.save = f"{time.time_ns():020d}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> DocumentFile:
        number = TaskContext.get().partitionId()
        # Each attempt has a name of its own; only that of the attempt that counts is listed.
        name = f"{number:06d}-{uuid.uuid4().hex}"
        folder = os.path.join(self.root, "saves", self.save)
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, name)
        line = place = 0
        run: list | None = None  # scan, part, first byte, bytes, first line, lines
        with open(path + ".jsonl", "wb") as data, open(path + ".index", "w", encoding="utf-8") as index:
            for batch in iterator:
                columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("scan_id", "part", "fragment"))
                for scan, part, fragment in zip(*columns):
                    raw = (fragment or "").encode("utf-8", "surrogatepass") + b"\n"
                    if raw.find(b"\n") < len(raw) - 1:
                        raise ValueError("a fragment of a document is one line")
                    if run is None or run[:2] != [scan, part]:
                        if run is not None:
                            index.write(json.dumps(run) + "\n")
                        run = [scan, part, place, 0, line, 0]
                    data.write(raw)
                    place, line = place + len(raw), line + 1
                    run[3] += len(raw)
                    run[5] += 1
            if run is not None:
                index.write(json.dumps(run) + "\n")
        return DocumentFile(name, number, line)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [{"name": m.name, "file": m.file} for m in messages if m is not None and m.rows]
        folder = os.path.join(self.root, "listed")
        os.makedirs(folder, exist_ok=True)
        hidden = os.path.join(folder, "." + self.save)
        with open(hidden, "w", encoding="utf-8") as out:
            json.dump({"replaces": self.replaces, "files": sorted(files, key=lambda f: f["file"])}, out)
        os.replace(hidden, os.path.join(folder, self.save))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files of a save that is not listed are never read."""


class DocumentReader(DataSourceReader):
    def __init__(self, root: str, scan: str | None, index_only: bool):
        self.root, self.scan, self.index_only = root, scan, index_only

    def partitions(self) -> list[DocumentPart]:
        folder, out = os.path.join(self.root, "listed"), []
        for save in sorted(n for n in os.listdir(folder) if not n.startswith(".")) if os.path.isdir(folder) else []:
            with open(os.path.join(folder, save), encoding="utf-8") as file:
                listed = json.load(file)
            if listed["replaces"]:
                out = []
            out += [DocumentPart(save, f["name"], f["file"]) for f in listed["files"]]
        return out or [DocumentPart("", "", 0)]

    def read(self, partition: DocumentPart) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        path = os.path.join(self.root, "saves", partition.save, partition.name)
        rows: list[tuple] = []
        held = 0
        with open(path + ".index", encoding="utf-8") as index, open(path + ".jsonl", "rb") as data:
            for entry in index:
                scan, part, start, _, first, count = json.loads(entry)
                if self.scan is not None and scan != self.scan:
                    continue
                data.seek(start)
                for line in range(first, first + (1 if self.index_only else count)):
                    fragment = None if self.index_only else data.readline()[:-1].decode("utf-8", "surrogatepass")
                    rows.append((scan, part, partition.save, partition.file, line, fragment))
                    held += len(fragment or "")
                    if len(rows) >= _BATCH_ROWS or held >= _BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class DocumentSource(DataSource):
    """Options: ``path``; ``scan``, to read the documents of one scan; ``index`` ``true`` for a row per stretch and no fragments."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _root(self) -> str:
        path = self.options.get("path")
        if not path or "://" in path and not path.startswith("file://"):
            raise ValueError("documents are kept in a mounted folder, given as path")
        return os.path.abspath(path.removeprefix("file://").removeprefix("file:"))

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self._root(), overwrite)

    def reader(self, schema: StructType) -> DocumentReader:
        return DocumentReader(self._root(), self.options.get("scan"), self.options.get("index", "").lower() == "true")


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(DocumentSource)


def save_documents(fragments: DataFrame, path: str, mode: str = "append") -> None:
    """Save the documents of ``fragments(scan_id, part, order, fragment)``; a scan saved again is replaced.

    ``mode`` ``overwrite`` replaces all documents of the folder. A large scan is cut into ranges of its order,
    small ones share a file. Nothing is kept of a save that fails.
    """
    register(fragments.sparkSession)
    order = ["scan_id", "part", "order"]
    rows = fragments.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("scan_id", F.col("part").cast("int").alias("part"), F.lit("").alias("save"), F.lit(0).alias("file"),
                       F.lit(0).cast("long").alias("line"), "fragment")
    rows.write.format(FORMAT).mode(mode).save(path)


def read_documents(spark: SparkSession, path: str, scan: str | None = None) -> DataFrame:
    """``scan_id, part, file, line, fragment`` of the newest document of each scan; it reads in order of file and line.

    The newest save is found from the indexes. A file holds a bounded share of a scan, so the join by
    scan, save and file has no hot key. A folder without saves has no documents.
    """
    register(spark)
    source = spark.read.format(FORMAT)
    if scan is not None:
        source = source.option("scan", scan)
    stretches = source.option("index", "true").load(path).select(F.struct("scan_id").alias("of"), "save", "file").distinct()
    newest = stretches.groupBy("of").agg(F.max("save").alias("save"))
    wanted = stretches.join(newest, ["of", "save"])
    rows = source.option("index", "false").load(path).withColumn("of", F.struct("scan_id"))
    return rows.join(wanted, ["of", "save", "file"]).select("scan_id", "part", "file", "line", "fragment")
