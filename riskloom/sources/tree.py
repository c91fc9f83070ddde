"""Corpora from directories, hidden names included.

Spark's own file listing drops names that start with a dot or an underscore, and those are
the names some rules look for. The directory must be reachable from every executor, for
example on a shared mount.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..storage import materialize
from .tables import IGNORE_FILE

_LISTED = "path string, size long, problem string"
_LEVEL = "path string, is_dir boolean, size long, problem string"
_READ = "scan_id string, path string, content binary, size long, problem string"
_BATCH_BYTES = 16 << 20
_BATCH_ROWS = 10_000


def _is_skipped_dir(name: str, exclude: frozenset[str]) -> bool:
    hidden = name.startswith(".") and name != ".github"
    return name in exclude or hidden or name.endswith(".egg-info")


def _children(root: str, folder: str, exclude: frozenset[str] | None) -> Iterator[tuple[str, bool, int, str | None]]:
    """``(relative path, is directory, size, problem)`` of the entries of one folder, as they are read."""
    try:
        with os.scandir(os.path.join(root, folder)) as entries:
            for entry in entries:
                name = f"{folder}/{entry.name}" if folder else entry.name
                try:
                    if entry.is_dir():
                        if exclude is None or not _is_skipped_dir(entry.name, exclude):
                            yield name, True, 0, None
                    elif entry.is_file():
                        yield name, False, entry.stat().st_size, None
                except OSError as error:
                    yield name, False, 0, f"unreadable: {error.strerror}"
    except OSError as error:
        yield folder or ".", False, 0, f"unreadable: {error.strerror}"


def list_tree(spark: SparkSession, root: str, *, exclude: Iterable[str] | None = paths.EXCLUDED_DIRS) -> DataFrame:
    """``(path, size, problem)`` of the files below ``root``; excluded directories are not entered.

    One job per level of folders: tasks list them entry by entry, folders of the next level are
    dealt out again, and the driver holds no names. A folder or file that cannot be read is a row
    with its problem.
    """
    banned = None if exclude is None else frozenset(exclude)

    def list_folders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "is_dir", "size", "problem"]
        for batch in batches:
            rows: list[tuple] = []
            for folder in batch["folder"]:
                for row in _children(root, folder, banned):
                    rows.append(row)
                    if len(rows) == _BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    level = spark.createDataFrame([("",)], "folder string")
    listed = []
    while True:
        found = materialize(level.repartition("folder").mapInPandas(list_folders, _LEVEL), "listing")
        listed.append(found.filter("not is_dir").drop("is_dir"))
        level = found.filter("is_dir").select(F.col("path").alias("folder"))
        if level.isEmpty():
            return reduce(DataFrame.union, listed)


def _read_ignore_file(root: str) -> tuple[set[str], set[str]]:
    folders: set[str] = set()
    names: set[str] = set()
    try:
        with open(os.path.join(root, IGNORE_FILE), encoding="utf-8") as source:
            entries = [line.strip() for line in source]
    except FileNotFoundError:
        return folders, names
    except (OSError, UnicodeDecodeError) as problem:
        raise ValueError(f"cannot read {IGNORE_FILE} in {root}: what it leaves out is unknown") from problem
    for entry in entries:
        if entry and not entry.startswith("#"):
            if "." in os.path.basename(entry.rstrip("/")) and not entry.endswith("/"):
                names.add(entry)
            else:
                folders.add(entry.rstrip("/"))
    return folders, names


def read_tree(
    spark: SparkSession,
    path: str,
    *,
    scan_id: str = "scan",
    exclude: Iterable[str] | None = None,
    max_bytes: int | None = paths.MAX_FILE_BYTES,
    apply_filters: bool = True,
) -> DataFrame:
    """Files below a directory, or one file, as ``(scan_id, path, content, size, problem)``.

    ``problem`` says why a file has no content: it is too large, not UTF-8, or unreadable. Files
    that a filter on names leaves out are no rows. The listing is shuffled by path before reading,
    so one huge folder spreads over all tasks. A single file is read whatever its name and size;
    a missing path gives no rows.
    """
    if "://" in path and not path.startswith("file://"):
        raise ValueError("a directory scan needs a mounted folder; read other stores as a table")
    root = os.path.abspath(path.removeprefix("file://").removeprefix("file:"))
    if os.path.isfile(root):
        listed = spark.createDataFrame([(os.path.basename(root), os.path.getsize(root), None)], _LISTED)
        root = os.path.dirname(root)
    elif not os.path.exists(root):
        listed = spark.createDataFrame([], _LISTED)
    else:
        ignored_dirs, ignored_names = _read_ignore_file(root)
        banned = set(paths.EXCLUDED_DIRS if exclude is None else exclude) | ignored_dirs
        listed = list_tree(spark, root, exclude=banned if apply_filters else None)
        if apply_filters:
            listed = listed.filter(~paths.has_binary_suffix(F.col("path")))
            if max_bytes is not None:
                large = F.col("problem").isNull() & (F.col("size") > max_bytes)
                listed = listed.withColumn("problem", F.when(large, F.lit("too large")).otherwise(F.col("problem")))
            if ignored_names:
                listed = listed.filter(~F.element_at(F.split("path", "/"), -1).isin(*sorted(ignored_names)))

    def read_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["scan_id", "path", "content", "size", "problem"]
        for batch in batches:
            rows, held = [], 0
            for name, size, problem in zip(batch["path"], batch["size"], batch["problem"]):
                content = None
                if problem is None:
                    try:
                        with open(os.path.join(root, name), "rb") as source:
                            content = source.read()
                    except OSError as error:
                        problem = f"unreadable: {error.strerror}"
                rows.append((scan_id, name, content, size, problem))
                held += len(content or b"")
                if held >= _BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    read = listed.repartition("path").mapInPandas(read_files, _READ)
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    problem = F.coalesce("problem", F.when(~valid, F.lit("not UTF-8")))
    return read.select("scan_id", "path", F.when(valid, text).alias("content"), "size", problem.alias("problem"))


def read_corpus(spark: SparkSession, path: str, *, on_error: str = "raise", **options) -> DataFrame:
    """Text files below a directory, or one file, as ``(scan_id, path, content, size)``.

    Takes the options of :func:`read_tree`. Files that are too large or not UTF-8 are left out;
    :func:`left_out` counts them. An unreadable file or folder fails the scan, so a passing fault
    cannot pass for a clean corpus, unless ``on_error`` is ``"skip"``.
    """
    tree = read_tree(spark, path, **options)
    if on_error == "raise":
        bad = F.col("problem").startswith("unreadable")
        failure = F.raise_error(F.concat(F.lit("cannot read "), F.col("path"), F.lit(": "), F.col("problem"))).cast("boolean")
        tree = tree.filter(F.when(bad, failure).otherwise(F.col("problem").isNull()))
    else:
        tree = tree.filter("problem is null")
    return tree.drop("problem")


def left_out(tree: DataFrame) -> DataFrame:
    """Files of :func:`read_tree` without content, by scan and problem."""
    return tree.filter("problem is not null").groupBy("scan_id", "problem").agg(F.count("*").alias("n_files"))
