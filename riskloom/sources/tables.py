"""Corpora from tables: files, their filters and their lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import normalize_newlines, split_lines, strip
from ..operators.joins import is_bounded, join_per_scan
from ..storage import materialize

IGNORE_FILE = ".riskloomignore"


def as_corpus(df: DataFrame, *, path: Column, content: Column, scan_id: Column, keep: Iterable[str] = ()) -> DataFrame:
    """Any table with an id and a text is a corpus ``(scan_id, path, content)``."""
    return df.select(
        scan_id.cast("string").alias("scan_id"),
        path.cast("string").alias("path"),
        content.alias("content"),
        *keep,
    )


def filter_excluded_dirs(files: DataFrame, exclude: Iterable[str] | None = None) -> DataFrame:
    """Drop files below an excluded directory. A list of your own replaces the defaults."""
    names = paths.EXCLUDED_DIRS if exclude is None else tuple(exclude)
    return files.filter(~paths.in_excluded_dir(F.col("path"), names)) if names else files


def filter_hidden_dirs(files: DataFrame) -> DataFrame:
    return files.filter(~paths.in_hidden_dir(F.col("path")))


def filter_binary_ext(files: DataFrame) -> DataFrame:
    return files.filter(~paths.has_binary_suffix(F.col("path")))


def filter_max_size(files: DataFrame, max_bytes: int = paths.MAX_FILE_BYTES) -> DataFrame:
    return files.filter(F.octet_length("content") <= max_bytes)


def filter_utf8(files: DataFrame, raw: str = "content") -> DataFrame:
    """Drop files whose bytes are not UTF-8 and turn the others into text."""
    text = F.col(raw).cast("string")
    return files.filter(F.is_valid_utf8(text)).withColumn(raw, text)


def parse_ignore_files(files: DataFrame, name: str = IGNORE_FILE) -> DataFrame:
    """Entries of the ignore file at the root of each scan, as ``(scan_id, kind, name)``.

    Blank lines and comments are skipped. A name with a dot that does not end in a slash
    is a file, everything else a directory.
    """
    lines = F.transform(split_lines(normalize_newlines(F.col("content"))), strip)
    entries = files.filter(F.col("path") == name).select("scan_id", F.explode(lines).alias("entry"))
    last = F.regexp_extract(F.regexp_replace("entry", "/+$", ""), "[^/]*$", 0)
    is_file = last.contains(".") & (last != ".") & ~F.col("entry").endswith("/")
    return (
        entries.filter((F.col("entry") != "") & ~F.col("entry").startswith("#"))
        .select(
            "scan_id",
            F.when(is_file, F.lit("file")).otherwise(F.lit("dir")).alias("kind"),
            F.when(is_file, F.col("entry")).otherwise(F.regexp_replace("entry", "/+$", "")).alias("name"),
        )
        .distinct()
    )


def apply_ignores(files: DataFrame, ignores: DataFrame) -> DataFrame:
    """Drop files that an ignore file names, or that lie in a directory it names.

    The entries are stored once, as one row per scan, and measured there: within the bound of a
    broadcast no file content moves, beyond it files join by scan with large scans cut in parts.
    """
    per_scan = ignores.groupBy("scan_id").agg(
        F.collect_set(F.when(F.col("kind") == "dir", F.col("name"))).alias("_dirs"),
        F.collect_set(F.when(F.col("kind") == "file", F.col("name"))).alias("_names"),
    )
    per_scan = materialize(per_scan, "ignores")
    if is_bounded(per_scan):
        joined = files.join(F.broadcast(per_scan), "scan_id", "left")
    else:
        joined = join_per_scan(files, per_scan, how="left")
    none = F.array().cast("array<string>")
    below = F.arrays_overlap(paths.parent_dirs(F.col("path")), F.coalesce("_dirs", none))
    named = F.array_contains(F.coalesce("_names", none), F.element_at(F.split("path", "/"), -1))
    return joined.filter(~below & ~named).select(*files.columns)


def apply_corpus_filters(
    files: DataFrame, *, exclude: Iterable[str] | None = None, max_bytes: int = paths.MAX_FILE_BYTES
) -> DataFrame:
    """All path and size filters of a directory scan."""
    kept = filter_excluded_dirs(files, exclude)
    return filter_max_size(filter_binary_ext(filter_hidden_dirs(kept)), max_bytes)


def explode_lines(files: DataFrame) -> DataFrame:
    """One row per physical line, numbered from 1."""
    lines = split_lines(normalize_newlines(F.col("content")))
    return files.select("scan_id", "path", F.posexplode(lines).alias("_pos", "line")).select(
        "scan_id", "path", (F.col("_pos") + 1).alias("line_number"), "line"
    )


def files_scanned(files: DataFrame) -> DataFrame:
    return files.groupBy("scan_id").agg(F.count("*").alias("files_scanned"))
