"""Package names in requirement files against a list of bad names held as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.identity import normalize_package
from ..functions.text import java_regex, strip
from ..rules.dependencies import ALIASES, DENYLIST

NAME = r"^([A-Za-z][A-Za-z0-9_\-\.]*)\s*(?:[=<>!~]|$)"


def denylist_table(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(DENYLIST.items()), "typo string, legit string")
    return rows.withColumn("typo_norm", normalize_package(F.col("typo")))


def alias_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name,) for name in ALIASES], "alias string")


def requirement_files(files: DataFrame) -> DataFrame:
    """Files whose lines may name a requirement; by path, before any line is cut."""
    return files.filter(paths.gate(("denylist_requirements", ()), F.col("path")))


def requirement_names(lines: DataFrame) -> DataFrame:
    """Named requirements among lines of ``(scan_id, path, line_number, line)``."""
    text = strip(F.col("line"))
    name = F.regexp_extract(text, java_regex(NAME, True), 1)
    named = lines.filter(~text.startswith("#")).withColumn("package", name).filter(F.col("package") != "")
    return named.withColumn("package_norm", normalize_package(F.col("package"))).drop("line")


def skip_aliases(names: DataFrame, aliases: DataFrame) -> DataFrame:
    return names.join(aliases, names["package_norm"] == aliases["alias"], "left_anti")


def denied(names: DataFrame, denylist: DataFrame) -> DataFrame:
    """Names on the list."""
    return names.join(denylist, names["package_norm"] == denylist["typo_norm"]).drop("typo_norm")
