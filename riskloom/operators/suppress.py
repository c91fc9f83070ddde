"""Suppressions: acknowledged findings, marked in reports and never hidden."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import join_uneven


def add_suppressions(suppressions: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Add entries whose fingerprint is not there yet; of equal new ones the first by date stays."""
    order = F.struct("date", "reviewer", "reason")
    columns = ["fingerprint", "reason", "reviewer", "date"]
    firsts = (
        new_rows.groupBy("fingerprint")
        .agg(F.min_by(F.struct("reason", "reviewer", "date"), order).alias("first"))
        .select("fingerprint", "first.*")
    )
    fresh = firsts.join(suppressions.select("fingerprint"), "fingerprint", "left_anti")
    return suppressions.select(*columns).unionByName(fresh.select(*columns))


def remove_suppressions(suppressions: DataFrame, fingerprints: DataFrame) -> DataFrame:
    return suppressions.join(fingerprints.select("fingerprint"), "fingerprint", "left_anti")


def removed_any(suppressions: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Per fingerprint to remove, whether there was an entry."""
    known = suppressions.select("fingerprint").distinct().withColumn("removed", F.lit(True))
    return (
        fingerprints.select("fingerprint").distinct().join(known, "fingerprint", "left").fillna({"removed": False})
    )


def suppressed(findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    return findings.join(suppressions.select("fingerprint"), "fingerprint", "left_semi")


def with_status(findings: DataFrame, changes: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Status of each finding: suppressed before new before existing.

    ``findings`` should be a stored table: a fingerprint that stands in very many scans, as of a
    copied file, is cut into parts for the join.
    """
    marked = suppressions.select("fingerprint").distinct().withColumn("_suppressed", F.lit(True))
    fresh = (
        changes.filter(F.col("status") == "new").select("scan_id", "fingerprint").distinct().withColumn("_new", F.lit(True))
    )
    status = (
        F.when(F.col("_suppressed"), F.lit("suppressed")).when(F.col("_new"), F.lit("new")).otherwise(F.lit("existing"))
    )
    return (
        join_uneven(findings, marked, "fingerprint", "left")
        .join(fresh, ["scan_id", "fingerprint"], "left")
        .withColumn("status", status)
        .drop("_suppressed", "_new")
    )


def suppressed_count(scans: DataFrame, findings: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Findings, not fingerprints, that are suppressed in each scan."""
    counts = suppressed(findings, suppressions.distinct()).groupBy("scan_id").agg(F.count("*").alias("n_suppressed"))
    return scans.select("scan_id").join(counts, "scan_id", "left").fillna({"n_suppressed": 0})
