"""Scan against scan: new, resolved and persistent findings, and the trend of scores.

Fingerprint sets are compared by one aggregation over ``(scan, fingerprint)``, which
partial-aggregates repeated fingerprints and spreads a hot scan over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize
from .joins import join_per_scan
from .score import label_column
from .sequence import with_neighbours


def distinct_fingerprints(findings: DataFrame) -> DataFrame:
    return findings.select("scan_id", "fingerprint").distinct()


def _status(in_current, in_previous):
    return (
        F.when(in_current & in_previous, F.lit("persistent"))
        .when(in_current, F.lit("new"))
        .otherwise(F.lit("resolved"))
    )


def diff(findings: DataFrame, previous_scan: str | None, current_scan: str) -> DataFrame:
    """Status of each fingerprint of two scans. Without a previous scan all are new."""
    two = findings.filter(F.col("scan_id").isin(*[s for s in (previous_scan, current_scan) if s is not None]))
    sides = two.groupBy("fingerprint").agg(
        F.max(F.col("scan_id") == current_scan).alias("_now"),
        F.max(F.col("scan_id") == F.lit(previous_scan)).alias("_before") if previous_scan is not None
        else F.lit(False).alias("_before"),
    )
    return sides.select("fingerprint", _status(F.col("_now"), F.col("_before")).alias("status"))


def _neighbours(scans: DataFrame, project: str) -> DataFrame:
    """Each scan with the scan before and after it. One small row per scan."""
    near = with_neighbours(scans.select(project, "scan_id", "saved_at"), project, ["saved_at", "scan_id"], ["scan_id"])
    return near.select(
        "scan_id", F.col("before.scan_id").alias("previous_scan"), F.col("after.scan_id").alias("next_scan")
    )


def diff_consecutive(scans: DataFrame, findings: DataFrame, project: str = "project") -> DataFrame:
    """Every scan against its predecessor: ``(scan_id, previous_scan, fingerprint, status)``.

    A fingerprint counts once for its own scan and once, as the past, for the next one. Each input
    is read once: what is used again is stored.
    """
    near = _neighbours(scans, project)
    held = join_per_scan(materialize(distinct_fingerprints(findings), "fingerprints"), near)
    now, before = F.lit(True).alias("_now"), F.lit(True).alias("_before")
    own = F.struct("scan_id", "previous_scan", now, F.lit(False).alias("_before"))
    past = F.struct(
        F.col("next_scan").alias("scan_id"), F.col("scan_id").alias("previous_scan"), F.lit(False).alias("_now"), before
    )
    sides = held.select("fingerprint", F.inline(F.array(own, past))).filter(F.col("scan_id").isNotNull())
    merged = sides.groupBy("scan_id", "previous_scan", "fingerprint").agg(
        F.max("_now").alias("_now"), F.max("_before").alias("_before")
    )
    status = _status(F.col("_now"), F.col("_before"))
    return merged.select("scan_id", "previous_scan", "fingerprint", status.alias("status"))


def diff_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("scan_id").agg(
        F.count_if(F.col("status") == "new").alias("n_new"),
        F.count_if(F.col("status") == "resolved").alias("n_resolved"),
        F.count_if(F.col("status") == "persistent").alias("n_persistent"),
    )


def latest_scans(scans: DataFrame, n: int = 1, project: str = "project") -> DataFrame:
    """The newest ``n`` scans per project. Spark prunes to ``n`` per task before the shuffle."""
    newest = Window.partitionBy(project).orderBy(F.desc("saved_at"), F.desc("scan_id"))
    return scans.withColumn("recency", F.row_number().over(newest)).filter(F.col("recency") <= n)


def score_trend(scored: DataFrame, project: str = "project") -> DataFrame:
    """Scores with the change from the scan before."""
    facts = scored.select(project, "scan_id", "saved_at", "score")
    return with_neighbours(facts, project, ["saved_at", "scan_id"], ["score"]).select(
        project,
        "scan_id",
        "saved_at",
        "score",
        (F.col("score") - F.col("before.score")).alias("delta"),
        label_column(F.col("score"), 3).alias("label_short"),
    )


def trend_caption(scored: DataFrame, project: str = "project") -> DataFrame:
    """Range and direction of a project's scores in one aggregation."""
    at = F.struct("saved_at", "scan_id")
    facts = scored.groupBy(project).agg(
        F.count("*").alias("n_scans"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.min_by("score", at).alias("first_score"),
        F.max_by("score", at).alias("last_score"),
    )
    flat = F.col("min_score") == F.col("max_score")
    arrow = (
        F.when(F.col("last_score") > F.col("first_score"), F.lit("↑"))
        .when(F.col("last_score") < F.col("first_score"), F.lit("↓"))
        .otherwise(F.lit("→"))
    )
    stable = F.format_string("→ Score stable at %d/100 across %d scans.", "min_score", "n_scans")
    moving = F.concat(
        arrow, F.format_string(" Based on %d scans. Score range: %d-%d", "n_scans", "min_score", "max_score")
    )
    caption = F.when(F.col("n_scans") > 1, F.when(flat, stable).otherwise(moving)).otherwise(F.lit(""))
    return facts.withColumns({"is_flat": flat, "caption": caption})
