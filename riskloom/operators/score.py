"""Counts, scores and rollups.

Everything aggregates findings with partial sums before the shuffle, so a scan that holds
most of the findings costs one row per task. Scores start from the scans, because a clean
scan has no findings and scores 100.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules.spec import SEVERITIES, SEVERITY_RANK
from .findings import order_key

# Deduction per finding and most that one severity may deduct.
WEIGHTS = {"CRITICAL": 25, "HIGH": 10, "MEDIUM": 5, "LOW": 2, "INFO": 0}
CAPS = {"CRITICAL": 75, "HIGH": 40, "MEDIUM": 25, "LOW": 10, "INFO": 0}

# Least score, colour, text, short text.
LABELS = (
    (90, "GREEN", "Ready to deploy", "READY"),
    (70, "YELLOW", "Fix HIGH items before deploying", "FIX HIGH"),
    (40, "ORANGE", "Significant security issues. Do not deploy to production.", "ISSUES"),
    (0, "RED", "Critical vulnerabilities. Stop and fix before shipping.", "CRITICAL"),
)


def _count_columns() -> list[Column]:
    return [
        F.count_if(F.col("severity") == SEVERITY_RANK[name]).alias(f"n_{name.lower()}") for name in SEVERITIES
    ]


def severity_counts(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per scan with a count per severity, zeros included."""
    counts = findings.groupBy("scan_id").agg(*_count_columns())
    zero = {f"n_{name.lower()}": 0 for name in SEVERITIES}
    return scans.join(counts, "scan_id", "left").fillna(zero)


def _deduction(name: str) -> Column:
    return F.least(F.col(f"n_{name.lower()}") * WEIGHTS[name], F.lit(CAPS[name])).cast("int")


def score_column() -> Column:
    total = sum((_deduction(name) for name in SEVERITIES), F.lit(0))
    return F.greatest(F.lit(0), F.lit(100) - total).cast("int")


def label_column(score: Column, field: int) -> Column:
    label = F.lit(LABELS[-1][field])
    for entry in reversed(LABELS[:-1]):
        label = F.when(score >= entry[0], F.lit(entry[field])).otherwise(label)
    return label


def score(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Scans with counts, score, colour and label."""
    counted = severity_counts(scans, findings).withColumn("score", score_column())
    return counted.withColumns(
        {
            "label": label_column(F.col("score"), 1),
            "label_text": label_column(F.col("score"), 2),
            "label_short": label_column(F.col("score"), 3),
        }
    )


def score_breakdown(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Five rows per scan: count, weight, raw deduction, cap, applied deduction."""
    counted = severity_counts(scans.select("scan_id"), findings)
    rows = [
        F.struct(
            F.lit(SEVERITY_RANK[name]).alias("severity"),
            F.lit(name).alias("severity_name"),
            F.col(f"n_{name.lower()}").alias("count"),
            F.lit(WEIGHTS[name]).alias("weight"),
            (F.col(f"n_{name.lower()}") * WEIGHTS[name]).alias("raw_deduction"),
            F.lit(CAPS[name]).alias("cap"),
            _deduction(name).alias("applied_deduction"),
        )
        for name in SEVERITIES
    ]
    return counted.select("scan_id", F.inline(F.array(*rows)))


def breakdown_map() -> Column:
    """The breakdown as a struct keyed by severity name, for report documents."""
    return F.struct(
        *[
            F.struct(
                F.col(f"n_{name.lower()}").alias("count"),
                F.lit(WEIGHTS[name]).alias("weight"),
                (F.col(f"n_{name.lower()}") * WEIGHTS[name]).alias("raw_deduction"),
                F.lit(CAPS[name]).alias("cap"),
                _deduction(name).alias("applied_deduction"),
            ).alias(name)
            for name in SEVERITIES
        ]
    )


def summary_struct() -> Column:
    """Total and count per severity, worst first."""
    names = list(reversed(SEVERITIES))
    total = sum((F.col(f"n_{n.lower()}") for n in names[1:]), F.col(f"n_{names[0].lower()}"))
    return F.struct(total.alias("total"), *[F.col(f"n_{n.lower()}").alias(n.lower()) for n in names])


def summary(scans: DataFrame, findings: DataFrame) -> DataFrame:
    return severity_counts(scans.select("scan_id"), findings).select("scan_id", summary_struct().alias("s")).select(
        "scan_id", "s.*"
    )


def rollup(findings: DataFrame, *dims: str) -> DataFrame:
    """Counts for every prefix of ``dims``; a null dimension is a subtotal."""
    return findings.rollup(*dims).agg(
        F.count("*").alias("n_findings"), F.max("severity").alias("worst_severity"), F.grouping_id().alias("level")
    )


def rule_by_severity(findings: DataFrame) -> DataFrame:
    """Rules against severities as columns."""
    return findings.groupBy("rule_id").agg(F.count("*").alias("n_total"), *_count_columns())


def findings_by_severity(findings: DataFrame) -> DataFrame:
    """Group sizes of a report, worst group first."""
    return findings.groupBy("scan_id", "severity").agg(
        F.count("*").alias("n_findings"),
        F.countDistinct("rule_id").alias("n_rules"),
        F.min(order_key())["file_path"].alias("first_path"),
    )


def top_rules(findings: DataFrame, k: int = 10) -> DataFrame:
    counts = findings.groupBy("rule_id", "rule_name").agg(F.count("*").alias("n_findings"))
    return counts.orderBy(F.desc("n_findings"), "rule_id").limit(k)


def rules_fired(findings: DataFrame) -> DataFrame:
    """Per scan and rule, the first finding in result order. A minimum, not a sort per scan."""
    rest = [c for c in findings.columns if c not in ("scan_id", "rule_id")]
    first = F.min_by(F.struct(*rest), order_key())
    return findings.groupBy("scan_id", "rule_id").agg(first.alias("first")).select("scan_id", "rule_id", "first.*")
