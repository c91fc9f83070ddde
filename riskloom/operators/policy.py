"""Profiles and gates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import CATALOG
from ..rules.spec import SEVERITY_RANK
from .history import diff_consecutive

# Families that a profile may choose from; rules of any other family are a user's own and always stay.
FAMILIES = tuple(sorted({rule.category for rule in CATALOG}))


def apply_profile(findings: DataFrame, profiles: DataFrame, name: str | None = None) -> DataFrame:
    """Findings as a profile sees them: severity overrides, least severity, rule prefixes.

    A profile without prefixes keeps all rules; one with prefixes keeps the catalogue's rules whose
    id starts with any of them, and rules of other families. Profiles are unfolded to one row per
    family and joined on it, so the join is an equality. Without ``name`` every profile is applied
    and ``profile`` tells them apart; a name that no profile has is an error.
    """
    if name is not None:
        profiles = profiles.filter(F.col("name") == name)
        if profiles.isEmpty():
            raise ValueError(f"no profile is named {name!r}")
    family = F.regexp_extract("rule_id", "^[A-Z]+", 0)
    base = profiles.select(
        F.col("name").alias("profile"),
        F.col("min_severity").alias("_min"),
        F.col("severity_overrides").alias("_overrides"),
        F.col("enabled_rule_prefixes").alias("_prefixes"),
        F.explode(F.array(*[F.lit(f) for f in (*FAMILIES, "")])).alias("_family"),
    )
    known = findings.withColumn("_family", F.when(family.isin(*FAMILIES), family).otherwise(F.lit("")))
    chosen = F.exists("_prefixes", lambda prefix: F.col("rule_id").startswith(prefix))
    every = F.col("_prefixes").isNull() | (F.size("_prefixes") == 0) | (F.col("_family") == "")
    rank = F.coalesce(F.try_element_at("_overrides", F.col("rule_id")), F.col("severity"))
    return (
        known.join(base, "_family")
        .filter(every | chosen)
        .withColumn("base_severity", F.col("severity"))
        .withColumn("severity", rank)
        .filter(F.col("severity") >= F.col("_min"))
        .drop("_min", "_overrides", "_prefixes", "_family")
    )


def _fails(fail_on: Iterable[str]):
    return F.col("severity").isin(*[SEVERITY_RANK[name] for name in fail_on])


def gate(scans: DataFrame, findings: DataFrame, fail_on: Iterable[str] = ("CRITICAL", "HIGH")) -> DataFrame:
    """Whether each scan has a finding of a failing severity. Suppressed findings still fail."""
    failed = findings.groupBy("scan_id").agg(F.max(_fails(fail_on)).alias("failed"))
    return scans.select("scan_id").join(failed, "scan_id", "left").fillna({"failed": False})


def gate_new_only(
    scans: DataFrame, findings: DataFrame, fail_on: Iterable[str] = ("CRITICAL", "HIGH"), project: str = "project"
) -> DataFrame:
    """As :func:`gate`, but only for findings that the scan before did not have.

    A first scan has no past, so all its findings are new.
    """
    new = diff_consecutive(scans, findings, project).filter(F.col("status") == "new")
    return gate(scans, findings.join(new, ["scan_id", "fingerprint"], "left_semi"), fail_on)
