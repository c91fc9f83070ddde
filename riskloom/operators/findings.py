"""Order, search and enrich findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import parse_severities, severity_name, severity_rank, short_fingerprint, to_uri
from ..rules.spec import SEVERITY_RANK

# Where each category is described.
OWASP_URLS = {
    "A01:2021": "https://owasp.org/Top10/A01_2021-Broken_Access_Control.html",
    "A02:2021": "https://owasp.org/Top10/A02_2021-Cryptographic_Failures.html",
    "A03:2021": "https://owasp.org/Top10/A03_2021-Injection.html",
    "A04:2021": "https://owasp.org/Top10/A04_2021-Insecure_Design.html",
    "A05:2021": "https://owasp.org/Top10/A05_2021-Security_Misconfiguration.html",
    "A06:2021": "https://owasp.org/Top10/A06_2021-Vulnerable_and_Outdated_Components.html",
    "A07:2021": "https://owasp.org/Top10/A07_2021-Identification_and_Authentication_Failures.html",
    "A08:2021": "https://owasp.org/Top10/A08_2021-Software_and_Data_Integrity_Failures.html",
    "A09:2021": "https://owasp.org/Top10/A09_2021-Security_Logging_and_Monitoring_Failures.html",
    "A10:2021": "https://owasp.org/Top10/A10_2021-Server-Side_Request_Forgery.html",
}
OWASP_LLM_URL = "https://owasp.org/www-project-top-10-for-large-language-model/"

# Report level and numeric severity by rank, from INFO to CRITICAL.
SARIF_LEVELS = ("note", "note", "warning", "error", "error")
SECURITY_SEVERITY = ("0.0", "3.0", "5.0", "8.0", "9.0")


def result_order() -> list[Column]:
    """Worst first, then path and line; ties in rule order, then match order."""
    return [F.desc("severity"), F.asc("file_path"), F.asc("line_number"), F.asc("rule_ordinal"), F.asc("pos")]


def order_key() -> Column:
    """The result order inside a scan as one comparable struct."""
    return F.struct(
        (-F.col("severity")).alias("neg_severity"), "file_path", "line_number", "rule_ordinal", "pos"
    )


def order_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy("scan_id", *result_order())


def sort_findings(findings: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """User-chosen order. Severity ascends from the worst, as a report lists it."""
    if column == "severity":
        key = F.desc("severity") if ascending else F.asc("severity")
    else:
        key = F.asc(column) if ascending else F.desc(column)
    return findings.orderBy(key, "scan_id", *result_order())


def filter_by_severity(findings: DataFrame, raw: str | None) -> DataFrame:
    names = parse_severities(raw)
    return findings.filter(F.col("severity").isin(*[SEVERITY_RANK[n] for n in names])) if names else findings


def search(
    findings: DataFrame, *, severity: str | None = None, confidence: str | None = None, text: str | None = None
) -> DataFrame:
    """Exact severity, exact confidence, and a case-blind substring over the visible fields."""
    found = findings
    if severity:
        found = found.filter(F.col("severity") == SEVERITY_RANK[severity])
    if confidence:
        found = found.filter(F.col("confidence") == confidence)
    if text:
        hay = F.lower(F.concat("rule_id", "rule_name", "file_path", "message", "snippet"))
        found = found.filter(hay.contains(text.lower()))
    return found


def _by_rank(values: tuple[str, ...], rank: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), rank)


def sarif_level(rank: Column) -> Column:
    return _by_rank(SARIF_LEVELS, rank)


def security_severity(rank: Column) -> Column:
    return _by_rank(SECURITY_SEVERITY, rank)


def with_links(findings: DataFrame) -> DataFrame:
    """Add the pages that describe a finding's categories; empty where there is none."""
    urls = F.create_map(*[F.lit(part) for entry in OWASP_URLS.items() for part in entry])
    has_llm = F.coalesce(F.col("owasp_llm_id"), F.lit("")) != ""
    return findings.withColumns(
        {
            "owasp_url": F.coalesce(F.try_element_at(urls, F.col("owasp_id")), F.lit("")),
            "owasp_llm_url": F.when(has_llm, F.lit(OWASP_LLM_URL)).otherwise(F.lit("")),
        }
    )


def with_display(findings: DataFrame) -> DataFrame:
    """Add the names and short forms that reports show."""
    return findings.withColumns(
        {
            "severity_name": severity_name(F.col("severity")),
            "sarif_level": sarif_level(F.col("severity")),
            "security_severity": security_severity(F.col("severity")),
            "short_fingerprint": short_fingerprint(F.col("fingerprint")),
            "uri": to_uri(F.col("file_path")),
        }
    )


__all__ = [
    "filter_by_severity", "order_findings", "order_key", "result_order", "sarif_level", "search",
    "security_severity", "severity_rank", "sort_findings", "with_display", "with_links",
]
