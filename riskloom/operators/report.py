"""Report documents.

A document of a scan may be larger than any one task should hold. So it is made of ordered
fragments: a head, one fragment per finding, a tail. Fragments are ordinary rows; written in
``(scan_id, part, order)`` they read as one JSON text per scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__
from ..functions.identity import severity_name, to_uri
from ..rules import CATALOG, RuleSpec
from .detect import rule_table
from .findings import order_key, sarif_level, security_severity, with_links
from ..storage import materialize
from .joins import join_per_scan
from .score import breakdown_map, rules_fired, score, summary_struct

TOOL = "riskloom"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"

HEAD, BODY, TAIL = 0, 1, 2
_KEEP_NULLS = {"ignoreNullFields": "false"}


def _text(value: Column) -> Column:
    """A JSON string literal."""
    return F.substring(F.to_json(F.array(value)), F.lit(2), F.length(F.to_json(F.array(value))) - 2)


def finding_struct() -> Column:
    """A finding as reports show it: severity by name, nulls kept."""
    return F.struct(
        "rule_id", "rule_name", severity_name(F.col("severity")).alias("severity"), "file_path", "line_number",
        "message", "fix", "snippet", "guide_url", "owasp_id", "owasp_llm_id", "cwe_id", "confidence", "fingerprint",
    )


def finding_json(findings: DataFrame) -> DataFrame:
    """One JSON object per finding: the line form of a report, for scans of any size."""
    return findings.select("scan_id", order_key().alias("order"), F.to_json(finding_struct(), _KEEP_NULLS).alias("document"))


def embed_json(findings: DataFrame) -> DataFrame:
    """Findings as JSON that is safe inside a script element."""
    row = F.struct(
        "rule_id", "rule_name", severity_name(F.col("severity")).alias("severity"), "file_path", "line_number",
        "message", "fix", "snippet", "fingerprint", F.coalesce("cwe_id", F.lit("")).alias("cwe_id"), "confidence",
        F.coalesce("owasp_id", F.lit("")).alias("owasp_id"), "owasp_url",
        F.coalesce("owasp_llm_id", F.lit("")).alias("owasp_llm_id"), "owasp_llm_url", "guide_url",
    )
    text = F.replace(F.to_json(row), F.lit("</"), F.lit("<\\/"))
    return with_links(findings).select("scan_id", order_key().alias("order"), text.alias("document"))


def _body(findings: DataFrame, text: Column) -> DataFrame:
    """Finding fragments with a comma in front of all but the first of a scan. They are stored once."""
    rows = materialize(findings.select("scan_id", order_key().alias("order"), text.alias("fragment")), "fragments")
    first = rows.groupBy("scan_id").agg(F.min("order").alias("_first"))
    comma = F.when(F.col("order") == F.col("_first"), F.lit("")).otherwise(F.lit(","))
    joined = join_per_scan(rows, first)
    return joined.select("scan_id", F.lit(BODY).alias("part"), "order", F.concat(comma, "fragment").alias("fragment"))


def _edge(scans: DataFrame, part: int, fragment: Column, like: DataFrame) -> DataFrame:
    order = F.lit(None).cast(like.schema["order"].dataType)
    return scans.select("scan_id", F.lit(part).alias("part"), order.alias("order"), fragment.alias("fragment"))


def report_json(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Fragments of one JSON report per scan: version, target, score, findings, summary."""
    scored = score(scans, findings)
    body = _body(findings, F.to_json(finding_struct(), _KEEP_NULLS))
    head = F.concat(
        F.lit('{"engine_version":"' + __version__ + '","target":'), _text(F.col("target")),
        F.lit(',"profile":'), _text(F.col("profile")),
        F.lit(',"files_scanned":'), F.col("files_scanned").cast("string"),
        F.lit(',"score":{"value":'), F.col("score").cast("string"),
        F.lit(',"breakdown":'), F.to_json(breakdown_map()), F.lit('},"findings":['),
    )
    tail = F.concat(F.lit('],"summary":'), F.to_json(summary_struct()), F.lit("}"))
    return _edge(scored, HEAD, head, body).unionByName(body).unionByName(_edge(scored, TAIL, tail, body))


# ---- SARIF ------------------------------------------------------------------------------


def sarif_result() -> Column:
    """One SARIF result. Null fields are left out, so properties appear only when set."""
    return F.struct(
        F.col("rule_id").alias("ruleId"),
        sarif_level(F.col("severity")).alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(
            F.struct(
                F.struct(
                    F.struct(to_uri(F.col("file_path")).alias("uri")).alias("artifactLocation"),
                    F.struct(
                        F.col("line_number").alias("startLine"), F.struct(F.col("snippet").alias("text")).alias("snippet")
                    ).alias("region"),
                ).alias("physicalLocation")
            )
        ).alias("locations"),
        F.struct(
            severity_name(F.col("severity")).alias("severity"),
            F.col("guide_url").alias("guideUrl"),
            F.col("fix").alias("recommendedFix"),
            F.col("snippet"),
            F.col("owasp_id").alias("owasp"),
            F.col("owasp_llm_id").alias("owasp-llm"),
            F.col("cwe_id").alias("cwe"),
            F.col("fingerprint"),
            F.col("confidence"),
        ).alias("properties"),
    )


def sarif_rule() -> Column:
    """One SARIF rule descriptor, from the first finding of the rule."""
    taxon = F.struct(
        F.replace("cwe_id", F.lit("CWE-"), F.lit("")).alias("id"),
        F.lit("").alias("guid"),
        F.struct(F.lit("CWE").alias("name"), F.lit("").alias("guid")).alias("toolComponent"),
    )
    relation = F.array(F.struct(taxon.alias("target"), F.array(F.lit("superset")).alias("kinds")))
    return F.struct(
        F.col("rule_id").alias("id"),
        F.col("rule_name").alias("name"),
        F.struct(F.col("rule_name").alias("text")).alias("shortDescription"),
        F.struct(F.col("message").alias("text")).alias("fullDescription"),
        F.struct(F.col("fix").alias("text")).alias("help"),
        F.struct(sarif_level(F.col("severity")).alias("level")).alias("defaultConfiguration"),
        F.struct(
            severity_name(F.col("severity")).alias("severity"),
            security_severity(F.col("severity")).alias("security-severity"),
            F.col("owasp_id").alias("owasp"),
            F.col("owasp_llm_id").alias("owasp-llm"),
            F.col("cwe_id").alias("cwe"),
        ).alias("properties"),
        F.col("guide_url").alias("helpUri"),
        F.when(F.col("cwe_id").isNotNull(), relation).alias("relationships"),
    )


def report_sarif(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Fragments of one SARIF 2.1.0 document per scan."""
    scored = score(scans, findings)
    body = _body(findings, F.to_json(sarif_result()))
    # At most one descriptor per rule of the catalogue, so this list is bounded.
    rules = (
        rules_fired(findings)
        .groupBy("scan_id")
        .agg(F.array_sort(F.collect_list(F.struct("rule_id", F.to_json(sarif_rule()).alias("text")))).alias("_rules"))
    )
    described = scored.join(rules, "scan_id", "left")
    rule_texts = F.array_join(F.transform("_rules", lambda r: r["text"]), ",")
    run = F.to_json(
        F.struct(
            F.col("target"),
            F.col("files_scanned").alias("filesScanned"),
            F.col("score"),
            breakdown_map().alias("scoreBreakdown"),
        )
    )
    head = F.concat(
        F.lit('{"$schema":"' + SARIF_SCHEMA + '","version":"2.1.0","runs":[{"tool":{"driver":{"name":"' + TOOL),
        F.lit('","version":"' + __version__ + '","rules":['),
        F.coalesce(rule_texts, F.lit("")),
        F.lit(']}},"automationDetails":{"id":"' + TOOL + '"},"properties":'),
        run,
        F.lit(',"results":['),
    )
    tail = F.lit("]}]}")
    return _edge(described, HEAD, head, body).unionByName(body).unionByName(_edge(described, TAIL, tail, body))


def write_documents(fragments: DataFrame, path: str, mode: str = "error") -> None:
    """Write fragments so that the files below ``scan_id=…``, read in name order, are the document.

    Range partitioning over the full order splits a large scan over many files.
    """
    order = ["scan_id", "part", "order"]
    (
        fragments.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("scan_id", F.col("fragment").alias("value"))
        .write.mode(mode)
        .partitionBy("scan_id")
        .option("lineSep", "\n")
        .text(path)
    )


def export_catalog(spark: SparkSession, rules: Iterable[RuleSpec] = CATALOG) -> DataFrame:
    """The rules as JSON objects in id order."""
    empty = F.lit("")
    row = F.struct(
        F.col("rule_id").alias("id"), F.col("rule_name").alias("name"), F.col("severity_name").alias("severity"),
        "description", "fix", F.coalesce("cwe_id", empty).alias("cwe_id"), F.coalesce("owasp_id", empty).alias("owasp_id"),
        F.coalesce("owasp_llm_id", empty).alias("owasp_llm_id"), "confidence", "guide_url", "file_extensions",
    )
    return rule_table(spark, rules).select("rule_id", F.to_json(row).alias("document")).orderBy("rule_id")
