"""Rules written as Python, for checks that no pattern can express."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import fingerprint
from ..rules.spec import RuleSpec
from .detect import FINDING_COLUMNS, rule_ordinals

Check = Callable[[str, str], Iterable[tuple[int, str]]]


def detect_with(files: DataFrame, rule: RuleSpec, check: Check) -> DataFrame:
    """Findings of a Python check ``(path, content) -> (line number, snippet) …``.

    Files pass in Arrow batches. Prefer a :class:`RuleSpec` with patterns, which stays in
    the JVM; this is for the rest.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (scan_id, path, line, snippet, pos)
                for scan_id, path, content in zip(batch["scan_id"], batch["path"], batch["content"])
                for pos, (line, snippet) in enumerate(check(path, content))
            ]
            yield pd.DataFrame(rows, columns=["scan_id", "file_path", "line_number", "snippet", "pos"])

    hits = files.select("scan_id", "path", "content").mapInPandas(
        run, "scan_id string, file_path string, line_number int, snippet string, pos int"
    )
    values = {
        "rule_id": rule.rule_id, "rule_name": rule.name, "severity": rule.severity_rank, "message": rule.why,
        "fix": rule.fix, "guide_url": rule.guide_url, "owasp_id": rule.owasp_id, "owasp_llm_id": rule.owasp_llm_id,
        "cwe_id": rule.cwe_id, "confidence": rule.confidence, "rule_ordinal": rule_ordinals([rule])[rule.rule_id],
    }
    columns = {
        name: F.lit(value).cast("int" if name in ("severity", "rule_ordinal") else "string") for name, value in values.items()
    }
    stamp = fingerprint(F.col("file_path"), F.col("rule_id"), F.col("snippet"))
    return hits.withColumns(columns).withColumn("fingerprint", stamp).select(*FINDING_COLUMNS)


def register_check(spark: SparkSession, name: str, check: Check) -> None:
    """Make a Python check a table function of SQL: ``FROM files, LATERAL name(path, content)``.

    It gives ``line_number, snippet, pos`` per hit, ``pos`` from 0 in the order of the check. Files pass in Arrow batches;
    a file without path or content has no hits.
    """

    class Checked:
        def eval(self, path: str, content: str):
            if path is not None and content is not None:
                for pos, (line, snippet) in enumerate(check(path, content)):
                    yield line, snippet, pos

    spark.udtf.register(name, F.udtf(Checked, returnType="line_number int, snippet string, pos int", useArrow=True))
