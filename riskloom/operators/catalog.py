"""Views of the rule catalogue against a corpus."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..rules import CATALOG, RuleSpec
from .detect import rule_table


def applicable_files(files: DataFrame, rules: Iterable[RuleSpec] = CATALOG) -> DataFrame:
    """Per rule, how many files its path gate lets in. One pass over the paths only."""
    rules = tuple(rules)
    counts = files.agg(*[F.count_if(paths.gate(paths.gate_key(r), F.col("path"))).alias(r.rule_id) for r in rules])
    pairs = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.col(r.rule_id).alias("n_files")) for r in rules])
    return counts.select(F.inline(pairs))


def catalog_with_counts(findings: DataFrame, rules: Iterable[RuleSpec] = CATALOG) -> DataFrame:
    """Every rule of the catalogue with its number of findings, by id."""
    counts = findings.groupBy("rule_id").agg(F.count("*").alias("n_findings"))
    table = rule_table(findings.sparkSession, rules).drop("patterns", "rule_ordinal")
    return table.join(counts, "rule_id", "left").fillna({"n_findings": 0}).orderBy("rule_id")
