"""Rules on windows of lines over a table of lines, so that a file of any length spreads over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from ..functions.identity import fingerprint
from ..functions.text import matches, strip
from ..rules import RuleSpec

BLOCK_LINES = 4096  # lines of a file that one group holds, besides those at its edges


def in_blocks(lines: DataFrame, before: int, after: int, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Cut each file of ``lines(scan_id, path, line_number, …)`` into blocks; add ``_block`` and ``_own``.

    A line stands in its own block and, not ``_own``, in each block that holds a line up to ``before``
    lines after it or ``after`` lines before it. So every window of a block's own lines lies in it whole, and
    a file brings few more rows than it has lines.
    """
    at = F.col("line_number").cast("long") - 1
    first = F.greatest(F.floor((at - after) / block_lines), F.lit(0).cast("long"))
    last = F.floor((at + before) / block_lines)
    spread = lines.select("*", F.explode(F.sequence(first, last)).alias("_block"))
    return spread.withColumn("_own", F.col("_block") == F.floor(at / block_lines))


def lines_without(
    lines: DataFrame, wanted: Column, lacks: str, before: int = 2, after: int = 9, ignore_case: bool = True, block_lines: int = BLOCK_LINES
) -> DataFrame:
    """Rows of ``lines(scan_id, path, line_number, line, …)`` that are ``wanted`` with no match of ``lacks`` near them.

    Near are the lines from ``before`` before to ``after`` after, by number, joined by line feeds; lines that the
    table lacks are not there. A path stands once in a scan; null lines match nothing. One shuffle by
    block, and texts are gathered only where a wanted line is near.
    """
    blocks = in_blocks(lines.withColumn("_wanted", F.coalesce(wanted, F.lit(False))), before, after, block_lines)
    group = Window.partitionBy("scan_id", "path", "_block").orderBy(F.col("line_number").cast("long"))
    used = F.max("_wanted").over(group.rangeBetween(-after, before))
    near = blocks.withColumn("_used", used).filter("_used")
    text = F.array_join(F.collect_list("line").over(group.rangeBetween(-before, after)), "\n")
    found = near.withColumn("_text", text).filter(F.col("_own") & F.col("_wanted") & ~matches(F.col("_text"), lacks, ignore_case))
    return found.select(*lines.columns)


def missing_in_window(lines: DataFrame, rule: RuleSpec, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Findings of a rule of kind ``missing_in_window``, as a scan of the whole files gives them, from their lines."""
    call, limit = rule.patterns
    open_path = lines.filter(paths.gate(paths.gate_key(rule), F.col("path")))
    found = lines_without(open_path, matches(F.col("line"), call, True), limit, block_lines=block_lines)
    snippet = strip(F.col("line"))
    return found.select(
        "scan_id",
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.severity_rank).alias("severity"),
        F.col("path").alias("file_path"),
        F.col("line_number").cast("int").alias("line_number"),
        F.lit(rule.why).alias("message"),
        snippet.alias("snippet"),
        fingerprint(F.col("path"), F.lit(rule.rule_id), snippet).alias("fingerprint"),
    )
