"""Quality rules as a short-circuit cascade, ordered by what a sample says about cost and rejections.

Only DataFrame functions: the counts of a text are array expressions over its own row. Counts that
are returned are there for every text; what else a rule needs stands inside its branch of the
cascade, so a text that was rejected before never pays for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, texts

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
SAMPLE_ROWS = 2000  # rows, about, on which cost and selectivity are estimated


@dataclass(frozen=True)
class Rule:
    """``rejects`` reads count columns and the text; ``cost`` says in steps what that takes beyond the counts that are returned."""

    name: str
    rejects: Callable[[], Column]
    cost: Callable[[], Column]


def _n(name: str) -> Column:
    return F.col(name)


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _lines() -> Column:
    return F.filter(F.split(_text(), "\n"), lambda line: line.rlike(f"[^{SPACE}]"))


def _capitals() -> Column:
    return F.regexp_count(_text(), F.lit("[A-Z]")).cast("long")


def _one_step() -> Column:
    return F.lit(1)


BASE = (
    Rule("too_short", lambda: _n("n_words") < 10, _one_step),
    Rule("repeats", lambda: 100 * _n("n_repeat_words") > 20 * _n("n_words"), _one_step),
)
RULES = (
    Rule("word_length", lambda: ~(10 * _n("word_chars")).between(25 * _n("n_words"), 140 * _n("n_words")), _one_step),
    Rule("symbols", lambda: 10 * _n("n_symbols") > 3 * _n("n_words"), _one_step),
    # Lines are counted again only in texts that repeat one.
    Rule(
        "repeated_lines",
        lambda: (_n("n_dup_lines") > 0) & (10 * _n("n_dup_lines") > 3 * F.size(_lines())),
        lambda: 1 + F.when(_n("n_dup_lines") > 0, 2 * F.char_length(_text())).otherwise(0),
    ),
    Rule("capitals", lambda: 2 * _capitals() > _n("word_chars"), lambda: 1 + 2 * F.char_length(_text())),
)


def with_counts(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and the counts of each whole text; a null text counts as empty.

    Windows are compared by 64-bit hashes, sorted with their places within the row, so a text
    costs n log n and no shuffle. Texts without a repeated window skip the sort.
    """
    parts = F.filter(F.split(_text(), f"[{SPACE}]+"), lambda w: w != "")
    stage = texts(docs).select(
        "doc_id",
        "text",
        parts.alias("words"),
        _lines().alias("lines"),
        F.regexp_count(_text(), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    n = F.size("words")
    none = F.array().cast("array<bigint>")
    grams = F.when(
        n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))
    ).otherwise(none)
    stage = stage.select(
        "doc_id", "text", "n_symbols",
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        grams.alias("grams"),
    )
    placed = F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    repeated = F.size(F.array_distinct("grams")) < F.size("grams")
    stage = stage.withColumn("placed", F.when(repeated, placed)).drop("grams")
    twice = F.filter(
        "placed",
        lambda x, k: ((k > 0) & (F.get("placed", k - 1)["g"] == x["g"])) | F.coalesce(F.get("placed", k + 1)["g"] == x["g"], F.lit(False)),
    )
    stage = stage.withColumn("places", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("placed")
    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(
        "places", start,
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    return stage.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("places")


def rule_order(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, base: tuple[Rule, ...] = BASE
) -> list[dict]:
    """Rules by rejections per cost on a sample of about ``sample_rows`` texts, best first, with both figures.

    The sample is every different row whose hash falls into one of ``total / sample_rows`` classes, so
    it is the same in every run. Figures are those of the texts that pass the base, the only ones that
    reach a rule. The order decides which rule is named and which are spared, never whether a row is kept.
    """
    total = docs.count()
    step = max(1, total // sample_rows)
    sample = texts(docs).filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0).dropDuplicates(["doc_id", "text"])
    counted = with_counts(sample).withColumn("reached", ~_any(base))
    figures = [
        F.struct(
            F.avg(F.when(F.col("reached"), F.coalesce(r.rejects(), F.lit(False)).cast("int"))).alias("rejected"),
            F.avg(F.when(F.col("reached"), r.cost())).alias("cost"),
        ).alias(r.name)
        for r in rules
    ]
    row = counted.agg(F.lit(0).alias("_"), *figures).first()
    found = [{"rule": r, "rejected": row[r.name]["rejected"] or 0.0, "cost": row[r.name]["cost"] or 0.0} for r in rules]
    return sorted(found, key=lambda f: (-f["rejected"] / max(f["cost"], 1e-9), f["cost"], f["rule"].name))


def _any(rules: tuple[Rule, ...]) -> Column:
    failed = F.lit(False)
    for rule in rules:
        failed = failed | rule.rejects()
    return failed


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts and verdicts per document: ``doc_id``, the counts, ``base_failed``, ``rejected_by``, ``kept``.

    Base rules come first; the others follow in the order of :func:`rule_order`, each is
    computed only where all before it passed, and the first that rejects is named. A null or empty text has no
    words and fails the base. Rows with null or equal ids are judged one by one; columns other
    than ``doc_id`` and ``text`` are not read, so extra ones may have any name. No rows give no rows.
    """
    verdict = None
    for found in rule_order(docs, rules, base=base):
        rule = found["rule"]
        verdict = (F if verdict is None else verdict).when(rule.rejects(), F.lit(rule.name))
    verdict = F.lit(None).cast("string") if verdict is None else verdict
    judged = with_counts(docs).withColumn("base_failed", _any(base))
    judged = judged.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(verdict))
    return judged.withColumn("kept", F.col("rejected_by").isNull()).drop("text")
