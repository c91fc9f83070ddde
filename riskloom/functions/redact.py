"""Snippet masks, one per redactor name of a rule, and masks for free text."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import CATALOG
from ..rules.spec import RuleSpec
from .text import java_regex, mask_in_line, replace_in_matches, strip

# What is masked and what stands in its place.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
NUMBER = r"\b\d{3}[-.\s]?\d{2,4}[-.\s]?\d{4}\b"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
QUOTED = r"""(["'])[^"']+\1"""
QUOTED_WORD = r"""(["'])[a-zA-Z0-9_\-]{3,}\1"""
QUOTED_API_KEY = r"""(["'])sk-[A-Za-z0-9_\-]+\1"""

_TEXT_MASKS = {
    "email": (EMAIL, "[EMAIL REDACTED]"),
    "number": (NUMBER, "[NUMBER REDACTED]"),
    "ssn": (SSN, "[SSN REDACTED]"),
}


def redact_text(text: Column, masks: tuple[str, ...] = ("email", "number", "ssn")) -> Column:
    """Mask personal data in any text column. Masks apply in the order given."""
    for name in masks:
        regex, mask = _TEXT_MASKS[name]
        text = F.regexp_replace(text, java_regex(regex), mask)
    return text


def _mask_quoted(text: Column, regex: str) -> Column:
    return F.regexp_replace(text, java_regex(regex), "$1[REDACTED]$1")


def _mask_env_value(line: Column, pattern: str) -> Column:
    """Keep the instruction and the key of a matched setting, drop its value."""
    return replace_in_matches(
        line,
        pattern,
        lambda hit: F.regexp_replace(hit, r"(?U)^(\S+)\s+([^=]*).*$", "$1 $2=...REDACTED"),
        ignore_case=True,
    )


def snippet(rule: RuleSpec, pattern: str, line: Column) -> Column:
    """The snippet of a line that ``pattern`` of ``rule`` hit."""
    kind = rule.redactor
    if kind == "default":
        return mask_in_line(line, pattern, "[REDACTED]")
    if kind == "stripped":
        return strip(line)
    if kind == "quoted":
        return _mask_quoted(line, QUOTED)
    if kind == "quoted_in_match":
        return replace_in_matches(line, pattern, lambda hit: _mask_quoted(hit, QUOTED))
    if kind == "word_in_match":
        return replace_in_matches(line, pattern, lambda hit: _mask_quoted(hit, QUOTED_WORD))
    if kind == "env_value":
        return _mask_env_value(line, pattern)
    if kind == "api_key":
        return F.regexp_replace(line, java_regex(QUOTED_API_KEY), "$1sk-[REDACTED]$1")
    if kind == "pii":
        return redact_text(line, ("email", "number"))
    if kind == "ssn":
        return redact_text(line, ("ssn",))
    if kind == "email":
        return redact_text(line, ("email",))
    raise ValueError(f"unknown redactor {kind!r}")


def redact_secrets(text: Column, rules: tuple[RuleSpec, ...] = CATALOG) -> Column:
    """Mask every credential that a secret rule knows, whichever rule reported the text.

    The regexes of a rule run over texts that hold one of its guards only.
    """
    for rule in rules:
        if rule.category == "SEC":
            masked = partial(_mask_patterns, patterns=rule.patterns)
            text = _where_guarded(text, rule.guards, masked) if rule.guards and not rule.ignore_case else masked(text)
    return text


def _mask_patterns(text: Column, patterns: tuple[str, ...]) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, java_regex(pattern), "[REDACTED]")
    return text


def _where_guarded(text: Column, guards: tuple[str, ...], change: Callable[[Column], Column]) -> Column:
    """``change`` of texts that hold a guard. The text is bound once, so that masks nest without growing the plan."""

    def guarded(t: Column) -> Column:
        held = reduce(or_, [F.contains(t, F.lit(guard)) for guard in guards])
        return F.when(held, change(t)).otherwise(t)

    return F.get(F.transform(F.array(text), guarded), F.lit(0))
