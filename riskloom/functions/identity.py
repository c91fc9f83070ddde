"""Stable finding identity and small value maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.spec import SEVERITIES, SEVERITY_RANK
from .text import collapse_space, strip


def normalize_path(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", ""))


def normalize_snippet(text: Column) -> Column:
    return F.lower(collapse_space(text))


def normalize_package(name: Column) -> Column:
    return F.translate(F.lower(name), "-.", "__")


def fingerprint(path: Column, rule_id: Column, snippet: Column) -> Column:
    """SHA-256 over path, rule and snippet. Line numbers stay out, so edits elsewhere keep it."""
    parts = (normalize_path(path), F.upper(strip(rule_id)), normalize_snippet(snippet))
    return F.sha2(F.concat_ws("\n", *parts), 256)


def short_fingerprint(value: Column, length: int = 12) -> Column:
    return F.substring(value, 1, length)


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(name) for name in SEVERITIES]), rank.cast("int"))


def severity_rank(name: Column) -> Column:
    """Rank of a severity name; null for an unknown name."""
    rank = F.lit(None).cast("int")
    for known, value in SEVERITY_RANK.items():
        rank = F.when(F.upper(strip(name)) == known, F.lit(value)).otherwise(rank)
    return rank


def parse_severities(raw: str | None) -> list[str] | None:
    """Names in a comma list, any case. Unknown names drop out; nothing left means no filter."""
    names = [name.strip().upper() for name in (raw or "").split(",")]
    return [name for name in names if name in SEVERITY_RANK] or None


def to_uri(path: Column) -> Column:
    """Absolute paths become percent-encoded file URIs, relative ones get forward slashes."""
    encoded = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    for code, char in (("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return F.when(path.startswith("/"), F.concat(F.lit("file://"), encoded)).otherwise(
        F.replace(path, F.lit("\\"), F.lit("/"))
    )
