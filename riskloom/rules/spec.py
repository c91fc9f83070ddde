"""What a rule is: its metadata, where it applies and how it matches."""

from __future__ import annotations

from dataclasses import dataclass

SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
SEVERITY_RANK = {name: rank for rank, name in enumerate(SEVERITIES)}


@dataclass(frozen=True)
class RuleSpec:
    """One detection rule.

    ``kind`` names the matcher in :mod:`riskloom.operators.detect`; plain per-line regex
    rules use ``lines``. ``guards`` are literals of which every matching line holds at
    least one, so a cheap substring test can run before the regexes. An empty tuple means
    no such literal exists. ``also`` is a second such list, tested on lines only; it spares
    a regex with an open middle the lines that lack its end. ``needs`` are characters of which every matching line holds at
    least one; prose without code symbols is ruled out by them alone. ``gate`` names a path predicate in
    :mod:`riskloom.functions.paths`; ``extensions`` is the usual one.
    """

    rule_id: str
    name: str
    severity: str
    why: str
    fix: str
    guide_url: str
    owasp_id: str | None = None
    owasp_llm_id: str | None = None
    cwe_id: str | None = None
    confidence: str = "medium"
    kind: str = "lines"
    extensions: tuple[str, ...] = ()
    gate: str | None = None
    patterns: tuple[str, ...] = ()
    guards: tuple[str, ...] = ()
    also: tuple[str, ...] = ()
    needs: str = ""
    ignore_case: bool = False
    honours_marker: bool = True
    vetoes: tuple[str, ...] = ()
    redactor: str = "default"

    @property
    def severity_rank(self) -> int:
        return SEVERITY_RANK[self.severity]

    @property
    def category(self) -> str:
        return self.rule_id.rstrip("0123456789")
