"""The rule catalogue.

A rule is declared data, so adding one means passing another :class:`RuleSpec` to
``detect``. The list is in the order in which ties between findings are broken.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from . import ai, auth, config, crypto, dependencies, deployment, exposure, git, injection, privacy, secrets
from .spec import SEVERITIES, SEVERITY_RANK, RuleSpec

# The order in which the rules run.
RULE_ORDER = (
    "AI006 AI005 AI007 AI001 AI003 AI002 AI004 "
    "AUTH006 AUTH004 AUTH005 AUTH001 AUTH003 AUTH002 "
    "CFG005 CFG003 CFG001 CFG002 CFG004 "
    "CRY007 CRY008 CRY006 CRY003 CRY005 CRY009 CRY004 CRY002 CRY001 "
    "DAT004 DAT001 DAT002 DAT003 "
    "DEP101 DEP105 DEP104 DEP102 DEP103 "
    "DEP004 DEP003 DEP001 DEP002 DEP005 DEP006 "
    "GIT006 GIT005 GIT002 GIT003 GIT004 "
    "INJ003 INJ005 INJ002 INJ004 INJ001 INJ006 INJ007 "
    "PRI004 PRI002 PRI003 PRI001 PRI005 "
    "SEC001 SEC002 SEC003 SEC004 SEC005 SEC006 SEC007 SEC008 SEC009 "
    "SEC010 SEC011 SEC012 SEC013 SEC014 SEC015 SEC016 SEC017 SEC018"
).split()

_MODULES = (ai, auth, config, crypto, exposure, dependencies, deployment, git, injection, privacy, secrets)
_BY_ID = {rule.rule_id: rule for module in _MODULES for rule in module.RULES}

CATALOG: tuple[RuleSpec, ...] = tuple(_BY_ID[rule_id] for rule_id in RULE_ORDER)

# The catalogue and the rules that go beyond the fixed ones; they run last, so the order of the others stays.
EXTENDED: tuple[RuleSpec, ...] = (*CATALOG, secrets.GENERIC_TOKEN)


def select_rules(
    rules: Iterable[RuleSpec] = CATALOG,
    *,
    rule_ids: Iterable[str] | None = None,
    prefixes: Iterable[str] | None = None,
    severities: Iterable[str] | None = None,
) -> tuple[RuleSpec, ...]:
    """Keep the rules that a scan needs, before any plan is built.

    A severity filter on findings equals a filter on rules, because a rule has one
    severity. ``prefixes`` keeps whole families, for example ``("SEC",)``.
    """
    kept = tuple(rules)
    if rule_ids:
        wanted = set(rule_ids)
        kept = tuple(rule for rule in kept if rule.rule_id in wanted)
    if prefixes:
        numbered = re.compile("(?:" + "|".join(map(re.escape, prefixes)) + r")\d+")
        kept = tuple(rule for rule in kept if numbered.fullmatch(rule.rule_id))
    if severities:
        wanted = set(severities)
        kept = tuple(rule for rule in kept if rule.severity in wanted)
    return kept


def quick_rules(rules: Iterable[RuleSpec] = CATALOG) -> tuple[RuleSpec, ...]:
    """The rules of a quick scan for secrets: SEC001 to SEC099 and GIT001 to GIT099."""
    return tuple(rule for rule in rules if re.fullmatch(r"(?:SEC|GIT)0\d{2}", rule.rule_id))


__all__ = ["CATALOG", "EXTENDED", "RULE_ORDER", "SEVERITIES", "SEVERITY_RANK", "RuleSpec", "quick_rules", "select_rules"]
