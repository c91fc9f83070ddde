"""The catalogue: identity, order, selection, and that guards never hide a match."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from riskloom.rules import CATALOG, RULE_ORDER, quick_rules, select_rules

MATCHERS = [r for r in CATALOG if r.guards and r.kind in ("lines", "stripped_lines")]


def test_ids_are_unique_and_ordered():
    ids = [r.rule_id for r in CATALOG]
    assert len(ids) == len(set(ids)) == 77
    assert ids == RULE_ORDER


def test_every_rule_is_complete():
    for rule in CATALOG:
        assert rule.name and rule.why and rule.fix and rule.guide_url
        assert rule.severity in ("LOW", "MEDIUM", "HIGH", "CRITICAL")
        assert rule.confidence in ("low", "medium", "high")


@pytest.mark.parametrize("rule", MATCHERS, ids=lambda r: r.rule_id)
def test_guards_and_needs_are_necessary(rule):
    """Any text that a pattern matches holds a guard and a needed symbol."""
    flags = re.IGNORECASE if rule.ignore_case else 0
    for pattern in rule.patterns:

        @settings(max_examples=12, deadline=None, database=None, suppress_health_check=list(HealthCheck))
        @given(st.from_regex(re.compile(pattern.replace(")*+", ")*"), flags), fullmatch=True))
        def check(text):
            seen = text.translate(str.maketrans("İıſ", "iis")).lower() if rule.ignore_case else text
            assert any(guard in seen for guard in rule.guards)
            assert not rule.also or any(literal in seen for literal in rule.also)
            assert not rule.needs or any(char in text for char in rule.needs)

        check()


def test_selection():
    assert [r.rule_id for r in select_rules(rule_ids=["GIT002", "AI001"])] == ["AI001", "GIT002"]
    assert {r.category for r in select_rules(prefixes=["SEC", "GIT"])} == {"SEC", "GIT"}
    assert len(select_rules(prefixes=["SEC"])) == 18
    assert len(select_rules(prefixes=["DEP"])) == 11
    assert {r.category for r in quick_rules()} == {"SEC", "GIT"} and len(quick_rules()) == 23
    assert {r.severity for r in select_rules(severities=["LOW"])} == {"LOW"}
    assert len(select_rules()) == 77


def test_general_token_rule(scan):
    from riskloom.rules import CATALOG, EXTENDED, quick_rules

    assert [r.rule_id for r in EXTENDED[len(CATALOG):]] == ["SEC900"] and EXTENDED[: len(CATALOG)] == CATALOG
    assert "SEC900" not in {r.rule_id for r in quick_rules(EXTENDED)}
    found = scan(("a.txt", 'token = "' + "a1" * 16 + '"\ntoken = "abc"\n'), rules=EXTENDED)
    assert [(r.rule_id, r.line_number, r.snippet) for r in found] == [("SEC900", 1, "[REDACTED]")]
