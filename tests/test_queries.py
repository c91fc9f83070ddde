"""Registered queries against their SQL on the smallest tables.

A spread of queries by default; all of them with ``RISKLOOM_ALL_QUERIES=1``.
"""

import os

import pytest

from .check_queries import compare, connect

SF_DIR = os.environ.get("RISKLOOM_TEST_SF", "/root/testdata/sf0.001")
SOME = [
    "corpus_from_tables", "filter_hidden_dirs", "filter_binary_ext", "ignore_rules", "explode_lines", "scan_all", "inline_ignore",
    "scan_pages", "custom_rule", "denylist_join", "score", "score_label", "rules_fired", "rule_rollup", "consecutive_diff",
    "load_history", "suppressed_status", "add_suppression", "load_suppressions", "load_profiles", "profile_join", "gate_new_only",
    "redact_pii", "redact_secrets", "report_json", "report_sarif", "leak_audit", "evaluate", "stream_scan", "stream_severity_windows",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def names():
    from riskloom.plans.queries import QUERIES

    return list(QUERIES) if os.environ.get("RISKLOOM_ALL_QUERIES") else SOME


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, name):
    from riskloom.plans.queries import ORACLES, QUERIES

    ok, note = compare(connect(SF_DIR), QUERIES[name](spark, SF_DIR), ORACLES[name])
    assert ok, note


def test_every_query_has_sql():
    from riskloom.plans.queries import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry_points

    assert entry_points.entry(spark).columns == ["scan_id", "files_scanned", "score", "label", "label_text"]
