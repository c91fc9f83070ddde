"""Text helpers against Python's own functions."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from riskloom.functions import identity, paths, redact
from riskloom.functions.text import fold_case, normalize_newlines, replace_in_matches, split_lines, strip

LINES = [
    "", "\n", "a", "a\n", "a\n\n", "\na", "a\rb\r\nc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "é \n",
    "x\x1fy", " ", " a \t\n b",
]


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("v"))).collect()]


def test_split_lines_equals_python(spark):
    got = column(spark, LINES, lambda v: split_lines(normalize_newlines(v)))
    assert got == [re.sub("\r\n?", "\n", v).splitlines() for v in LINES]


def test_strip_equals_python(spark):
    values = ["  a ", " a ", "\x1fa\x1c", "", " \t ", "a b"]
    assert column(spark, values, strip) == [v.strip() for v in values]


def test_white_space_is_complete():
    import sys

    from riskloom.functions.text import WHITE_SPACE

    assert set(WHITE_SPACE) == {chr(n) for n in range(sys.maxunicode + 1) if chr(n).isspace()}


def test_fold_case(spark):
    values = ["PASSWORD", "paſſword", "APİ_KEY", "apı_key", "KEY", "Éa"]
    assert column(spark, values, fold_case) == ["password", "password", "api_key", "api_key", "key", "éa"]


def test_replace_in_matches_equals_re_sub(spark):
    pattern = r"""auth\s*=\s*\(\s*["'][^"']+["']\s*,\s*["'][^"']+["']\s*\)"""
    quoted = r"""(["'])[^"']+\1"""
    values = [
        "get(u, auth=('a', 'b'), x='c')", "auth=('a','b') and auth = ( \"c\" , \"d\" )", "nothing 'here'", "auth=('a','b')",
    ]
    got = column(
        spark, values, lambda v: replace_in_matches(v, pattern, lambda m: F.regexp_replace(m, quoted, "$1[REDACTED]$1"))
    )
    want = [re.sub(pattern, lambda m: re.sub(quoted, r"\1[REDACTED]\1", m.group()), v) for v in values]
    assert got == want


def test_redact_text(spark):
    values = ["mail ann@site.example.org or 555-123-4567", "ssn 123-45-6789", "é123-45-6789", "x 12345678901234"]
    got = column(spark, values, lambda v: redact.redact_text(v, ("email", "number")))
    want = [re.sub(redact.NUMBER, "[NUMBER REDACTED]", re.sub(redact.EMAIL, "[EMAIL REDACTED]", v)) for v in values]
    assert got == want
    assert "[SSN REDACTED]" in column(spark, values, lambda v: redact.redact_text(v, ("ssn",)))[1]


def test_fingerprint_equals_hashlib(spark):
    row = spark.createDataFrame([("././Src\\A.py", " ai001 ", "  X =\t 1\n")], "p string, r string, s string")
    got = row.select(identity.fingerprint(F.col("p"), F.col("r"), F.col("s"))).first()[0]
    assert got == hashlib.sha256("src/a.py\nAI001\nx = 1".encode()).hexdigest()
    assert row.select(identity.short_fingerprint(F.lit(got))).first()[0] == got[:12]


def test_uri_equals_pathlib(spark):
    from pathlib import PurePosixPath

    values = ["/a b/é+x~.py", "/plain/x.py", "/p%q/(1)*.py"]
    got = column(spark, values, identity.to_uri)
    assert got == [PurePosixPath(v).as_uri() for v in values]
    assert column(spark, ["a\\b c.py"], identity.to_uri) == ["a/b c.py"]


@pytest.mark.parametrize(
    "path,suffix", [("a/.env", ""), ("a/b.tar.GZ", ".gz"), ("x", ""), ("a.b/c", ""), (".hidden.zip", ".zip"), ("a/.png", "")]
)
def test_suffix(spark, path, suffix):
    assert column(spark, [path], paths.suffix) == [suffix]


def test_severity_names(spark):
    assert column(spark, ["high", " Low ", "loud", None], identity.severity_rank) == [3, 1, None, None]
    assert column(spark, [0, 4], identity.severity_name, "int") == ["INFO", "CRITICAL"]
    assert identity.parse_severities("critical, Low,nope") == ["CRITICAL", "LOW"]
    assert identity.parse_severities("nope") is None and identity.parse_severities(None) is None
