"""Text helpers as Column expressions.

Python's text rules are kept where they differ from Java's: universal newlines, the line
ends of ``str.splitlines``, Unicode white space, and Unicode ``\\w``, ``\\s``, ``\\b``.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line ends in one byte of Latin-1, and the two beyond it.
LINE_ENDS = "[\n\u000b\u000c\u001c-\u001e\u0085]"
WIDE_LINE_ENDS = ("\u2028", "\u2029")
_SPACE = r"[\s\x1c-\x1f]+"
# Fixed value: the characters that Python counts as white space.
WHITE_SPACE = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    Catalyst may inline a projected expression into a lambda, where it would run again for
    every array element. Binding it as a lambda variable rules that out.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_table(rows: list[dict], schema: str) -> Column:
    """A small constant array of structs; Catalyst folds it into one literal."""
    return F.from_json(F.lit(json.dumps(rows)), schema)


def java_regex(pattern: str, ignore_case: bool = False) -> str:
    """Give a pattern Python's Unicode classes, and case folding where asked."""
    return ("(?iuU)" if ignore_case else "(?U)") + pattern


def open_parts(pattern: str) -> list[str]:
    """Cut a pattern at each ``.*`` that stands outside groups; one part if it has none or is anchored."""
    parts, depth, start, i = [], 0, 0, 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            i += 2
            continue
        if char == "[":  # skip a character class
            i += 2 if pattern[i + 1] in "]^" else 1
            while pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
        elif char in "()":
            depth += 1 if char == "(" else -1
        elif char == "|" and not depth:
            return [pattern]
        elif not depth and pattern.startswith(".*", i) and pattern[i + 2 : i + 3] not in ("?", "+"):
            parts.append(pattern[start:i])
            i += 2
            start = i
            continue
        i += 1
    return [pattern] if pattern.startswith("^") or not parts else [*parts, pattern[start:]]


def one_pass(pattern: str) -> str | None:
    """A pattern ``A.*B`` as one that finds the same stretch of a line without trying every ``A``.

    If a line matches at all it does from its first ``A``, and up to its last ``B``, after which
    nothing is left to match. The first group holds what stands before the match.
    """
    first, *rest = open_parts(pattern)
    if not rest:
        return None
    return f"^(?>(.*?){first})" + "".join(f"(?>.*?{part})" for part in rest[:-1]) + ".*" + rest[-1]


def matches_line(line: Column, pattern: str, ignore_case: bool = False) -> Column:
    """As :func:`matches` for a single line, in time that grows with the line alone."""
    return line.rlike(java_regex(one_pass(pattern) or pattern, ignore_case))


def mask_in_line(line: Column, pattern: str, mask: str) -> Column:
    """Replace every match in a single line."""
    fast = one_pass(pattern)
    return F.regexp_replace(line, java_regex(fast or pattern), ("$1" if fast else "") + mask)


def matches(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return text.rlike(java_regex(pattern, ignore_case))


def normalize_newlines(text: Column) -> Column:
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def split_lines(text: Column) -> Column:
    """Array of lines without their ends; no empty last line; no lines in an empty text.

    The wide ends are rare and make the character class slow, so they are replaced first.
    """
    wide = contains_any(text, WIDE_LINE_ENDS)
    plain = F.when(wide, F.translate(text, "".join(WIDE_LINE_ENDS), "\n\n")).otherwise(text)
    parts = F.split(plain, LINE_ENDS, -1)
    return let(
        parts,
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p),
    )


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def collapse_space(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"(?U){_SPACE}", " "))


def fold_case(text: Column) -> Column:
    """Lower case in which the letters that fold to i, k and s are plain i, k and s."""
    odd = contains_any(text, ("İ", "ı", "ſ"))
    return F.lower(F.when(odd, F.translate(text, "İıſ", "iis")).otherwise(text))


def contains_any(text: Column, literals: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for literal in literals:
        found = found | text.contains(literal)
    return found


def replace_in_matches(text: Column, pattern: str, change: Callable[[Column], Column], ignore_case: bool = False) -> Column:
    """Rewrite every match of ``pattern`` with ``change`` and keep the text between."""
    regex = java_regex(pattern, ignore_case)
    gaps = F.split(text, regex, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), change)
    return F.array_join(F.zip_with(gaps, found, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit("")))), "")
