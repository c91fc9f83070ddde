"""The scan as plain SQL, for checks by another engine.

The text is put together from the rule catalogue and the seeds only. It shares no matching
code with the Spark operators: lines are rows here, each rule is one branch of a union, and
windows, blocks and lists are joins and list functions.
"""

from __future__ import annotations

from functools import lru_cache

from ..functions import redact
from ..operators import detect as d
from ..rules import CATALOG, RuleSpec
from ..rules.dependencies import ALIASES, DENYLIST
from ..rules.git import ACCEPTED_ENTRIES
from ..rules.spec import SEVERITIES
from .seeds import NEAR_MISS_EVERY, SEEDS


def q(text: str | None) -> str:
    """A SQL string literal; line feeds are spelt out."""
    if text is None:
        return "CAST(NULL AS VARCHAR)"
    return "(" + " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in text.split("\n")) + ")"


def any_of(tests: list[str]) -> str:
    return "(" + " OR ".join(tests) + ")" if tests else "FALSE"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


# ---- gates ------------------------------------------------------------------------------


def gate(rule: RuleSpec) -> str:
    ends = any_of([f"ends_with(path, {q(e)})" for e in rule.extensions])
    requirements = "(contains(base, 'requirement') AND (ends_with(base, '.txt') OR ends_with(base, '.in')))"
    setup = "base IN ('setup.py', 'setup.cfg', 'pyproject.toml')"
    return {
        None: ends if rule.extensions else "TRUE",
        "pip_related": f"(contains(base, 'requirement') OR contains(base, 'dockerfile') OR {ends})",
        "requirements": requirements,
        "requirements_or_setup": f"({requirements} OR {setup})",
        "denylist_files": f"({requirements} OR {setup} OR ends_with(base, '.py'))",
        "dockerfile": "(ends_with(lower(path), 'dockerfile') OR contains(path, 'Dockerfile'))",
    }[rule.gate]


# ---- masks ------------------------------------------------------------------------------


def mask_quoted(text: str, inner: str) -> str:
    double = f"regexp_replace({text}, '\"{inner}\"', '\"[REDACTED]\"', 'g')"
    return f"regexp_replace({double}, '''{inner}''', '''[REDACTED]''', 'g')"


def mask_text(text: str, masks: tuple[str, ...]) -> str:
    shapes = {
        "email": (redact.EMAIL, "[EMAIL REDACTED]"),
        "number": (redact.NUMBER, "[NUMBER REDACTED]"),
        "ssn": (redact.SSN, "[SSN REDACTED]"),
    }
    for name in masks:
        text = f"regexp_replace({text}, {q(shapes[name][0])}, {q(shapes[name][1])}, 'g')"
    return text


def snippet(rule: RuleSpec, pattern: str) -> str:
    kind = rule.redactor
    hit = f"regexp_extract(line, {q(pattern)})"
    if kind == "default":
        return f"regexp_replace(line, {q(pattern)}, '[REDACTED]', 'g')"
    if kind == "quoted":
        return mask_quoted("line", "[^\"'']+")
    if kind == "quoted_in_match":
        return f"replace(line, {hit}, {mask_quoted(hit, chr(91) + '^' + chr(34) + chr(39) * 2 + chr(93) + '+')})"
    if kind == "word_in_match":
        return f"replace(line, {hit}, {mask_quoted(hit, '[a-zA-Z0-9_-]{3,}')})"
    if kind == "env_value":
        hit = f"regexp_extract(line, {q('(?i)' + pattern)})"
        return f"replace(line, {hit}, regexp_replace({hit}, '^(\\S+)\\s+([^=]*).*$', '\\1 \\2=...REDACTED'))"
    if kind == "api_key":
        double = "regexp_replace(line, '\"sk-[A-Za-z0-9_-]+\"', '\"sk-[REDACTED]\"', 'g')"
        return f"regexp_replace({double}, '''sk-[A-Za-z0-9_-]+''', '''sk-[REDACTED]''', 'g')"
    if kind == "stripped":
        return strip("line")
    return mask_text("line", {"pii": ("email", "number"), "ssn": ("ssn",), "email": ("email",)}[kind])


def matches(rule: RuleSpec, pattern: str, text: str = "line") -> str:
    look = "(?!example\\.|test\\.|localhost)"
    if look in pattern:
        # No look-ahead in this engine: list the candidates and drop the reserved domains.
        found = f"regexp_extract_all({text}, {q(pattern.replace(look, ''))})"
        return f"len(list_filter({found}, lambda m: NOT regexp_matches(m, '@(example\\.|test\\.|localhost)'))) > 0"
    # Nor possessive repeats, which it does not need.
    plain = pattern.replace(")*+", ")*")
    return f"regexp_matches({text}, {q(('(?i)' if rule.ignore_case else '') + plain)})"


# ---- one branch per rule ----------------------------------------------------------------


def _select(rule: RuleSpec, source: str, line_number: str, text: str, message: str, where: str, pos: str = "0") -> str:
    return (
        f"SELECT doc_id, scan_id, path, '{rule.rule_id}' AS rule_id, CAST({line_number} AS INTEGER) AS line_number, "
        f"{text} AS snippet, {message} AS message, {pos} AS pos FROM {source} WHERE {gate(rule)} AND {where}"
    )


NO_MESSAGE = "CAST(NULL AS VARCHAR)"


def _line_branch(rule: RuleSpec) -> str:
    cases = []
    for p in rule.patterns:
        shown = p.replace("(?!example\\.|test\\.|localhost)", "")
        cases.append(f"WHEN {matches(rule, p)} THEN {snippet(rule, shown)}")
    banned = [f"contains(line, {q(v)})" for v in rule.vetoes + ((d.IGNORE_MARKER,) if rule.honours_marker else ())]
    where = any_of([matches(rule, p) for p in rule.patterns]) + (f" AND NOT {any_of(banned)}" if banned else "")
    return _select(rule, "lines", "line_number", "CASE " + " ".join(cases) + " END", NO_MESSAGE, where)


def _stripped_branch(rule: RuleSpec) -> str:
    found = any_of([matches(rule, p, strip("line")) for p in rule.patterns])
    vetoed = any_of([matches(rule, p, strip("line")) for p in rule.vetoes])
    return _select(rule, "lines", "line_number", strip("line"), NO_MESSAGE, f"{found} AND NOT {vetoed}")


def _window_branch(rule: RuleSpec) -> str:
    call, limit = ("(?i)" + p for p in rule.patterns)
    window = "array_to_string(ls[greatest(line_number - 2, 1):line_number + 9], chr(10))"
    where = f"regexp_matches(line, {q(call)}) AND NOT regexp_matches({window}, {q(limit)})"
    return _select(rule, "lines", "line_number", strip("line"), NO_MESSAGE, where)


def _entry_branch(rule: RuleSpec) -> str:
    entries = ", ".join(q(e) for e in ACCEPTED_ENTRIES[rule.rule_id])
    head = f"CASE WHEN content = '' THEN {q(d.EMPTY_FILE_SNIPPET)} ELSE substring(content, 1, 80) END"
    where = f"NOT list_has_any(list_transform(ls, lambda x: {strip('x')}), [{entries}])"
    return _select(rule, "files", "1", head, NO_MESSAGE, where)


def _user_branch(rule: RuleSpec) -> str:
    where = f"NOT regexp_matches(content, {q('(?m)' + rule.patterns[0])})"
    return _select(rule, "files", "1", q(d.NO_USER_SNIPPET), NO_MESSAGE, where)


def _env_branch(rule: RuleSpec) -> str:
    return _select(rule, "files", "1", q(d.ENV_FILE_SNIPPET), NO_MESSAGE, "contains(content, '=')")


def _block_branch(rule: RuleSpec) -> str:
    # Blocks and names are found again by position; within a file each text occurs once.
    block, name = rule.patterns
    before = "substring(block, greatest(strpos(block, item) - 3, 1), least(strpos(block, item) - 1, 3))"
    after = "split_part(substring(block, strpos(block, item) + length(item), 20), chr(10), 1)"
    feeds = "length({0}) - length(replace({0}, chr(10), ''))"
    line = (
        "1 + " + feeds.format("substring(content, 1, strpos(content, block) - 1)")
        + " + " + feeds.format("substring(block, 1, strpos(block, item) - 1)")
    )
    items = (
        f"(SELECT *, unnest(regexp_extract_all(block, {q(name)})) AS item FROM "
        f"(SELECT *, unnest(regexp_extract_all(content, {q(block)})) AS block FROM files WHERE {gate(rule)}))"
    )
    message = f"replace({q(d.UNBOUNDED_MESSAGE)}, '%s', regexp_extract(item, {q(name)}, 1))"
    pos = "strpos(content, block) + strpos(block, item)"
    return _select(rule, items, line, strip("item"), message, f"NOT regexp_matches({before} || {after}, '[><=!~]')", pos)


def _denylist_branches(rule: RuleSpec) -> list[str]:
    aliases = ", ".join(q(a) for a in ALIASES)
    gate_sql = gate(rule)
    name = f"regexp_extract({strip('line')}, {q('(?i)' + rule.patterns[0])}, 1)"
    text = strip("line")

    def fill(template: str) -> str:
        first, second = template.split("%s", 1)
        middle, last = second.split("%s", 1)
        return f"{q(first)} || pkg || {q(middle)} || legit || {q(last)}"

    requirement = (
        f"SELECT l.doc_id, l.scan_id, l.path, 'DEP105' AS rule_id, CAST(line_number AS INTEGER) AS line_number, "
        f"{text} AS snippet, {fill(d.TYPO_LINE_MESSAGE)} AS message, 0 AS pos "
        f"FROM (SELECT *, {name} AS pkg FROM lines WHERE {gate_sql} AND contains(base, 'requirement')) l "
        f"JOIN deny ON replace(replace(lower(pkg), '-', '_'), '.', '_') = typo_norm "
        f"WHERE pkg <> '' AND replace(replace(lower(pkg), '-', '_'), '.', '_') NOT IN ({aliases})"
    )
    names = "|".join(n.replace("-", r"\-") for n in DENYLIST)
    imported = f"regexp_extract({text}, {q('(?i)^(?:import|from)' + chr(92) + 's+(' + names + ')' + chr(92) + 'b')}, 1)"
    statement = (
        f"SELECT l.doc_id, l.scan_id, l.path, 'DEP105' AS rule_id, CAST(line_number AS INTEGER) AS line_number, "
        f"{text} AS snippet, {fill(d.TYPO_IMPORT_MESSAGE)} AS message, 0 AS pos "
        f"FROM (SELECT *, {imported} AS pkg FROM lines WHERE ends_with(base, '.py')) l "
        f"JOIN deny ON lower(pkg) = typo WHERE pkg <> '' AND lower(pkg) NOT IN ({aliases})"
    )
    return [requirement, statement]


_BRANCHES = {
    "lines": _line_branch,
    "stripped_lines": _stripped_branch,
    "missing_in_window": _window_branch,
    "missing_entry": _entry_branch,
    "missing_user": _user_branch,
    "env_file": _env_branch,
    "block_items": _block_branch,
}


def branches(rules: tuple[RuleSpec, ...]) -> list[str]:
    out = []
    for rule in rules:
        out += _denylist_branches(rule) if rule.kind == "denylist" else [_BRANCHES[rule.kind](rule)]
    return out


# ---- relations --------------------------------------------------------------------------

LINES = "CASE WHEN parts[len(parts)] = '' THEN parts[1:len(parts) - 1] ELSE parts END"


def corpus_columns(inner: str) -> str:
    """Add the base name and the list of lines to ``(doc_id, scan_id, path, content, …)``."""
    return (
        f"SELECT *, lower(regexp_extract(path, '[^/\\\\]*$')) AS base, {LINES} AS ls "
        f"FROM (SELECT *, string_split(content, chr(10)) AS parts FROM ({inner}))"
    )


def seeds_cte() -> str:
    rows = ", ".join(f"({n}, {q(s.name)}, {q(s.positive)}, {q(s.negative)})" for n, s in enumerate(SEEDS))
    return f"seeds(n, name, positive, negative) AS (VALUES {rows})"


def seeded_files() -> str:
    n = len(SEEDS)
    return (
        f"SELECT doc_id, 'run' || CAST(doc_id // {n} AS VARCHAR) AS scan_id, doc_id // {n} AS run_no, "
        f"'app/m' || CAST(n AS VARCHAR) || '/' || name AS path, "
        f"text || chr(10) || CASE WHEN ((doc_id // {n}) * 7 + n) % {NEAR_MISS_EVERY} = 0 THEN negative ELSE positive END "
        f"AS content FROM documents JOIN seeds ON doc_id % {n} = n"
    )


def document_files() -> str:
    return (
        "SELECT doc_id, source AS scan_id, 'docs/' || lang || '/d' || CAST(doc_id AS VARCHAR) || '.txt' AS path, "
        "text AS content FROM documents"
    )


def rules_cte(rules: tuple[RuleSpec, ...]) -> str:
    order = d.rule_ordinals(rules)
    rows = ", ".join(
        "("
        + ", ".join(
            [q(r.rule_id), q(r.name), str(r.severity_rank), q(r.severity), q(r.category), q(r.why), q(r.fix), q(r.guide_url)]
            + [q(r.owasp_id), q(r.owasp_llm_id), q(r.cwe_id), q(r.confidence), str(order[r.rule_id])]
        )
        + ")"
        for r in rules
    )
    return (
        "rules(rule_id, rule_name, severity, severity_name, category, description, fix, guide_url, owasp_id, "
        f"owasp_llm_id, cwe_id, confidence, rule_ordinal) AS (VALUES {rows})"
    )


def fingerprint(path: str, rule: str, text: str) -> str:
    norm_path = f"lower(regexp_replace(replace({path}, '\\', '/'), '^(\\./)+', ''))"
    norm_text = f"lower({strip(f'regexp_replace({text}, {q(chr(92) + chr(115) + chr(43))}, chr(32), {q(chr(103))})')})"
    return f"sha256({norm_path} || chr(10) || upper({rule}) || chr(10) || {norm_text})"


@lru_cache(maxsize=None)
def prelude(rules: tuple[RuleSpec, ...] = CATALOG, corpus: str | None = None) -> str:
    """``WITH`` clause up to ``findings`` over the seeded corpus or another one."""
    deny = ", ".join(
        f"({q(t.lower())}, {q(t.lower().replace('-', '_').replace('.', '_'))}, {q(v)})" for t, v in DENYLIST.items()
    )
    hits = "\nUNION ALL ".join(branches(rules))
    return (
        f"WITH {seeds_cte()},\n{rules_cte(rules)},\ndeny(typo, typo_norm, legit) AS (VALUES {deny}),\n"
        f"files AS MATERIALIZED ({corpus_columns(corpus or seeded_files())}),\n"
        "lines AS MATERIALIZED (SELECT doc_id, scan_id, path, base, ls, unnest(range(1, len(ls) + 1)) AS line_number, "
        "unnest(ls) AS line FROM files),\n"
        f"hits AS MATERIALIZED ({hits}),\n"
        "findings AS MATERIALIZED (SELECT h.doc_id, h.scan_id, h.rule_id, r.rule_name, r.severity, h.path AS file_path, "
        "h.line_number, coalesce(h.message, r.description) AS message, r.fix, h.snippet, r.guide_url, r.owasp_id, "
        "r.owasp_llm_id, r.cwe_id, r.confidence, r.severity_name, r.category, r.rule_ordinal, "
        f"{fingerprint('h.path', 'h.rule_id', 'h.snippet')} AS fingerprint, h.pos "
        "FROM hits h JOIN rules r ON h.rule_id = r.rule_id)\n"
    )


def severity_case(rank: str) -> str:
    return "CASE " + rank + " " + " ".join(f"WHEN {n} THEN '{name}'" for n, name in enumerate(SEVERITIES)) + " END"


__all__ = ["any_of", "document_files", "prelude", "q", "seeded_files", "severity_case", "strip"]
