"""Rule matching over a table of files.

The whole scan is one narrow projection followed by one explode of hits: no shuffle, no
Python, one read of the source. Per file it works in three steps that shrink the work:

1. every distinct guard literal of the rules that the path lets in is looked up once,
   which leaves the few rules that can hit this file at all; guards that come with a code
   symbol are looked up only in the lines that hold any such symbol, so prose costs little;
2. lines are tested against the guards of those rules only;
3. the regexes of a rule run on the lines that hold one of its guards.

The candidate rules travel as a small array and the regexes are literals inside lambda
bodies, so the plan stays small, nothing hits the size limit of generated methods, and
each pattern is compiled once per task.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache, partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, redact
from ..functions.identity import fingerprint, normalize_package
from ..functions.text import (
    contains_any,
    fold_case,
    java_regex,
    let,
    literal_table,
    matches,
    matches_line,
    normalize_newlines,
    split_lines,
    strip,
)
from ..rules import CATALOG, RULE_ORDER, RuleSpec, select_rules
from ..rules.dependencies import ALIASES, DENYLIST
from ..rules.git import ACCEPTED_ENTRIES

# A line that holds this text is not reported by the rules that honour it.
IGNORE_MARKER = "riskloom-ignore"

# Symbols that code has and prose mostly lacks. A text without one cannot hold a guard with it.
_SYMBOLS = "()[]{}<=>:_\"'@-/*+$"

HIT = "array<struct<rule:int,line_number:int,snippet:string,message:string>>"

# Snippets and messages of rules that do not quote a line.
NO_USER_SNIPPET = "# No USER directive found in Dockerfile"
ENV_FILE_SNIPPET = "(env file with secrets - content redacted)"
EMPTY_FILE_SNIPPET = "(empty .gitignore)"
UNBOUNDED_MESSAGE = (
    "'%s' in install_requires has no version constraint. "
    "Use 'pkg>=min,<max' or switch to a lockfile tool."
)
TYPO_LINE_MESSAGE = "'%s' resembles the known typosquat of '%s'. Verify on pypi.org before installing."
TYPO_IMPORT_MESSAGE = "'%s' is a known typosquat of '%s'. Verify on pypi.org."
TYPO_IMPORT_PLAIN_MESSAGE = "'%s' is a known typosquat. Verify on pypi.org."

# An import statement at all; anchored, so other lines fail at their first character.
IMPORT_LINE = r"(?iuU)^[\s\x1f]*(?:import|from)\s"
IMPORT_REGEX = r"^(?:import|from)\s+(" + "|".join(name.replace("-", r"\-") for name in DENYLIST) + r")\b"


@dataclass(frozen=True)
class _Detector:
    """One matcher of a rule with the path gate and guards that let it run."""

    number: int
    rule: RuleSpec
    scope: str
    gate: tuple
    guards: tuple[str, ...]
    build: Callable
    message: Callable | None = None


# ---- line matchers: line -> snippet, null for no hit ------------------------------------


def _match_lines(rule: RuleSpec, line: Column) -> Column:
    """The first pattern that hits decides the snippet."""
    snippet = None
    for pattern in rule.patterns:
        test, value = matches_line(line, pattern, rule.ignore_case), redact.snippet(rule, pattern, line)
        snippet = F.when(test, value) if snippet is None else snippet.when(test, value)
    return F.when(~contains_any(line, rule.vetoes), snippet) if rule.vetoes else snippet


def _match_stripped_lines(rule: RuleSpec, line: Column) -> Column:
    def on(text: Column) -> Column:
        found = paths.any_of(matches(text, pattern) for pattern in rule.patterns)
        vetoed = paths.any_of(matches(text, pattern) for pattern in rule.vetoes)
        return F.when(found & ~vetoed, text)

    return let(strip(line), on)


def _denylist_map(normalized: bool) -> Column:
    entries = {}
    for typo, legit in DENYLIST.items():
        key = typo.lower().replace("-", "_").replace(".", "_") if normalized else typo.lower()
        entries.setdefault(key, legit)
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


def _required_name(rule: RuleSpec, text: Column) -> Column:
    return F.regexp_extract(text, java_regex(rule.patterns[0], True), 1)


def _legit_requirement(name: Column) -> Column:
    return F.try_element_at(_denylist_map(True), normalize_package(name))


def _match_denied_requirement(rule: RuleSpec, line: Column, strict_parity: bool = True) -> Column:
    """A requirement line whose normalised name is a normalised denylist key.

    Normalising makes two real packages equal denylist keys. Without strict parity a name
    that is itself the legitimate one is not reported.
    """

    def on(text: Column) -> Column:
        def report(name: Column) -> Column:
            legit = _legit_requirement(name)
            denied = (name != "") & ~normalize_package(name).isin(*ALIASES) & legit.isNotNull()
            return F.when(denied if strict_parity else denied & (F.lower(name) != F.lower(legit)), text)

        return let(_required_name(rule, text), report)

    return let(strip(line), on)


def _denied_requirement_message(rule: RuleSpec, snippet: Column) -> Column:
    name = _required_name(rule, snippet)
    return F.format_string(TYPO_LINE_MESSAGE, name, _legit_requirement(name))


def _imported_name(text: Column) -> Column:
    return F.regexp_extract(text, java_regex(IMPORT_REGEX, True), 1)


def _match_denied_import(rule: RuleSpec, line: Column) -> Column:
    """An import of a denylisted name. Names come from one literal alternation."""

    def on(text: Column) -> Column:
        name = _imported_name(text)
        return F.when((name != "") & ~F.lower(name).isin(*ALIASES), text)

    return F.when(line.rlike(IMPORT_LINE), let(strip(line), on))


def _denied_import_message(rule: RuleSpec, snippet: Column) -> Column:
    name, known = _imported_name(snippet), _denylist_map(False)
    legit = F.coalesce(
        F.try_element_at(known, F.lower(name)),
        F.try_element_at(known, F.replace(F.lower(name), F.lit("_"), F.lit("-"))),
    )
    return F.coalesce(
        F.when(legit.isNotNull(), F.format_string(TYPO_IMPORT_MESSAGE, name, legit)),
        F.format_string(TYPO_IMPORT_PLAIN_MESSAGE, name),
    )


# ---- file matchers: (content, lines) -> array of hits -----------------------------------


def _file_hit(number: int, line_number: Column, snippet: Column, message: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(number).alias("rule"),
        line_number.cast("int").alias("line_number"),
        snippet.alias("snippet"),
        (none if message is None else message).alias("message"),
    )


def _one_file_hit(number: int, condition: Column, snippet: Column) -> Column:
    """One finding on line 1 when a condition on the whole file holds."""
    return F.when(condition, F.array(_file_hit(number, F.lit(1), snippet))).otherwise(F.array().cast(HIT))


def _missing_in_window(number: int, rule: RuleSpec, content: Column, lines: Column) -> Column:
    """Call lines with no limit from two lines before to nine lines after."""
    call, limit = rule.patterns

    def unbounded(line: Column, index: Column) -> Column:
        first = F.greatest(index - 2, F.lit(0))
        window = F.slice(lines, first + 1, index + 10 - first)
        return F.when(
            matches(line, call, True) & ~matches(F.array_join(window, "\n"), limit, True),
            _file_hit(number, index + 1, strip(line)),
        )

    return F.array_compact(F.transform(lines, unbounded))


def _missing_entry(number: int, rule: RuleSpec, content: Column, lines: Column) -> Column:
    accepted = F.array(*[F.lit(entry) for entry in ACCEPTED_ENTRIES[rule.rule_id]])
    head = F.when(content == "", F.lit(EMPTY_FILE_SNIPPET)).otherwise(F.substring(content, 1, 80))
    return _one_file_hit(number, ~F.arrays_overlap(F.transform(lines, strip), accepted), head)


def _missing_user(number: int, rule: RuleSpec, content: Column, lines: Column) -> Column:
    # Multi-line mode in which only a line feed ends a line.
    return _one_file_hit(number, ~content.rlike("(?mdU)" + rule.patterns[0]), F.lit(NO_USER_SNIPPET))


def _env_file(number: int, rule: RuleSpec, content: Column, lines: Column) -> Column:
    return _one_file_hit(number, content.contains("="), F.lit(ENV_FILE_SNIPPET))


def _count_newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda total, value: total + value)


def _sums_before(values: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """Call ``body`` with a function of the sum of the first ``i`` values.

    Sums of blocks of about the square root of the length come first, so a sum adds up two short
    stretches and no array is built by appending.
    """
    width = F.ceil(F.sqrt(F.size(values) + 1)).cast("int")

    def over(size: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), size - 1), lambda j: _total(F.slice(values, j * size + 1, size)))

        def with_blocks(sums: Column) -> Column:
            starts = F.transform(F.sequence(F.lit(0), size - 1), lambda j: _total(F.slice(sums, F.lit(1), j)))

            def with_starts(done: Column) -> Column:
                def before(i: Column) -> Column:
                    block = F.floor(i / size).cast("int")
                    return F.get(done, block) + _total(F.slice(values, block * size + 1, i - block * size))

                return body(before)

            return let(starts, with_starts)

        return let(blocks, with_blocks)

    return let(width, over)


def _located(text: Column, pattern: str) -> Column:
    """Matches of a pattern as array<struct<hit, line, before, after>>.

    ``line`` counts the newlines in front, ``before`` holds the last 3 characters in front and
    ``after`` the next 20. All come from the pieces between matches, so no piece is read often.
    """
    regex = java_regex(pattern)
    gaps = F.split(text, regex, -1)
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))

    def locate(pieces: Column) -> Column:
        # pieces is struct<gaps, hits>: a gap in front of each hit and one at the end.
        feeds = F.zip_with(
            F.slice(pieces["gaps"], F.lit(1), F.size(pieces["hits"])),
            pieces["hits"],
            lambda gap, hit: _count_newlines(gap) + _count_newlines(hit),
        )

        def found(sums: Callable[[Column], Column], hit: Column, i: Column) -> Column:
            gap = F.get(pieces["gaps"], i)
            last = F.coalesce(F.get(pieces["hits"], i - 1), F.lit(""))
            # A hit has 3 characters or more, so 7 further pieces fill 20.
            following = F.zip_with(
                F.slice(pieces["gaps"], i + 2, F.lit(8)),
                F.slice(pieces["hits"], i + 2, F.lit(8)),
                lambda g, h: F.concat(g, F.coalesce(h, F.lit(""))),
            )
            return F.struct(
                hit.alias("hit"),
                (sums(i) + _count_newlines(gap)).alias("line"),
                F.right(F.concat(F.right(last, F.lit(3)), gap), F.lit(3)).alias("before"),
                F.left(F.array_join(F.transform(following, lambda piece: F.left(piece, F.lit(20))), ""), F.lit(20)).alias("after"),
            )

        return let(
            feeds, lambda counts: _sums_before(counts, lambda sums: F.transform(pieces["hits"], lambda hit, i: found(sums, hit, i)))
        )

    return let(F.struct(gaps.alias("gaps"), hits.alias("hits")), locate)


def _block_items(number: int, rule: RuleSpec, content: Column, lines: Column) -> Column:
    """Bare quoted names inside a dependency block that may span lines."""
    block_regex, name_regex = rule.patterns

    def in_block(block: Column) -> Column:
        def item(found: Column) -> Column:
            bounded = F.concat(found["before"], F.substring_index(found["after"], "\n", 1)).rlike("[><=!~]")
            name = F.regexp_extract(found["hit"], java_regex(name_regex), 1)
            message = F.format_string(UNBOUNDED_MESSAGE, name)
            line = block["line"] + found["line"] + 1
            return F.when(~bounded, _file_hit(number, line, strip(found["hit"]), message))

        return F.array_compact(F.transform(_located(block["hit"], name_regex), item))

    return F.flatten(F.transform(_located(content, block_regex), in_block))


_LINE_KINDS = {"lines": _match_lines, "stripped_lines": _match_stripped_lines}
_FILE_KINDS = {
    "missing_in_window": _missing_in_window,
    "missing_entry": _missing_entry,
    "missing_user": _missing_user,
    "env_file": _env_file,
    "block_items": _block_items,
}


def _detectors(rules: tuple[RuleSpec, ...], strict_parity: bool) -> list[_Detector]:
    found = []
    for number, rule in enumerate(rules):
        key = paths.gate_key(rule)
        if rule.kind == "denylist":
            match = partial(_match_denied_requirement, strict_parity=strict_parity)
            requirements, imports = ("denylist_requirements", ()), ("denylist_imports", ())
            found += [
                _Detector(number, rule, "line", requirements, (), match, _denied_requirement_message),
                _Detector(number, rule, "line", imports, ("import", "from"), _match_denied_import, _denied_import_message),
            ]
        elif rule.kind in _LINE_KINDS:
            found.append(_Detector(number, rule, "line", key, rule.guards, _LINE_KINDS[rule.kind]))
        else:
            found.append(_Detector(number, rule, "file", key, rule.guards, _FILE_KINDS[rule.kind]))
    return found


# ---- assembly ---------------------------------------------------------------------------


def _hits(rules: tuple[RuleSpec, ...], path: Column, content: Column, marker: str, strict_parity: bool) -> Column:
    """All hits of one file as an array, see :data:`HIT`."""
    detectors = _detectors(rules, strict_parity)
    gates = list(dict.fromkeys(d.gate for d in detectors))
    symbols = sorted({char for d in detectors for char in d.rule.needs} | set(_SYMBOLS))
    symbol_bit = {char: 1 << (len(gates) + number) for number, char in enumerate(symbols)}

    def bits(chars: str) -> int:
        return sum(symbol_bit[char] for char in set(chars) if char in symbol_bit)

    # Distinct guards with the gates under which anyone asks for them, the symbols they hold
    # themselves, and the symbols of which their rules need one.
    guards: dict[tuple[str, bool], dict] = {}
    for d in detectors:
        for text in d.guards:
            fresh = {"id": len(guards), "text": text, "gates": 0, "holds": bits(text), "needs": bits(d.rule.needs)}
            row = guards.setdefault((text, d.rule.ignore_case), fresh)
            row["gates"] |= 1 << gates.index(d.gate)
            row["needs"] = row["needs"] | bits(d.rule.needs) if row["needs"] and d.rule.needs else 0

    def guard_table(ignore_case: bool, symbolic: bool) -> Column | None:
        rows = [
            row
            for (_, folded), row in guards.items()
            if folded is ignore_case and bool(row["holds"] | row["needs"]) is symbolic
        ]
        return literal_table(rows, "array<struct<id:int,text:string,gates:bigint,holds:bigint,needs:bigint>>") if rows else None

    detector_table = literal_table(
        [
            {
                "id": number,
                "rule": d.number,
                "gate": 1 << gates.index(d.gate),
                "needs": bits(d.rule.needs),
                "guard_ids": [guards[text, d.rule.ignore_case]["id"] for text in d.guards],
                "guards": list(d.guards),
                "also": list(d.rule.also),
                "fold": d.rule.ignore_case,
                "by_line": d.scope == "line",
                "marked": d.rule.honours_marker,
            }
            for number, d in enumerate(detectors)
        ],
        "array<struct<id:int,rule:int,gate:bigint,needs:bigint,guard_ids:array<int>,guards:array<string>,"
        "also:array<string>,fold:boolean,by_line:boolean,marked:boolean>>",
    )

    def flags(tests: list[tuple[Column, int]]) -> Column:
        zero = F.lit(0).cast("long")
        return reduce(
            lambda left, right: left.bitwiseOR(right),
            [F.when(test, F.lit(bit).cast("long")).otherwise(zero) for test, bit in tests],
            zero,
        )

    def features(text: Column) -> Column:
        """One bit per path gate that is open and per symbol that the text holds."""
        open_gates = [(paths.gate(key, path), 1 << bit) for bit, key in enumerate(gates)]
        return flags(open_gates + [(text.contains(char), bit) for char, bit in symbol_bit.items()])

    def meets(row: Column, mask: Column) -> Column:
        return (row["needs"] == 0) | (row["needs"].bitwiseAND(mask) != 0)

    def present(text: Column, table: Column, mask: Column) -> Column:
        held = F.filter(
            table,
            lambda g: (g["gates"].bitwiseAND(mask) != 0)
            & (g["holds"].bitwiseAND(mask) == g["holds"])
            & meets(g, mask)
            & F.contains(text, g["text"]),
        )
        return F.transform(held, lambda g: g["id"])

    def fold_present(text: Column, table: Column, mask: Column, asked: int) -> Column:
        looked_up = let(fold_case(text), lambda low: present(low, table, mask))
        return F.when(mask.bitwiseAND(F.lit(asked).cast("long")) != 0, looked_up).otherwise(F.array().cast("array<int>"))

    def candidates(text: Column, code: Column, mask: Column) -> Column:
        """Rules that can hit. ``code`` is the lines of the text that hold any symbol."""
        found = []
        for symbolic, part in ((True, code), (False, text)):
            table, folded_table = guard_table(False, symbolic), guard_table(True, symbolic)
            if table is not None:
                found.append(present(part, table, mask))
            if folded_table is not None:
                asked = sum({1 << gates.index(d.gate) for d in detectors if d.rule.ignore_case and d.guards})
                found.append(fold_present(part, folded_table, mask, asked))
        held = F.concat(*found) if found else F.array().cast("array<int>")
        return let(
            held,
            lambda ids: F.filter(
                detector_table,
                lambda d: (d["gate"].bitwiseAND(mask) != 0)
                & meets(d, mask)
                & ((F.size(d["guard_ids"]) == 0) | F.arrays_overlap(d["guard_ids"], ids)),
            ),
        )

    def dispatch(d: Column, values: dict[int, Column]) -> Column:
        branches = None
        for number, value in values.items():
            branches = F.when(d["id"] == number, value) if branches is None else branches.when(d["id"] == number, value)
        return F.lit(None).cast("string") if branches is None else branches

    def line_hits(line: Column, index: Column, able: Column) -> Column:
        def guarded(text: Column) -> Callable[[Column], Column]:
            def holds_one(literals: Column) -> Column:
                return (F.size(literals) == 0) | F.exists(literals, lambda literal: F.contains(text, literal))

            return lambda d: holds_one(d["guards"]) & holds_one(d["also"])

        def report(d: Column) -> Column:
            snippets = {n: x.build(x.rule, line) for n, x in enumerate(detectors) if x.scope == "line"}
            return let(
                dispatch(d, snippets),
                lambda snippet: F.when(
                    snippet.isNotNull(),
                    F.struct(
                        d["rule"].alias("rule"),
                        (index + 1).cast("int").alias("line_number"),
                        snippet.alias("snippet"),
                        dispatch(
                            d, {n: x.message(x.rule, snippet) for n, x in enumerate(detectors) if x.message}
                        ).alias("message"),
                    ),
                ),
            )

        exact = F.filter(able, lambda d: ~d["fold"] & guarded(line)(d))
        folded = let(
            F.filter(able, lambda d: d["fold"]),
            lambda some: F.when(
                F.size(some) > 0, let(fold_case(line), lambda text: F.filter(some, guarded(text)))
            ).otherwise(some),
        )
        unmarked = F.filter(F.concat(exact, folded), lambda d: ~(d["marked"] & line.contains(marker)))
        return F.array_compact(F.transform(unmarked, report))

    def file_hits(text: Column, lines: Column, able: Column) -> Column:
        ids = F.transform(able, lambda d: d["id"])
        parts = [
            F.when(
                F.array_contains(ids, F.lit(number)),
                detector.build(detector.number, detector.rule, text, lines),
            ).otherwise(F.array().cast(HIT))
            for number, detector in enumerate(detectors)
            if detector.scope == "file"
        ]
        return F.concat(*parts) if parts else F.array().cast(HIT)

    def scan(text: Column, lines: Column, able: Column) -> Column:
        by_line = let(
            F.filter(able, lambda d: d["by_line"]),
            lambda line_able: F.when(
                F.size(line_able) > 0,
                F.flatten(F.transform(lines, lambda line, index: line_hits(line, index, line_able))),
            ).otherwise(F.array().cast(HIT)),
        )
        return F.concat(by_line, file_hits(text, lines, able))

    def over(text: Column, lines: Column) -> Column:
        any_symbol = "[" + "".join("\\" + char for char in symbols) + "]"
        code = F.array_join(F.filter(lines, lambda line: line.rlike(any_symbol.replace("\\_", "_"))), "\n")
        none = F.array().cast(HIT)
        return let(
            code,
            lambda part: let(
                features(part),
                lambda mask: let(
                    candidates(text, part, mask),
                    lambda able: F.when(F.size(able) > 0, scan(text, lines, able)).otherwise(none),
                ),
            ),
        )

    return let(normalize_newlines(content), lambda text: let(split_lines(text), lambda lines: over(text, lines)))


@lru_cache(maxsize=64)
def _cached_hits(
    application: str, rules: tuple[RuleSpec, ...], marker: str, strict_parity: bool
) -> tuple[Column, Column]:
    """The hits of a file, and the metadata of a hit's rule from a constant table.

    Building the expression takes seconds of driver time, so scans in one application share it, also
    those with rules of their own besides the whole catalogue: only the latter are built anew.
    """
    own = tuple(rule for rule in rules if rule not in _CATALOGUED)
    if own and len(own) + len(CATALOG) == len(rules):
        known, more = (_cached_hits(application, part, marker, strict_parity)[0] for part in (CATALOG, own))
        none = F.array().cast(HIT)
        moved = F.transform(more, lambda hit: hit.withField("rule", hit["rule"] + len(CATALOG)))
        hits, rules = F.concat(F.coalesce(known, none), F.coalesce(moved, none)), CATALOG + own
    else:
        hits = _hits(rules, F.col("path"), F.col("content"), marker, strict_parity)
    table = literal_table(_rule_rows(rules), f"array<struct<{_struct_fields(_RULE_FIELDS)}>>")
    return hits, F.get(table, F.col("hit.rule"))


_CATALOGUED = frozenset(CATALOG)

_RULE_FIELDS = (
    "rule_ordinal int, rule_id string, rule_name string, severity int, severity_name string, category string, "
    "description string, fix string, guide_url string, owasp_id string, owasp_llm_id string, cwe_id string, "
    "confidence string, file_extensions array<string>, patterns array<string>"
)


def _rule_rows(rules: tuple[RuleSpec, ...]) -> list[dict]:
    ordinals = rule_ordinals(rules)
    return [
        {
            "rule_ordinal": ordinals[r.rule_id], "rule_id": r.rule_id, "rule_name": r.name, "severity": r.severity_rank,
            "severity_name": r.severity, "category": r.category, "description": r.why, "fix": r.fix,
            "guide_url": r.guide_url, "owasp_id": r.owasp_id, "owasp_llm_id": r.owasp_llm_id, "cwe_id": r.cwe_id,
            "confidence": r.confidence, "file_extensions": list(r.extensions), "patterns": list(r.patterns),
        }
        for r in rules
    ]


def rule_table(spark: SparkSession, rules: Iterable[RuleSpec] = CATALOG) -> DataFrame:
    """The catalogue as a dimension table, one row per rule."""
    table = literal_table(_rule_rows(tuple(rules)), f"array<struct<{_struct_fields(_RULE_FIELDS)}>>")
    return spark.range(1).select(F.inline(table))


def _struct_fields(columns: str) -> str:
    return ", ".join(column.replace(" ", ":", 1) for column in columns.split(", "))


def rule_ordinals(rules: Iterable[RuleSpec]) -> dict[str, int]:
    """Tie-break rank of each rule; rules of your own come after the catalogue."""
    known = {rule_id: rank for rank, rule_id in enumerate(RULE_ORDER)}
    own = [rule.rule_id for rule in rules if rule.rule_id not in known]
    return known | {rule_id: len(known) + rank for rank, rule_id in enumerate(own)}


def detect(
    files: DataFrame,
    rules: Iterable[RuleSpec] = CATALOG,
    *,
    rule_ids: Iterable[str] | None = None,
    prefixes: Iterable[str] | None = None,
    severities: Iterable[str] | None = None,
    marker: str = IGNORE_MARKER,
    strict_parity: bool = True,
    keep: Iterable[str] = (),
) -> DataFrame:
    """Findings of ``files(scan_id, path, content)``; see :data:`FINDING_COLUMNS`.

    ``rule_ids``, ``prefixes`` and ``severities`` prune the rules before the plan is built.
    ``strict_parity=False`` spares the two real packages that the denylist catches by accident.
    ``keep`` names further columns of ``files`` to carry into the findings.
    """
    chosen = select_rules(rules, rule_ids=rule_ids, prefixes=prefixes, severities=severities)
    if not chosen:
        return detect(files, CATALOG[:1], marker=marker, keep=keep).limit(0)
    keep = list(keep)
    hits, rule = _cached_hits(files.sparkSession.sparkContext.applicationId, chosen, marker, strict_parity)
    raw = files.select("scan_id", "path", *keep, F.posexplode(hits).alias("pos", "hit"))
    named = raw.withColumn("rule", rule)
    return named.select(
        "scan_id",
        "rule.rule_id",
        "rule.rule_name",
        "rule.severity",
        F.col("path").alias("file_path"),
        "hit.line_number",
        F.coalesce("hit.message", "rule.description").alias("message"),
        "rule.fix",
        "hit.snippet",
        "rule.guide_url",
        "rule.owasp_id",
        "rule.owasp_llm_id",
        "rule.cwe_id",
        "rule.confidence",
        fingerprint(F.col("path"), F.col("rule.rule_id"), F.col("hit.snippet")).alias("fingerprint"),
        "rule.rule_ordinal",
        "pos",
        *keep,
    )


FINDING_COLUMNS = (
    "scan_id", "rule_id", "rule_name", "severity", "file_path", "line_number", "message", "fix", "snippet",
    "guide_url", "owasp_id", "owasp_llm_id", "cwe_id", "confidence", "fingerprint", "rule_ordinal", "pos",
)
