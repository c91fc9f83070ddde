"""Matching: each kind of rule, gates, markers, masks, and a brute-force comparison."""

import random
import re
import time

import pytest

from riskloom.functions.text import one_pass, open_parts
from riskloom.operators import lines as line_rules
from riskloom.operators.detect import FINDING_COLUMNS, IGNORE_MARKER, detect
from riskloom.plans.seeds import SEEDS
from riskloom.rules import CATALOG, RuleSpec, select_rules
from riskloom.sources.tables import explode_lines

BY_ID = {r.rule_id: r for r in CATALOG}


def ids(rows):
    return [(r.rule_id, r.line_number) for r in rows]


@pytest.fixture(scope="module")
def seed_findings(spark):
    rows = []
    for n, seed in enumerate(SEEDS):
        rows.append(("pos", f"m{n}/{seed.name}", "intro é\n" + seed.positive))
        rows.append(("neg", f"m{n}/{seed.name}", "intro é\n" + seed.negative))
    files = spark.createDataFrame(rows, "scan_id string, path string, content string")
    return detect(files).collect(), rows


def test_each_seed_hits_and_each_near_miss_does_not(seed_findings):
    found, _ = seed_findings
    keys = {(r.scan_id, r.file_path, r.rule_id) for r in found}
    for n, seed in enumerate(SEEDS):
        if seed.rule_id != "NONE":
            assert ("pos", f"m{n}/{seed.name}", seed.rule_id) in keys, seed
            assert ("neg", f"m{n}/{seed.name}", seed.rule_id) not in keys, seed


def test_line_rules_equal_a_brute_force_scan(seed_findings):
    """Every plain line rule against every seed line, by Python's own regex engine."""
    found, rows = seed_findings
    plain = [r for r in CATALOG if r.kind == "lines" and r.gate is None]
    want = set()
    for scan_id, path, content in rows:
        for rule in plain:
            if rule.extensions and not path.endswith(rule.extensions):
                continue
            for number, line in enumerate(content.splitlines(), 1):
                if rule.honours_marker and IGNORE_MARKER in line or any(v in line for v in rule.vetoes):
                    continue
                flags = re.IGNORECASE if rule.ignore_case else 0
                hit = next((p for p in rule.patterns if re.search(p, line, flags)), None)
                if hit:
                    snippet = re.sub(hit, "[REDACTED]", line) if rule.redactor == "default" else None
                    want.add((scan_id, path, rule.rule_id, number, snippet))
    names = {r.rule_id for r in plain}
    got = {
        (r.scan_id, r.file_path, r.rule_id, r.line_number, r.snippet if BY_ID[r.rule_id].redactor == "default" else None)
        for r in found
        if r.rule_id in names
    }
    assert got == want


def test_columns(corpus):
    assert tuple(detect(corpus(("a.py", "eval(x)"))).columns) == FINDING_COLUMNS


def test_one_finding_per_rule_and_line(scan):
    rows = scan(("a.js", "app.use(cors()) // Access-Control-Allow-Origin: *\nx"))
    assert ids(rows) == [("CFG003", 1)]


def test_several_rules_on_a_line(scan):
    assert [r.rule_id for r in scan(("a.py", "eval(request.args)"))] == ["CRY007", "INJ006"]


def test_extension_gate_is_case_sensitive(scan):
    assert scan(("a.PY", "hashlib.md5(x)")) == []
    assert [r.rule_id for r in scan(("a.py", "hashlib.md5(x)"))] == ["CRY003"]


def test_marker(scan):
    line = f"eval(x)  # {IGNORE_MARKER}"
    assert scan(("a.py", line)) == []
    assert [r.rule_id for r in scan(("a.py", line), marker="other-mark")] == ["CRY007"]
    # Some rules do not honour the marker.
    assert [r.rule_id for r in scan(("a.go", f"print(token) # {IGNORE_MARKER}"))] == ["DAT001"]


def test_universal_newlines_and_odd_line_ends(scan):
    rows = scan(("a.py", "x\r\ny\rhashlib.md5(a) hashlib.sha1(b)"))
    assert ids(rows) == [("CRY003", 3), ("CRY004", 4)]


def test_case_insensitive_hit_is_masked_case_sensitively(scan):
    rows = scan(("a.go", "LOG(TOKEN)\nlog(token)"))
    assert [r.snippet for r in rows] == ["LOG(TOKEN)", "[REDACTED])"]


def test_unicode_word_boundary(scan):
    assert scan(("a.php", "éeval(x)")) == []


def test_vetoes(scan):
    assert scan(("a.py", "secrets.SystemRandom().choice(random.choice(x))")) == []
    assert scan(("a.py", "x = '000-00-0000' or '123-45-6789'")) == []


def test_window(scan):
    near = "c.messages.create(\n" + "x\n" * 8 + "max_tokens=9"
    far = "c.messages.create(\n" + "x\n" * 9 + "max_tokens=9"
    before = "max_tokens=9\nx\nc.messages.create("
    early = "max_tokens=9\nx\ny\nc.messages.create("
    split = "c.messages.create(\nmax_tokens\n=\n5"
    assert scan(("a.py", near)) == [] and scan(("a.py", before)) == [] and scan(("a.py", split)) == []
    assert ids(scan(("a.py", far))) == [("AI002", 1)]
    assert ids(scan(("a.py", early))) == [("AI002", 4)]


def test_dockerfile(scan):
    assert ids(scan(("Dockerfile", "FROM x"))) == [("DEP001", 1)]
    assert scan(("x/app.dockerfile", "FROM x\nUSER app")) == []
    assert [r.rule_id for r in scan(("Dockerfile.d/run", "FROM x"))] == ["DEP001"]
    rows = scan(("Dockerfile", "USER a\nENV DB_PASSWORD=x"))
    assert [r.snippet for r in rows] == ["ENV DB_PASSWORD=...REDACTED=x"]
    rows = scan(("Dockerfile", "USER a\nARG  A=1 MY_token SECRET tail"))
    assert [r.snippet for r in rows] == ["ARG A=...REDACTED tail"]


def test_gitignore(scan):
    rows = scan((".gitignore", ""), rule_ids=["GIT002"])
    assert [(r.line_number, r.snippet) for r in rows] == [(1, "(empty .gitignore)")]
    assert [r.rule_id for r in scan((".gitignore", "node_modules/\n__pycache__/\n.DS_Store\n"))] == ["GIT002"]
    assert scan((".gitignore", " .env* \nnode_modules\n__pycache__/*\n.DS_Store?")) == []
    long = scan((".gitignore", "y" * 200), rule_ids=["GIT003"])
    assert len(long[0].snippet) == 80


def test_env_file(scan):
    assert [r.rule_id for r in scan(("prod.env", "A=1"))] == ["GIT006"]
    assert scan(("prod.env", "nothing here")) == []
    assert scan((".env.local", "A=1")) == []


def test_requirements(scan):
    text = "flask\nflask==3.0\n# numpy\n-r x.txt\nrequests>=2\nrequests>=2,<3\nattrs ~= 23.1\nrequets\nPIL\n"
    rows = scan(("requirements.txt", text))
    assert ids(rows) == [
        ("DEP102", 1), ("DEP103", 5), ("DEP103", 7), ("DEP105", 8), ("DEP102", 8), ("DEP102", 9),
    ]
    typo = next(r for r in rows if r.rule_id == "DEP105")
    assert typo.message == "'requets' resembles the known typosquat of 'requests'. Verify on pypi.org before installing."


def test_normalised_names_catch_two_real_packages(scan):
    rows = scan(("requirements.txt", "python-dotenv==1.0\npinecone.client==1"))
    assert ids(rows) == [("DEP105", 1), ("DEP105", 2)]
    loose = scan(("requirements.txt", "python-dotenv==1.0\npinecone-client==1\ndjago==1"), strict_parity=False)
    assert ids(loose) == [("DEP105", 3)]


def test_imports(scan):
    rows = scan(("a.py", "  import colourama\nfrom NUMP import x\nimport numpy\nimportcolourama\nimport nump_x"))
    assert ids(rows) == [("DEP105", 1), ("DEP105", 2)]
    assert rows[1].message == "'NUMP' is a known typosquat of 'numpy'. Verify on pypi.org."


def test_block_items(scan):
    text = (
        "a = 1\nsetup(\n  install_requires=[\n    'flask',\n    'numpy>=1',\n    \"attrs\",\n    'wheel'\n  ],\n"
        "  extras_require={'x': ['rich', 'click']},\n)"
    )
    rows = scan(("setup.py", text), rule_ids=["DEP104"])
    assert ids(rows) == [("DEP104", 4), ("DEP104", 6), ("DEP104", 7), ("DEP104", 9), ("DEP104", 9)]
    assert [r.snippet for r in rows] == ["'flask',", '"attrs",', "'wheel'\n  ]", "'rich',", "'click']"]
    # A pinned neighbour on the same line hides a bare name.
    assert scan(("setup.cfg", "install_requires = ['flask', 'numpy>=1']"), rule_ids=["DEP104"]) == []


def test_masks(scan):
    cases = {
        "if pwd == 'abc' or x == \"y\":": "if pwd == '[REDACTED]' or x == \"[REDACTED]\":",
        "to = 'ann@site.example.org'": "to = '[EMAIL REDACTED]'",
    }
    for line, snippet in cases.items():
        assert [r.snippet for r in scan(("a.py", line))] == [snippet]


def test_reserved_mail_domains_are_safe(scan):
    assert scan(("a.py", "a = 'ann@example.org' + 'bob@test.org'")) == []
    assert [r.rule_id for r in scan(("a.py", "a = 'ann@example.org' + 'bob@corp.org'"))] == ["PRI004"]


def test_own_rule_comes_after_the_catalogue(scan):
    own = RuleSpec("OWN001", "Mine", "INFO", "why", "fix", "", patterns=(r"magic",), guards=("magic",))
    rows = scan(("a.py", "eval(magic)"), rules=CATALOG + (own,))
    assert [r.rule_id for r in rows] == ["CRY007", "OWN001"]


def test_rule_selection(scan):
    assert scan(("a.py", "eval(x)"), rule_ids=["SEC001"]) == []
    assert scan(("a.py", "eval(x)"), severities=["LOW"]) == []
    assert scan(("a.py", "eval(x)"), rule_ids=["NOPE"]) == []


def test_long_adversarial_lines(scan):
    text = "\n".join(["a" * 10_000, '"' * 10_000, " " * 10_000, "password" * 1_000, "console.log(" + "x" * 10_000])
    assert [r.rule_id for r in scan(("a.js", text))] == []


def test_long_lists_and_blanks_need_no_stack(scan):
    text = "flask>=1" + ",!=1" * 20_000 + "\n" + " " * 100_000 + "x"
    assert [r.rule_id for r in scan(("requirements.txt", text), rule_ids=["DEP103"])] == ["DEP103"]
    assert scan(("a.js", "console.log(x" * 20_000), rule_ids=["DAT004", "PRI001", "PRI003"]) == []


def test_plan_is_one_narrow_pass(spark, tmp_path):
    spark.createDataFrame([("s", "a.py", "eval(x)", 1)], "scan_id string, path string, content string, other int").write.parquet(
        str(tmp_path / "files")
    )
    found = detect(spark.read.parquet(str(tmp_path / "files")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    nodes = re.findall(r"^[ :+\-]*(?:\*\(\d+\) )?([A-Z]\w+)", plan, re.MULTILINE)
    assert set(nodes) <= {"Project", "Generate", "ColumnarToRow", "FileScan", "Filter", "Scan"}, nodes
    assert "other:int" not in plan and "content:string" in plan


PROBES = [
    (rule, pattern) for rule in CATALOG for pattern in rule.patterns if one_pass(pattern)
]


def test_one_pass_patterns_find_the_same_stretch():
    """On lines put together from what the patterns look for."""
    rng = random.Random(1)
    for rule, pattern in PROBES:
        flags = re.IGNORECASE if rule.ignore_case else 0
        bits = [re.sub(r"\\(.)", r"\1", piece) for part in open_parts(pattern) for piece in re.findall(r"[A-Za-z_.$]+\\?[(\[]?|\S", part)]
        bits += [" ", "x", "(", "=", "request", "password", "False", "f'", "{"]
        for _ in range(300):
            line = "".join(rng.choices(bits, k=rng.randrange(1, 14)))
            slow = re.sub(pattern, "[REDACTED]", line) if re.search(pattern, line, flags) else None
            fast = re.sub(one_pass(pattern), r"\1[REDACTED]", line) if re.search(one_pass(pattern), line, flags) else None
            assert slow == fast, (rule.rule_id, line)


@pytest.mark.parametrize("start", ["open(x) ", "SELECT ", "logging.info(", "return ", "eval( ", "$where ", "print(", "NODE_ENV "])
def test_a_long_line_of_openings_ends_soon(scan, start):
    began = time.perf_counter()
    scan(("a.py", start * (1_000_000 // len(start)) + " req"))
    assert time.perf_counter() - began < 60


def test_a_long_block_of_names(scan):
    names = "".join(f'    "pkg{i}",\n' for i in range(20_000))
    began = time.perf_counter()
    rows = [r for r in scan(("setup.py", f"x = 1\ninstall_requires=[\n{names}]\n")) if r.rule_id == "DEP104"]
    assert [r.line_number for r in rows] == list(range(3, 20_003)) and "'pkg7'" in rows[7].message
    assert time.perf_counter() - began < 60


def test_names_beside_bounds_are_not_reported(scan):
    text = 'install_requires=["a1", "b1>=2", "c1" , >=\n"d1"\n, "e1"], x=["f1"]\nextras_require = {"g": ["h1",\n "i1"]}'
    rows = [r for r in scan(("setup.py", text)) if r.rule_id == "DEP104"]
    assert [(r.line_number, r.snippet) for r in rows] == [(3, '"e1"]'), (4, '"h1",'), (5, '"i1"]')]


def test_a_check_as_table_function_gives_the_rows_of_the_check(spark, corpus):
    from riskloom.operators.custom import detect_with, register_check
    from riskloom.rules import RuleSpec

    def check(path, content):
        for number, line in enumerate(content.splitlines(), 1):
            if "todo" in line:
                yield number, f"{path}:{line}"

    files = corpus(("a.py", "x\ntodo 1\ntodo 2"), ("b.py", ""), ("c.py", "todo é"), ("d.py", None), (None, "todo"))
    rule = RuleSpec("TODO01", "To do", "INFO", "Open work.", "Do it.", "")
    want = detect_with(files.filter("path IS NOT NULL AND content IS NOT NULL"), rule, check)
    register_check(spark, "todo_lines", check)
    files.createOrReplaceTempView("todo_files")
    got = spark.sql("SELECT scan_id, path, h.* FROM todo_files, LATERAL todo_lines(path, content) AS h")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("scan_id", "file_path", "line_number", "snippet", "pos").collect()))
    assert got.count() == 3


def windows_of(found):
    return sorted((r.file_path, r.line_number, r.snippet, r.fingerprint) for r in found.collect())


@pytest.mark.parametrize("block_lines", [1, 5, 12, 4096])
def test_windows_over_a_table_of_lines(corpus, block_lines):
    """Blocks of any size give what whole files give, at their edges too."""
    rng = random.Random(block_lines)
    kinds = ["x = 1", "client.chat.completions.create(", "    max_tokens=5,", "max_tokens", "=", " 7", "", "a.messages.stream(model)"]
    files = [(f"f{i}.py", "\n".join(rng.choice(kinds) for _ in range(rng.randrange(80)))) for i in range(12)]
    files += [("a.txt", "a.messages.create("), ("b.py", ""), ("c.py", "a.messages.create(\r\n" + "\r\n" * 9 + "max_tokens=1")]
    rule = select_rules(rule_ids=["AI002"])[0]
    rows = corpus(*files)
    found = line_rules.missing_in_window(explode_lines(rows), rule, block_lines)
    whole = windows_of(detect(rows, [rule]))
    assert windows_of(found) == whole and len(whole) > 20


def test_a_long_file_spreads_over_tasks(spark):
    """Two million lines in blocks: one call in a hundred thousand lines, every other one with a limit."""
    line = "CASE WHEN id % 100000 = 7 THEN 'x.messages.create(' WHEN id % 200000 = 16 THEN 'max_tokens=9' ELSE 'pass' END"
    lines = spark.range(2_000_000).selectExpr("'s' AS scan_id", "'long.py' AS path", "cast(id + 1 AS int) AS line_number", f"{line} AS line")
    rule = select_rules(rule_ids=["AI002"])[0]
    found = line_rules.missing_in_window(lines, rule)
    assert [n for _, n, _, _ in windows_of(found)] == list(range(100_008, 2_000_000, 200_000))
    most = line_rules.in_blocks(lines, 2, 9).groupBy("_block").count().agg({"count": "max"}).first()[0]
    assert most == line_rules.BLOCK_LINES + 11


def test_own_rules_beside_the_catalogue(corpus):
    """The catalogue's part is built once; hits, metadata and order are those of one list of rules."""
    own = RuleSpec("OWN001", "Own", "LOW", "Own words.", "None.", "", patterns=("own word",), guards=("own word",))
    files = corpus(("a.py", "eval(x)  # own word\nown word"), ("b.txt", "own word"), ("c.py", "exec(y)"), ("d.py", None))
    rows = sorted((r.file_path, r.line_number, r.rule_id, r.message, r.rule_ordinal) for r in detect(files, (own, *CATALOG)).collect())
    apart = detect(files, [own]).collect() + detect(files).collect()
    assert rows == sorted((r.file_path, r.line_number, r.rule_id, r.message, r.rule_ordinal) for r in apart)
    assert sum(r[2] == "OWN001" for r in rows) == 3
