"""Registered queries, each with the SQL that another engine can check it by.

All of them read whole given tables. Most run on the seeded corpus of
:mod:`riskloom.plans.corpus`, which is every document with a code line after its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, redact
from ..functions.identity import (
    fingerprint,
    normalize_package,
    normalize_path,
    normalize_snippet,
    severity_rank,
    short_fingerprint,
    to_uri,
)
from ..operators import audit, catalog, history, packages, policy, report, suppress
from ..operators import findings as fnd
from ..operators import lines as line_rules
from ..operators import score as sc
from ..operators.custom import detect_with, register_check
from ..operators.detect import IGNORE_MARKER, detect
from ..rules import CATALOG, EXTENDED, SEVERITIES, RuleSpec, quick_rules, select_rules
from ..rules.spec import SEVERITY_RANK
from ..sources import documents as saved
from ..sources import folder as folders
from ..sources import state, tables
from ..sources.tree import read_corpus
from ..streaming import keyed
from ..streaming import scan as live
from . import corpus, sql
from .seeds import SEEDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FINDING = [
    "scan_id", "rule_id", "rule_name", "severity", "file_path", "line_number", "message", "fix", "snippet",
    "guide_url", "owasp_id", "owasp_llm_id", "cwe_id", "confidence", "fingerprint",
]
SHORT = ["scan_id", "rule_id", "severity", "file_path", "line_number", "message", "snippet", "fingerprint"]


TOKEN_RULE = RuleSpec(
    "TOK001", "Token assignment", "HIGH", "A token value is written into the text.", "Load the token at run time.", "",
    patterns=(r'token = "[0-9a-f]{32,}"',), guards=("token = ",),
)
# Rules of our own with hits in the given prose.
OWN_RULES = (
    TOKEN_RULE,
    RuleSpec("MAIL01", "Address", "LOW", "An address.", "Mask it.", "", patterns=(redact.EMAIL,), guards=("@",), redactor="email"),
    RuleSpec("LIC001", "License line", "INFO", "A license line.", "Check it.", "", patterns=(r"\bLicense\b",), guards=("License",)),
    RuleSpec("WRD001", "Listed words", "INFO", "A listed phrase.", "Check it.", "", patterns=(r" avec ",), guards=(" avec ",)),
    RuleSpec("NUM001", "Long number", "LOW", "A long number.", "Check it.", "", patterns=(r"[0-9]{6,}",)),
    RuleSpec("SCR001", "Inline script", "MEDIUM", "A page holds a script.", "Move it out.", "", patterns=(r"<script>[^<]*",),
             guards=("<script>",), extensions=(".html",)),
)


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def over_findings(select: str, rules: tuple[RuleSpec, ...] = CATALOG, more: str = "") -> str:
    """SQL over the findings of the seeded corpus; ``more`` adds relations."""
    return sql.prelude(rules) + (f", {more}\n" if more else "") + select


def columns(names: list[str]) -> str:
    return ", ".join(names)


def seeded(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = corpus.seeded(spark, sf_dir)
    return files, corpus.seeded_scans(files), detect(files, **options)


def kept(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`seeded`, with findings written once for queries that use them several times."""
    files, scans, findings = seeded(spark, sf_dir, **options)
    return files, scans, state.materialize(findings, "findings")


SCANS = (
    "scans AS (SELECT 'corpus' AS project, scan_id, 'app' AS target, '' AS profile, count(*) AS files_scanned, "
    "max(run_no) AS run_no, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(max(run_no) AS INTEGER)) AS saved_at "
    "FROM files GROUP BY scan_id)"
)
COUNTS = "counts AS (SELECT s.*, " + ", ".join(
    f"count(*) FILTER (WHERE f.severity = {SEVERITY_RANK[n]}) AS n_{n.lower()}" for n in SEVERITIES
) + " FROM scans s LEFT JOIN findings f ON s.scan_id = f.scan_id GROUP BY ALL)"
_DEDUCT = {n: f"least(n_{n.lower()} * {sc.WEIGHTS[n]}, {sc.CAPS[n]})" for n in SEVERITIES}
SCORED = "scored AS (SELECT *, CAST(greatest(0, 100 - (" + " + ".join(_DEDUCT.values()) + ")) AS INTEGER) AS score FROM counts)"


def label_case(field: int) -> str:
    arms = " ".join(f"WHEN score >= {e[0]} THEN {sql.q(e[field])}" for e in sc.LABELS)
    return f"CASE {arms} END"


# ---- sources and corpus filters ---------------------------------------------------------

HOST = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"


@query(
    "corpus_from_tables",
    "SELECT scan_id, path, md5(content) AS content_hash, length(content) AS n_chars FROM ("
    + "SELECT scan_id, path, content FROM (" + sql.document_files() + ") UNION ALL "
    + f"SELECT {HOST}, 'pages/p' || CAST(page_id AS VARCHAR) || '.html', html FROM pages UNION ALL "
    + "SELECT role, 'talk/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || '.txt', text FROM conversations)",
)
def corpus_from_tables(spark, sf_dir):
    parts = [corpus.documents(spark, sf_dir), corpus.pages(spark, sf_dir), corpus.conversations(spark, sf_dir)]
    first, second, third = (part.select("scan_id", "path", "content") for part in parts)
    return first.unionByName(second).unionByName(third).select(
        "scan_id", "path", F.md5(F.col("content").cast("binary")).alias("content_hash"), F.length("content").cast("long").alias("n_chars")
    )


@query(
    "corpus_read",
    "SELECT 'lang=' || lang AS folder, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines, "
    "CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM documents GROUP BY lang",
)
def corpus_read(spark, sf_dir):
    # The documents written as text files, a folder per language, and read back as a directory.
    folder = state.new_folder(spark, "tree")
    docs = corpus.texts(spark, sf_dir, "documents").select("lang", "text")
    docs.write.partitionBy("lang").option("maxRecordsPerFile", 5000).text(folder)
    files = read_corpus(spark, folder, max_bytes=None)
    data = files.filter(F.col("path").endswith(".txt"))
    lines = F.size(F.split("content", "\n", -1)) - 1
    return data.groupBy(F.element_at(F.split("path", "/"), 1).alias("folder")).agg(
        F.sum(lines).alias("n_lines"), F.sum(F.length("content").cast("long")).alias("n_chars")
    )


@query("corpus_source", ORACLES["corpus_read"])
def corpus_source(spark, sf_dir):
    # As corpus_read, by SQL through the data source.
    folder = state.new_folder(spark, "source")
    docs = corpus.texts(spark, sf_dir, "documents").select("lang", "text")
    docs.write.partitionBy("lang").option("maxRecordsPerFile", 5000).text(folder)
    folders.folder_files(spark, folder, maxBytes=1 << 40).createOrReplaceTempView("riskloom_files")
    return spark.sql(
        "SELECT split_part(path, '/', 1) AS folder, sum(CAST(size(split(content, '\\n', -1)) - 1 AS BIGINT)) AS n_lines, "
        "sum(CAST(char_length(content) AS BIGINT)) AS n_chars FROM riskloom_files WHERE path LIKE '%.txt' AND size > 0 GROUP BY 1"
    )


# Folder and file endings that put documents at paths of every kind.
DIRS = ["src", "src/node_modules/a", ".github/flows", "src/.cache", "lib.egg-info", "web/dist", "docs/build/x", "a.b/c"]
ENDS = [".py", ".PNG", ".tar.gz", "/.env", "", ".Lock", ".svg", ".html", "/.hidden.zip", "/Makefile", ".min.js"]


def tree(spark, sf_dir) -> DataFrame:
    """Documents laid out as a project tree, one scan per source."""
    docs = corpus.table(spark, sf_dir, "documents")
    folder = F.get(F.array(*[F.lit(v) for v in DIRS]), (F.col("doc_id") % len(DIRS)).cast("int"))
    end = F.get(F.array(*[F.lit(v) for v in ENDS]), (F.col("doc_id") % len(ENDS)).cast("int"))
    path = F.concat(folder, F.lit("/f"), F.col("doc_id").cast("string"), end)
    return tables.as_corpus(docs, path=path, content=F.col("text"), scan_id=F.col("source"))


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(sql.q(v) for v in values) + "]"


TREE = (
    f"tree AS (SELECT source AS scan_id, ({sql_list(DIRS)})[doc_id % {len(DIRS)} + 1] || '/f' || CAST(doc_id AS VARCHAR) "
    f"|| ({sql_list(ENDS)})[doc_id % {len(ENDS)} + 1] AS path, text AS content FROM documents), "
    "parted AS (SELECT *, string_split(path, '/') AS ps FROM tree), "
    "split AS (SELECT *, ps[1:len(ps) - 1] AS dirs, ps[len(ps)] AS name FROM parted)"
)


def sql_dirs(names) -> str:
    return f"NOT list_has_any(dirs, {sql_list(list(names))})"


SQL_HIDDEN = (
    "len(list_filter(dirs, lambda x: (starts_with(x, '.') AND x <> '.github') OR ends_with(x, '.egg-info'))) = 0"
)
SQL_BINARY = "lower(regexp_extract(name, '[^.][^/]*(\\.[^./]+)$', 1)) NOT IN (" + ", ".join(sql.q(s) for s in paths.BINARY_SUFFIXES) + ")"


@query("filter_excluded_dirs", f"WITH {TREE} SELECT scan_id, path FROM split WHERE {sql_dirs(paths.EXCLUDED_DIRS)}")
def filter_excluded_dirs(spark, sf_dir):
    return tables.filter_excluded_dirs(tree(spark, sf_dir)).select("scan_id", "path")


@query("exclude_override", f"WITH {TREE} SELECT scan_id, path FROM split WHERE {sql_dirs(['src', 'c'])}")
def exclude_override(spark, sf_dir):
    return tables.filter_excluded_dirs(tree(spark, sf_dir), ["src", "c"]).select("scan_id", "path")


@query("filter_hidden_dirs", f"WITH {TREE} SELECT scan_id, path FROM split WHERE {SQL_HIDDEN}")
def filter_hidden_dirs(spark, sf_dir):
    return tables.filter_hidden_dirs(tree(spark, sf_dir)).select("scan_id", "path")


@query("filter_binary_ext", f"WITH {TREE} SELECT scan_id, path FROM split WHERE {SQL_BINARY}")
def filter_binary_ext(spark, sf_dir):
    return tables.filter_binary_ext(tree(spark, sf_dir)).select("scan_id", "path")


@query("filter_max_size", f"WITH {TREE} SELECT scan_id, path FROM split WHERE octet_length(encode(content)) <= 4096")
def filter_max_size(spark, sf_dir):
    return tables.filter_max_size(tree(spark, sf_dir), 4096).select("scan_id", "path")


@query(
    "corpus_filters",
    f"WITH {TREE} SELECT scan_id, count(*) AS files_scanned FROM split WHERE {sql_dirs(paths.EXCLUDED_DIRS)} AND {SQL_HIDDEN} "
    f"AND {SQL_BINARY} AND octet_length(encode(content)) <= {paths.MAX_FILE_BYTES} GROUP BY scan_id",
)
def corpus_filters(spark, sf_dir):
    return tables.files_scanned(tables.apply_corpus_filters(tree(spark, sf_dir)))


@query("filter_utf8", "SELECT source AS scan_id, doc_id, md5(text) AS content_hash FROM documents WHERE doc_id % 5 <> 0")
def filter_utf8(spark, sf_dir):
    # Every fifth text gets a byte that UTF-8 does not allow.
    docs = corpus.table(spark, sf_dir, "documents")
    raw = F.encode("text", "UTF-8")
    bad = F.when(F.col("doc_id") % 5 == 0, F.concat(raw, F.unhex(F.lit("FF")))).otherwise(raw)
    files = docs.select(F.col("source").alias("scan_id"), "doc_id", bad.alias("content"))
    return tables.filter_utf8(files).select("scan_id", "doc_id", F.md5(F.col("content").cast("binary")).alias("content_hash"))


IGNORE_TEXT = "# local\n\nweb\n  lib.egg-info/  \nMakefile.d\n.hidden.zip\nnone/"


@query(
    "ignore_rules",
    f"WITH {TREE} SELECT scan_id, path FROM split WHERE NOT list_has_any(dirs, ['web', 'lib.egg-info', 'none']) "
    "AND name NOT IN ('Makefile.d', '.hidden.zip')",
)
def ignore_rules(spark, sf_dir):
    files = tree(spark, sf_dir)
    ignore_files = files.select("scan_id").distinct().select(
        "scan_id", F.lit(tables.IGNORE_FILE).alias("path"), F.lit(IGNORE_TEXT).alias("content")
    )
    ignores = tables.parse_ignore_files(ignore_files)
    return tables.apply_ignores(files, ignores).select("scan_id", "path")


@query("files_scanned", f"WITH {sql.seeds_cte()} SELECT scan_id, count(*) AS files_scanned FROM ({sql.seeded_files()}) GROUP BY scan_id")
def files_scanned(spark, sf_dir):
    return tables.files_scanned(corpus.seeded(spark, sf_dir))


@query(
    "explode_lines",
    f"WITH files AS ({sql.corpus_columns(sql.document_files())}) SELECT scan_id, path, "
    "CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) AS line_number, md5(unnest(ls)) AS line_hash FROM files",
)
def explode_lines(spark, sf_dir):
    lines = tables.explode_lines(corpus.documents(spark, sf_dir))
    return lines.select("scan_id", "path", "line_number", F.md5(F.col("line").cast("binary")).alias("line_hash"))


# ---- catalogue and rule selection -------------------------------------------------------


@query(
    "rule_catalog",
    over_findings(
        "SELECT r.rule_id, r.rule_name, r.severity, r.severity_name, r.category, r.description, r.fix, r.guide_url, "
        "r.owasp_id, r.owasp_llm_id, r.cwe_id, r.confidence, count(f.rule_id) AS n_findings "
        "FROM rules r LEFT JOIN findings f ON r.rule_id = f.rule_id GROUP BY ALL"
    ),
)
def rule_catalog(spark, sf_dir):
    return catalog.catalog_with_counts(seeded(spark, sf_dir)[2]).drop("file_extensions")


@query(
    "rule_applies_to",
    f"WITH {sql.seeds_cte()}, files AS ({sql.corpus_columns(sql.seeded_files())}) "
    + " UNION ALL ".join(f"SELECT '{r.rule_id}' AS rule_id, count(*) FILTER (WHERE {sql.gate(r)}) AS n_files FROM files" for r in CATALOG),
)
def rule_applies_to(spark, sf_dir):
    return catalog.applicable_files(corpus.seeded(spark, sf_dir))


def scan_query(name: str, rules: tuple[RuleSpec, ...], names: list[str] = SHORT, **options) -> None:
    """Register a scan with some of the rules."""

    @query(name, over_findings(f"SELECT {columns(names)} FROM findings", rules))
    def run(spark, sf_dir):
        return seeded(spark, sf_dir, **options)[2].select(*names)


def by_ids(*rule_ids: str) -> dict:
    return {"rules": select_rules(rule_ids=rule_ids), "rule_ids": rule_ids}


scan_query("scan_all", CATALOG, FINDING)
scan_query("filter_rules_by_id", names=SHORT, **by_ids("CRY007", "SEC001", "GIT002"))
scan_query("filter_rules_by_prefix", select_rules(prefixes=["DEP", "GIT"]), prefixes=["DEP", "GIT"])
scan_query("quick_scan", quick_rules(), rule_ids=[r.rule_id for r in quick_rules()])
scan_query("filter_rules_by_severity", select_rules(severities=["LOW", "MEDIUM"]), severities=["LOW", "MEDIUM"])

PLAIN = tuple(r.rule_id for r in CATALOG if r.kind == "lines" and not r.ignore_case and not r.vetoes and not r.gate)
scan_query("match_lines", **by_ids(*PLAIN))
scan_query("match_lines_ci", **by_ids("DAT001"))
scan_query("match_lines_guarded", **by_ids("CRY006", "PRI002", "DEP103"))
scan_query("missing_in_window", **by_ids("AI002"))


@query("missing_in_window_lines", ORACLES["missing_in_window"])
def missing_in_window_lines(spark, sf_dir):
    rule = by_ids("AI002")["rules"][0]
    return line_rules.missing_in_window(tables.explode_lines(corpus.seeded(spark, sf_dir)), rule).select(*SHORT)


scan_query("missing_in_file", **by_ids("DEP001", "GIT002", "GIT003", "GIT004", "GIT005"))
scan_query("file_marker", **by_ids("GIT006"))
scan_query("path_gated", **by_ids("DEP101", "DEP003"))
scan_query("extract_block_items", **by_ids("DEP104"))
scan_query("denylist_match", **by_ids("DEP105"))
scan_query("bare_entry", **by_ids("DEP102"))
for _family in dict.fromkeys(r.category for r in CATALOG):
    scan_query(f"rules_{_family.lower()}", **by_ids(*[r.rule_id for r in CATALOG if r.category == _family]))
for _kind, _ids in {
    "redact_quoted": ("AUTH001",), "redact_within_match": ("AUTH002", "AUTH005"), "redact_env_value": ("DEP003",),
    "redact_api_key": ("AI006",), "redact_log_line": ("PRI001",), "redact_ssn_line": ("PRI002",),
    "redact_email_line": ("PRI004",),
}.items():
    scan_query(_kind, **by_ids(*_ids))


@query("redact_default", over_findings(
    "SELECT rule_id, snippet, count(*) AS n FROM findings GROUP BY ALL",
    tuple(r for r in CATALOG if r.redactor == "default"),
))
def redact_default(spark, sf_dir):
    ids = [r.rule_id for r in CATALOG if r.redactor == "default"]
    return seeded(spark, sf_dir, rule_ids=ids)[2].groupBy("rule_id", "snippet").agg(F.count("*").alias("n"))


@query("snippet_raw", over_findings(
    "SELECT scan_id, rule_id, file_path, line_number, snippet FROM findings",
    tuple(r for r in CATALOG if r.redactor in ("stripped", "head", "constant")),
))
def snippet_raw(spark, sf_dir):
    ids = [r.rule_id for r in CATALOG if r.redactor in ("stripped", "head", "constant")]
    return seeded(spark, sf_dir, rule_ids=ids)[2].select("scan_id", "rule_id", "file_path", "line_number", "snippet")


MARKED = sql.seeded_files().replace(" END AS content", f" END || {sql.q('  // ' + IGNORE_MARKER)} AS content")


@query("inline_ignore", sql.prelude(CATALOG, MARKED) + f"SELECT {columns(SHORT)} FROM findings")
def inline_ignore(spark, sf_dir):
    # The last line of every file carries the marker.
    files = corpus.seeded(spark, sf_dir)
    marked = files.withColumn("content", F.concat("content", F.lit("  // " + IGNORE_MARKER)))
    return detect(marked).select(*SHORT)


def scan_table(name: str, files: Callable, corpus_sql: str) -> None:
    """Register a full scan of a given table as it is, with the rules of our own added."""

    @query(name, sql.prelude(CATALOG + OWN_RULES, corpus_sql) + f"SELECT {columns(SHORT)} FROM findings")
    def run(spark, sf_dir):
        return detect(files(spark, sf_dir), CATALOG + OWN_RULES).select(*SHORT)


scan_table("scan_documents", corpus.documents, sql.document_files())
scan_table(
    "scan_pages", corpus.pages,
    f"SELECT page_id AS doc_id, {HOST} AS scan_id, 'pages/p' || CAST(page_id AS VARCHAR) || '.html' AS path, html AS content FROM pages",
)
scan_table(
    "scan_conversations", corpus.conversations,
    "SELECT conv_id AS doc_id, role AS scan_id, 'talk/' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) || '.txt' AS path, "
    "text AS content FROM conversations",
)


# ---- a rule of one's own ----------------------------------------------------------------

@query("custom_rule", sql.prelude((TOKEN_RULE,), sql.document_files()) + f"SELECT {columns(SHORT)} FROM findings")
def custom_rule(spark, sf_dir):
    return detect(corpus.documents(spark, sf_dir), [TOKEN_RULE]).select(*SHORT)


@query("generic_token", sql.prelude(EXTENDED[-1:]) + f"SELECT {columns(SHORT)} FROM findings")
def generic_token(spark, sf_dir):
    # The whole extended catalogue runs; its last rule is the one beyond the fixed ones.
    return detect(corpus.seeded(spark, sf_dir), EXTENDED).filter("rule_id = 'SEC900'").select(*SHORT)


@query(
    "custom_check",
    "WITH files AS (" + sql.corpus_columns(sql.document_files()) + "), lines AS (SELECT scan_id, path, "
    "unnest(range(1, len(ls) + 1)) AS line_number, unnest(ls) AS line FROM files) "
    "SELECT scan_id, path AS file_path, CAST(line_number AS INTEGER) AS line_number, CAST(length(line) AS VARCHAR) || ' characters' AS snippet "
    "FROM lines WHERE length(line) > 200",
)
def custom_check(spark, sf_dir):
    rule = RuleSpec("LEN001", "Long line", "INFO", "A line is very long.", "Break the line.", "")
    found = detect_with(corpus.documents(spark, sf_dir), rule, long_lines)
    return found.select("scan_id", "file_path", "line_number", "snippet")


def long_lines(path: str, content: str):
    for number, line in enumerate(content.splitlines(), 1):
        if len(line) > 200:
            yield number, f"{len(line)} characters"


@query("custom_table_function", ORACLES["custom_check"])
def custom_table_function(spark, sf_dir):
    # The same check as a table function of SQL.
    register_check(spark, "riskloom_long_lines", long_lines)
    corpus.documents(spark, sf_dir).createOrReplaceTempView("riskloom_documents")
    return spark.sql(
        "SELECT scan_id, path AS file_path, hit.line_number, hit.snippet "
        "FROM riskloom_documents, LATERAL riskloom_long_lines(path, content) AS hit"
    )


# ---- finding lookups --------------------------------------------------------------------


@query("filter_by_severity", over_findings(f"SELECT {columns(SHORT)} FROM findings WHERE severity IN (4, 1)"))
def filter_by_severity(spark, sf_dir):
    return fnd.filter_by_severity(seeded(spark, sf_dir)[2], "critical, Low,unknown").select(*SHORT)


@query("search_findings", over_findings(
    f"SELECT {columns(SHORT)} FROM findings WHERE severity = 3 AND confidence = 'medium' "
    "AND contains(lower(rule_id || rule_name || file_path || message || snippet), 'log')"
))
def search_findings(spark, sf_dir):
    return fnd.search(seeded(spark, sf_dir)[2], severity="HIGH", confidence="medium", text="LOG").select(*SHORT)


@query("order_findings", over_findings(
    f"SELECT {columns(SHORT)} FROM findings ORDER BY scan_id, severity DESC, file_path, line_number, rule_ordinal"
))
def order_findings(spark, sf_dir):
    return fnd.order_findings(seeded(spark, sf_dir)[2]).select(*SHORT)


@query("sort_by_column", over_findings(
    f"SELECT {columns(SHORT)} FROM findings ORDER BY file_path DESC, scan_id, severity DESC, line_number, rule_ordinal"
))
def sort_by_column(spark, sf_dir):
    return fnd.sort_findings(seeded(spark, sf_dir)[2], "file_path", ascending=False).select(*SHORT)


@query("enrich_findings", over_findings(f"SELECT {columns(FINDING)}, category FROM findings"))
def enrich_findings(spark, sf_dir):
    return seeded(spark, sf_dir)[2].withColumn("category", F.regexp_extract("rule_id", "^[A-Z]+", 0)).select(*FINDING, "category")


def sql_url(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {sql.q(k)} THEN {sql.q(v)}" for k, v in fnd.OWASP_URLS.items()) + " ELSE '' END"


@query("owasp_links", over_findings(
    f"SELECT rule_id, owasp_id, {sql_url('owasp_id')} AS owasp_url, CASE WHEN owasp_llm_id IS NULL THEN '' ELSE "
    f"{sql.q(fnd.OWASP_LLM_URL)} END AS owasp_llm_url, count(*) AS n_findings FROM findings GROUP BY ALL"
))
def owasp_links(spark, sf_dir):
    linked = fnd.with_links(seeded(spark, sf_dir)[2])
    return linked.groupBy("rule_id", "owasp_id", "owasp_url", "owasp_llm_url").agg(F.count("*").alias("n_findings"))


def sql_rank(values) -> str:
    return "CASE severity " + " ".join(f"WHEN {n} THEN {sql.q(v)}" for n, v in enumerate(values)) + " END"


@query("display_columns", over_findings(
    f"SELECT scan_id, rule_id, file_path, line_number, severity_name, {sql_rank(fnd.SARIF_LEVELS)} AS sarif_level, "
    f"{sql_rank(fnd.SECURITY_SEVERITY)} AS security_severity, substring(fingerprint, 1, 12) AS short_fingerprint FROM findings"
))
def display_columns(spark, sf_dir):
    return fnd.with_display(seeded(spark, sf_dir)[2]).select(
        "scan_id", "rule_id", "file_path", "line_number", "severity_name", "sarif_level", "security_severity", "short_fingerprint"
    )


# ---- counts and scores ------------------------------------------------------------------

N_COLUMNS = [f"n_{n.lower()}" for n in SEVERITIES]


@query("severity_counts", over_findings(f"SELECT scan_id, {columns(N_COLUMNS)} FROM counts", more=f"{SCANS}, {COUNTS}"))
def severity_counts(spark, sf_dir):
    _, scans, findings = seeded(spark, sf_dir)
    return sc.severity_counts(scans, findings).select("scan_id", *N_COLUMNS)


@query("score_breakdown", over_findings(
    " UNION ALL ".join(
        f"SELECT scan_id, {SEVERITY_RANK[n]} AS severity, '{n}' AS severity_name, n_{n.lower()} AS \"count\", "
        f"{sc.WEIGHTS[n]} AS weight, n_{n.lower()} * {sc.WEIGHTS[n]} AS raw_deduction, {sc.CAPS[n]} AS cap, "
        f"CAST({_DEDUCT[n]} AS INTEGER) AS applied_deduction FROM counts"
        for n in SEVERITIES
    ),
    more=f"{SCANS}, {COUNTS}",
))
def score_breakdown(spark, sf_dir):
    _, scans, findings = seeded(spark, sf_dir)
    return sc.score_breakdown(scans, findings)


def family_scans(spark, sf_dir):
    """A scan per path of the seeded corpus: scores spread over the whole range and every label occurs."""
    files = corpus.seeded(spark, sf_dir)
    by_file = files.withColumn("scan_id", F.col("path"))
    scans = by_file.groupBy("scan_id").agg(F.count("*").alias("files_scanned"))
    return scans, detect(by_file)


FAMILY = sql.prelude(
    CATALOG,
    sql.seeded_files().replace("'run' || CAST(doc_id // 100 AS VARCHAR) AS scan_id", "'app/m' || CAST(n AS VARCHAR) || '/' || name AS scan_id"),
)


@query("score", over_findings(
    f"SELECT scan_id, files_scanned, score, {label_case(1)} AS label, {label_case(2)} AS label_text FROM scored",
    more=f"{SCANS}, {COUNTS}, {SCORED}",
))
def score(spark, sf_dir):
    _, scans, findings = seeded(spark, sf_dir)
    return sc.score(scans, findings).select("scan_id", "files_scanned", "score", "label", "label_text")


@query("score_label", FAMILY + f", {SCANS}, {COUNTS}, {SCORED} SELECT scan_id, score, {label_case(1)} AS label, {label_case(3)} AS label_short FROM scored")
def score_label(spark, sf_dir):
    scans, findings = family_scans(spark, sf_dir)
    return sc.score(scans, findings).select("scan_id", "score", "label", "label_short")


@query("summary", over_findings(
    "SELECT scan_id, n_critical + n_high + n_medium + n_low + n_info AS total, n_critical AS critical, n_high AS high, "
    "n_medium AS medium, n_low AS low, n_info AS info FROM counts",
    more=f"{SCANS}, {COUNTS}",
))
def summary(spark, sf_dir):
    _, scans, findings = seeded(spark, sf_dir)
    return sc.summary(scans, findings)


@query("findings_by_severity", over_findings(
    "SELECT scan_id, severity, count(*) AS n_findings, count(DISTINCT rule_id) AS n_rules, min(file_path) AS first_path "
    "FROM findings GROUP BY ALL"
))
def findings_by_severity(spark, sf_dir):
    return sc.findings_by_severity(seeded(spark, sf_dir)[2])


FIRST = (
    "QUALIFY row_number() OVER (PARTITION BY scan_id, rule_id ORDER BY severity DESC, file_path, line_number, rule_ordinal, pos) = 1"
)


@query("rules_fired", over_findings(
    f"SELECT scan_id, rule_id, file_path, line_number, fingerprint FROM findings {FIRST}"
))
def rules_fired(spark, sf_dir):
    return sc.rules_fired(seeded(spark, sf_dir)[2]).select("scan_id", "rule_id", "file_path", "line_number", "fingerprint")


@query("distinct_fingerprints", over_findings("SELECT DISTINCT scan_id, fingerprint FROM findings"))
def distinct_fingerprints(spark, sf_dir):
    return history.distinct_fingerprints(seeded(spark, sf_dir)[2])


@query("rule_rollup", over_findings(
    "SELECT category, rule_id, count(*) AS n_findings, max(severity) AS worst_severity, "
    "CAST(grouping(category, rule_id) AS BIGINT) AS level FROM findings GROUP BY ROLLUP (category, rule_id)"
))
def rule_rollup(spark, sf_dir):
    named = seeded(spark, sf_dir)[2].withColumn("category", F.regexp_extract("rule_id", "^[A-Z]+", 0))
    return sc.rollup(named, "category", "rule_id").withColumn("level", F.col("level").cast("long"))


@query("rule_by_severity", over_findings(
    "SELECT rule_id, count(*) AS n_total, " + ", ".join(
        f"count(*) FILTER (WHERE severity = {SEVERITY_RANK[n]}) AS n_{n.lower()}" for n in SEVERITIES
    ) + " FROM findings GROUP BY rule_id"
))
def rule_by_severity(spark, sf_dir):
    return sc.rule_by_severity(seeded(spark, sf_dir)[2])


@query("top_rules", over_findings(
    "SELECT rule_id, rule_name, count(*) AS n_findings FROM findings GROUP BY ALL ORDER BY n_findings DESC, rule_id LIMIT 10"
))
def top_rules(spark, sf_dir):
    return sc.top_rules(seeded(spark, sf_dir)[2], 10)


@query(
    "evaluate",
    "WITH hit AS (SELECT DISTINCT doc_id FROM documents WHERE regexp_matches(text, 'token = \"[0-9a-f]{32,}\"') "
    "OR regexp_matches(text, '[0-9a-zA-Z._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')), "
    "c AS (SELECT count(*) FILTER (WHERE h.doc_id IS NOT NULL AND toxic = 1) AS tp, "
    "count(*) FILTER (WHERE h.doc_id IS NOT NULL AND toxic <> 1) AS fp, count(*) FILTER (WHERE h.doc_id IS NULL AND toxic = 1) AS fn, "
    "count(*) FILTER (WHERE h.doc_id IS NULL AND toxic <> 1) AS tn FROM labels l LEFT JOIN hit h ON l.doc_id = h.doc_id) "
    "SELECT *, CASE WHEN tp + fp <> 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END AS precision, "
    "CASE WHEN tp + fn <> 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END AS recall, "
    "CASE WHEN fp + tn <> 0 THEN CAST(fp AS DOUBLE) / (fp + tn) END AS fpr FROM c",
)
def evaluate(spark, sf_dir):
    found = detect(corpus.documents(spark, sf_dir), OWN_RULES[:2], keep=["doc_id"])
    truth = corpus.table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("positive"))
    return audit.evaluate(found, truth, "doc_id")


# ---- history ----------------------------------------------------------------------------

PAIRS = (
    "ordered AS (SELECT scan_id, lag(scan_id) OVER (ORDER BY saved_at, scan_id) AS previous_scan FROM scans), "
    "held AS (SELECT DISTINCT scan_id, fingerprint FROM findings), "
    "now_side AS (SELECT o.scan_id, o.previous_scan, h.fingerprint FROM ordered o JOIN held h ON h.scan_id = o.scan_id), "
    "old_side AS (SELECT o.scan_id, o.previous_scan, h.fingerprint FROM ordered o JOIN held h ON h.scan_id = o.previous_scan), "
    "changes AS (SELECT coalesce(n.scan_id, p.scan_id) AS scan_id, coalesce(n.previous_scan, p.previous_scan) AS previous_scan, "
    "coalesce(n.fingerprint, p.fingerprint) AS fingerprint, CASE WHEN p.fingerprint IS NULL THEN 'new' "
    "WHEN n.fingerprint IS NULL THEN 'resolved' ELSE 'persistent' END AS status FROM now_side n FULL JOIN old_side p "
    "ON n.scan_id = p.scan_id AND n.fingerprint = p.fingerprint)"
)
HISTORY = f"{SCANS}, {PAIRS}"


@query("consecutive_diff", over_findings("SELECT scan_id, previous_scan, fingerprint, status FROM changes", more=HISTORY))
def consecutive_diff(spark, sf_dir):
    _, scans, findings = seeded(spark, sf_dir)
    return history.diff_consecutive(scans, findings)


@query("diff_counts", over_findings(
    "SELECT scan_id, count(*) FILTER (WHERE status = 'new') AS n_new, count(*) FILTER (WHERE status = 'resolved') AS n_resolved, "
    "count(*) FILTER (WHERE status = 'persistent') AS n_persistent FROM changes GROUP BY scan_id", more=HISTORY))
def diff_counts(spark, sf_dir):
    _, scans, findings = seeded(spark, sf_dir)
    return history.diff_counts(history.diff_consecutive(scans, findings))


TWO = "two AS (SELECT fingerprint, bool_or(scan_id = 'run1') AS cur, bool_or(scan_id = 'run0') AS prev FROM findings WHERE scan_id IN ('run0', 'run1') GROUP BY fingerprint)"
for _status, _where in {"new": "cur AND NOT prev", "resolved": "prev AND NOT cur", "persistent": "cur AND prev"}.items():

    @query(f"diff_{_status}", over_findings(f"SELECT fingerprint, '{_status}' AS status FROM two WHERE {_where}", more=TWO))
    def _diff(spark, sf_dir, status=_status):
        return history.diff(seeded(spark, sf_dir)[2], "run0", "run1").filter(F.col("status") == status)


@query("diff_without_past", over_findings("SELECT DISTINCT fingerprint, 'new' AS status FROM findings WHERE scan_id = 'run1'"))
def diff_without_past(spark, sf_dir):
    return history.diff(seeded(spark, sf_dir)[2], None, "run1")


TREND = f"{SCANS}, {COUNTS}, {SCORED}"


@query("latest_scans", over_findings(
    "SELECT scan_id, score, CAST(row_number() OVER (ORDER BY saved_at DESC, scan_id DESC) AS INTEGER) AS recency FROM scored "
    "QUALIFY row_number() OVER (ORDER BY saved_at DESC, scan_id DESC) <= 3", more=TREND))
def latest_scans(spark, sf_dir):
    _, scans, findings = seeded(spark, sf_dir)
    return history.latest_scans(sc.score(scans, findings), 3).select("scan_id", "score", "recency")


@query("score_trend", over_findings(
    "SELECT scan_id, strftime(saved_at, '%Y-%m-%d %H:%M:%S') AS saved_at, score, "
    f"score - lag(score) OVER (ORDER BY saved_at, scan_id) AS delta, {label_case(3)} AS label_short FROM scored", more=TREND))
def score_trend(spark, sf_dir):
    _, scans, findings = seeded(spark, sf_dir, rule_ids=None)
    scored = state.materialize(sc.score(scans, findings), "scores")
    trend = history.score_trend(scored).drop("project")
    return trend.withColumn("saved_at", F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss"))


@query("trend_caption", sql.prelude(CATALOG) + f", {TREND}, "
    "facts AS (SELECT count(*) AS n, min(score) AS lo, max(score) AS hi, arg_min(score, run_no) AS a, arg_max(score, run_no) AS z FROM scored) "
    "SELECT n AS n_scans, lo AS min_score, hi AS max_score, lo = hi AS is_flat, CASE WHEN n <= 1 THEN '' WHEN lo = hi THEN "
    "'→ Score stable at ' || CAST(lo AS VARCHAR) || '/100 across ' || CAST(n AS VARCHAR) || ' scans.' ELSE "
    "CASE WHEN z > a THEN '↑' WHEN z < a THEN '↓' ELSE '→' END || ' Based on ' || CAST(n AS VARCHAR) || ' scans. Score range: ' "
    "|| CAST(lo AS VARCHAR) || '-' || CAST(hi AS VARCHAR) END AS caption FROM facts")
def trend_caption(spark, sf_dir):
    _, scans, findings = seeded(spark, sf_dir)
    caption = history.trend_caption(sc.score(scans, findings))
    return caption.select("n_scans", "min_score", "max_score", "is_flat", "caption")


@query("load_history", over_findings(
    "SELECT f.scan_id, count(*) AS n_findings, count(DISTINCT fingerprint) AS n_fingerprints FROM findings f JOIN "
    "(SELECT scan_id FROM scans ORDER BY saved_at DESC LIMIT 3) USING (scan_id) GROUP BY ALL", more=SCANS))
def load_history(spark, sf_dir):
    # Saved as two appends, the second of which holds the first ones again, then read back.
    folder = state.new_folder(spark, "history")
    _, scans, findings = kept(spark, sf_dir)
    early = F.col("saved_at") < F.to_timestamp(F.lit("2024-01-01 05:00:00"))
    for part in (scans.filter(early), scans):
        state.save_scans(part, findings.join(part.select("scan_id"), "scan_id", "left_semi"), folder)
    _, loaded = state.load_history(spark, folder, newest=3)
    return loaded.groupBy("scan_id").agg(
        F.count("*").alias("n_findings"), F.countDistinct("fingerprint").alias("n_fingerprints")
    )


@query("compact_history", over_findings(
    "SELECT f.scan_id, count(*) AS n_findings, count(DISTINCT fingerprint) AS n_fingerprints FROM findings f JOIN scans USING (scan_id) GROUP BY ALL",
    more=SCANS))
def compact_history(spark, sf_dir):
    # Saved twice, the first time with findings that the second save replaces, then rewritten.
    folder = state.new_folder(spark, "history")
    _, scans, findings = kept(spark, sf_dir)
    state.save_scans(scans, findings.withColumn("fingerprint", F.reverse("fingerprint")), folder)
    state.save_scans(scans, findings, folder)
    state.compact_history(spark, folder)
    _, loaded = state.load_history(spark, folder)
    return loaded.groupBy("scan_id").agg(
        F.count("*").alias("n_findings"), F.countDistinct("fingerprint").alias("n_fingerprints")
    )


@query("load_scan_documents", over_findings(
    "SELECT s.scan_id, score, strftime(saved_at, '%Y-%m-%d %H:%M:%S') AS saved_at, count(DISTINCT fingerprint) AS n_fingerprints "
    "FROM scored s LEFT JOIN findings f ON f.scan_id = s.scan_id GROUP BY ALL", more=TREND))
def load_scan_documents(spark, sf_dir):
    # A saved document per scan; every second one has no list of fingerprints of its own.
    _, scans, findings = kept(spark, sf_dir)
    prints = findings.groupBy("scan_id").agg(F.collect_list(F.struct("rule_id", "fingerprint")).alias("findings"))
    scored = sc.score(scans, findings).join(prints, "scan_id", "left")
    noted = F.when(F.substring("scan_id", -1, 1).isin(*"02468"), F.col("findings.fingerprint"))
    meta = F.struct(F.date_format("saved_at", "yyyy-MM-dd_HHmmss_SSSSSS").alias("saved_at"), noted.alias("fingerprints"))
    value = F.struct(F.col("score").alias("value")).alias("score")
    text = F.to_json(F.struct("target", "profile", "files_scanned", value, "findings", meta.alias("_meta")))
    loaded, held = state.parse_scan_documents(scored.select("scan_id", text.alias("value")))
    counts = held.groupBy("scan_id").agg(F.count("*").alias("n_fingerprints"))
    return loaded.join(counts, "scan_id", "left").fillna({"n_fingerprints": 0}).select(
        "scan_id", "score", F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss").alias("saved_at"), "n_fingerprints"
    )


# ---- suppressions -----------------------------------------------------------------------

MARKED_SQL = "suppressions AS (SELECT DISTINCT fingerprint FROM findings WHERE substring(fingerprint, 1, 1) IN ('0', '1', '2', '3'))"


def suppressions_of(findings: DataFrame) -> DataFrame:
    """A suppression for every fingerprint that starts with one of four digits."""
    chosen = findings.filter(F.substring("fingerprint", 1, 1).isin("0", "1", "2", "3"))
    return chosen.groupBy("fingerprint").agg(
        F.min(F.concat(F.lit("known "), "rule_id")).alias("reason"),
        F.lit("ann").alias("reviewer"),
        F.to_date(F.lit("2024-02-01")).alias("date"),
    )


@query("suppressed_status", over_findings(
    "SELECT f.scan_id, f.fingerprint, f.line_number, CASE WHEN s.fingerprint IS NOT NULL THEN 'suppressed' "
    "WHEN c.status = 'new' THEN 'new' ELSE 'existing' END AS status FROM findings f LEFT JOIN suppressions s USING (fingerprint) "
    "LEFT JOIN changes c ON c.scan_id = f.scan_id AND c.fingerprint = f.fingerprint", more=f"{HISTORY}, {MARKED_SQL}"))
def suppressed_status(spark, sf_dir):
    _, scans, findings = kept(spark, sf_dir)
    changes = history.diff_consecutive(scans, findings)
    marked = suppress.with_status(findings, changes, suppressions_of(findings))
    return marked.select("scan_id", "fingerprint", "line_number", "status")


@query("suppressed_count", over_findings(
    "SELECT s.scan_id, count(m.fingerprint) AS n_suppressed FROM scans s LEFT JOIN findings f ON f.scan_id = s.scan_id "
    "LEFT JOIN suppressions m ON m.fingerprint = f.fingerprint GROUP BY s.scan_id", more=f"{SCANS}, {MARKED_SQL}"))
def suppressed_count(spark, sf_dir):
    _, scans, findings = kept(spark, sf_dir)
    return suppress.suppressed_count(scans, findings, suppressions_of(findings))


@query("is_suppressed", over_findings(
    f"SELECT {columns(SHORT)} FROM findings WHERE fingerprint IN (SELECT fingerprint FROM suppressions)", more=MARKED_SQL))
def is_suppressed(spark, sf_dir):
    findings = kept(spark, sf_dir)[2]
    return suppress.suppressed(findings, suppressions_of(findings)).select(*SHORT)


@query("add_suppression", over_findings(
    "SELECT fingerprint, 'known ' || min(rule_id) AS reason, 'ann' AS reviewer, '2024-02-01' AS date FROM findings "
    "WHERE fingerprint IN (SELECT fingerprint FROM suppressions) GROUP BY fingerprint UNION ALL "
    "SELECT fingerprint, min(scan_id) AS reason, 'bob' AS reviewer, '2024-03-01' AS date FROM findings "
    "WHERE rule_id = 'CRY007' AND fingerprint NOT IN (SELECT fingerprint FROM suppressions) GROUP BY fingerprint", more=MARKED_SQL))
def add_suppression(spark, sf_dir):
    findings = kept(spark, sf_dir)[2]
    new = findings.filter("rule_id = 'CRY007'").select(
        "fingerprint", F.col("scan_id").alias("reason"), F.lit("bob").alias("reviewer"), F.to_date(F.lit("2024-03-01")).alias("date")
    )
    return suppress.add_suppressions(suppressions_of(findings), new).withColumn("date", F.col("date").cast("string"))


@query("remove_suppression", over_findings(
    "SELECT fingerprint FROM suppressions WHERE fingerprint NOT IN (SELECT fingerprint FROM findings WHERE scan_id = 'run0')",
    more=MARKED_SQL))
def remove_suppression(spark, sf_dir):
    findings = kept(spark, sf_dir)[2]
    gone = findings.filter("scan_id = 'run0'").select("fingerprint").distinct()
    return suppress.remove_suppressions(suppressions_of(findings), gone).select("fingerprint")


@query("remove_suppression_report", over_findings(
    "SELECT DISTINCT fingerprint, fingerprint IN (SELECT fingerprint FROM suppressions) AS removed FROM findings "
    "WHERE scan_id = 'run0'", more=MARKED_SQL))
def remove_suppression_report(spark, sf_dir):
    findings = kept(spark, sf_dir)[2]
    return suppress.removed_any(suppressions_of(findings), findings.filter("scan_id = 'run0'"))


@query("save_suppressions", over_findings(
    "SELECT fingerprint, 'known ' || min(rule_id) AS reason, 'ann' AS reviewer, '2024-02-01' AS date FROM findings "
    "WHERE fingerprint IN (SELECT fingerprint FROM suppressions) "
    "AND fingerprint NOT IN (SELECT fingerprint FROM findings WHERE scan_id = 'run0') GROUP BY fingerprint UNION ALL "
    "SELECT fingerprint, min(scan_id) AS reason, 'bob' AS reviewer, '2024-03-01' AS date FROM findings "
    "WHERE rule_id = 'CRY007' AND fingerprint NOT IN (SELECT fingerprint FROM suppressions) "
    "AND fingerprint NOT IN (SELECT fingerprint FROM findings WHERE scan_id = 'run0') GROUP BY fingerprint", more=MARKED_SQL))
def save_suppressions(spark, sf_dir):
    # Two versions of a folder: the entries, then what was added to and removed from them.
    findings = kept(spark, sf_dir)[2]
    folder = state.new_folder(spark, "suppressions")
    state.save_suppressions(suppressions_of(findings), folder)
    new = findings.filter("rule_id = 'CRY007'").select(
        "fingerprint", F.col("scan_id").alias("reason"), F.lit("bob").alias("reviewer"), F.to_date(F.lit("2024-03-01")).alias("date")
    )
    state.change_suppressions(spark, folder, new, findings.filter("scan_id = 'run0'"))
    return state.load_saved_suppressions(spark, folder).withColumn("date", F.col("date").cast("string"))


@query("load_suppressions", "SELECT sha256(text) AS fingerprint, 'doc ' || CAST(doc_id AS VARCHAR) AS reason, '2024-02-03' AS date "
    "FROM documents WHERE doc_id % 3 <> 0")
def load_suppressions(spark, sf_dir):
    # A JSON document per text; every third one is damaged and so counts as empty.
    docs = corpus.table(spark, sf_dir, "documents")
    entry = F.struct(
        F.sha2(F.col("text").cast("binary"), 256).alias("fingerprint"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("reason"),
        F.lit("2024-02-03").alias("date"),
    )
    whole = F.to_json(F.array(entry))
    damaged = F.substring(whole, F.lit(1), F.length(whole) - 3)
    texts = docs.select(F.when(F.col("doc_id") % 3 == 0, damaged).otherwise(whole).alias("value"))
    parsed = state.parse_suppressions(texts)
    return parsed.select("fingerprint", "reason", F.col("date").cast("string").alias("date"))


# ---- profiles and gates -----------------------------------------------------------------


# The built-in profiles, and ones without prefixes, with a part of a family, and with one family.
PROFILES = [
    *state.BUILT_IN_PROFILES,
    {"name": "open", "min_severity": "MEDIUM"},
    {"name": "some", "min_severity": "LOW", "enabled_rule_prefixes": ["DEP1", "SEC"], "severity_overrides": {"DEP103": "HIGH"}},
]
PROFILED = (*CATALOG, TOKEN_RULE)  # with a rule of a family that no profile lists


def _profile_sql() -> str:
    rows, overrides = [], []
    for p in PROFILES:
        prefixes = ", ".join(sql.q(x) for x in p.get("enabled_rule_prefixes", []))
        rows.append(f"('{p['name']}', {SEVERITY_RANK[p['min_severity']]}, CAST([{prefixes}] AS VARCHAR[]))")
        overrides += [f"('{p['name']}', '{k}', {SEVERITY_RANK[v]})" for k, v in p.get("severity_overrides", {}).items()]
    families = ", ".join(sql.q(f) for f in policy.FAMILIES)
    return (
        f"profiles(profile, min_severity, prefixes) AS (VALUES {', '.join(rows)}), "
        f"overrides(profile, rule_id, rank) AS (VALUES {', '.join(overrides)}), "
        "seen AS (SELECT p.profile, f.* EXCLUDE (severity), f.severity AS base_severity, coalesce(o.rank, f.severity) AS severity, "
        "p.min_severity FROM findings f CROSS JOIN profiles p LEFT JOIN overrides o ON o.profile = p.profile AND o.rule_id = f.rule_id "
        f"WHERE len(p.prefixes) = 0 OR regexp_extract(f.rule_id, '^[A-Z]+') NOT IN ({families}) "
        "OR len([x for x in p.prefixes if starts_with(f.rule_id, x)]) > 0)"
    )


@query("apply_profile", over_findings(
    "SELECT profile, scan_id, rule_id, file_path, line_number, severity, base_severity FROM seen "
    "WHERE severity >= min_severity AND profile = 'some'", PROFILED, _profile_sql()))
def apply_profile(spark, sf_dir):
    seen = policy.apply_profile(detect(corpus.seeded(spark, sf_dir), PROFILED), state.profiles_of(spark, PROFILES), "some")
    return seen.select("profile", "scan_id", "rule_id", "file_path", "line_number", "severity", "base_severity")


@query("profile_join", over_findings(
    "SELECT profile, severity, count(*) AS n_findings, count(*) FILTER (WHERE severity <> base_severity) AS n_raised "
    "FROM seen WHERE severity >= min_severity GROUP BY ALL", PROFILED, _profile_sql()))
def profile_join(spark, sf_dir):
    seen = policy.apply_profile(detect(corpus.seeded(spark, sf_dir), PROFILED), state.profiles_of(spark, PROFILES))
    return seen.groupBy("profile", "severity").agg(
        F.count("*").alias("n_findings"), F.count_if(F.col("severity") != F.col("base_severity")).alias("n_raised")
    )


@query("load_profiles", "SELECT 'p' || CAST(doc_id AS VARCHAR) AS name, CASE doc_id % 3 WHEN 0 THEN 3 ELSE 1 END AS min_severity, "
    "1 AS n_overrides, CASE doc_id % 2 WHEN 0 THEN 4 ELSE 0 END AS override_rank FROM documents")
def load_profiles(spark, sf_dir):
    # A JSON profile per document; unknown severities fall away or fall back to LOW.
    docs = corpus.table(spark, sf_dir, "documents")
    least = F.get(F.array(F.lit("HIGH"), F.lit("LOUD"), F.lit(None)), (F.col("doc_id") % 3).cast("int"))
    known = F.when(F.col("doc_id") % 2 == 0, F.lit("CRITICAL")).otherwise(F.lit("INFO"))
    text = F.to_json(F.struct(
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("name"),
        least.alias("min_severity"),
        F.create_map(F.lit("CFG001"), known, F.lit("CFG002"), F.lit("SEVERE")).alias("severity_overrides"),
    ))
    parsed = state.parse_profiles(docs.select(text.alias("value")))
    return parsed.select(
        "name", "min_severity", F.size("severity_overrides").alias("n_overrides"),
        F.try_element_at("severity_overrides", F.lit("CFG001")).alias("override_rank"),
    )


@query("gate", FAMILY + f", {SCANS} SELECT s.scan_id, coalesce(bool_or(f.severity IN (4, 3)), FALSE) AS failed "
    "FROM scans s LEFT JOIN findings f ON f.scan_id = s.scan_id GROUP BY s.scan_id")
def gate(spark, sf_dir):
    scans, findings = family_scans(spark, sf_dir)
    return policy.gate(scans, findings)


@query("gate_new_only", sql.prelude(CATALOG) + f", {HISTORY} "
    "SELECT s.scan_id, coalesce(bool_or(c.status = 'new' AND f.severity IN (4, 3)), FALSE) AS failed FROM scans s "
    "LEFT JOIN findings f ON f.scan_id = s.scan_id LEFT JOIN changes c ON c.scan_id = f.scan_id AND c.fingerprint = f.fingerprint "
    "GROUP BY s.scan_id")
def gate_new_only(spark, sf_dir):
    _, scans, findings = kept(spark, sf_dir)
    return policy.gate_new_only(scans, findings)


# ---- package names ----------------------------------------------------------------------

NAMES_RULE = select_rules(rule_ids=("DEP105",))
NAMED = (
    f"named AS (SELECT scan_id, path, CAST(line_number AS INTEGER) AS line_number, regexp_extract({sql.strip('line')}, "
    f"{sql.q('(?i)' + packages.NAME)}, 1) AS package FROM lines WHERE {sql.gate(NAMES_RULE[0])} AND contains(base, 'requirement') AND NOT starts_with({sql.strip('line')}, '#')), "
    "normed AS (SELECT *, replace(replace(lower(package), '-', '_'), '.', '_') AS package_norm FROM named WHERE package <> '')"
)


def requirement_lines(spark, sf_dir) -> DataFrame:
    return packages.requirement_names(tables.explode_lines(packages.requirement_files(corpus.seeded(spark, sf_dir))))


@query("denylist_join", sql.prelude(NAMES_RULE) + f", {NAMED} SELECT scan_id, path, line_number, package, package_norm, typo, d.legit "
    "FROM normed JOIN deny d ON package_norm = d.typo_norm")
def denylist_join(spark, sf_dir):
    return packages.denied(requirement_lines(spark, sf_dir), packages.denylist_table(spark))


@query("alias_skip", sql.prelude(NAMES_RULE) + f", {NAMED} SELECT package_norm, count(*) AS n FROM normed WHERE package_norm NOT IN ("
    + ", ".join(sql.q(a) for a in packages.ALIASES) + ") GROUP BY ALL")
def alias_skip(spark, sf_dir):
    kept = packages.skip_aliases(requirement_lines(spark, sf_dir), packages.alias_table(spark))
    return kept.groupBy("package_norm").agg(F.count("*").alias("n"))


# ---- text masks and identity ------------------------------------------------------------


def mask_query(name: str, masks: tuple[str, ...]) -> None:
    """Register a mask over the whole texts of two tables."""
    branch = "SELECT '{0}' AS origin, {1} AS id, md5(m) AS masked_hash, m <> t AS changed FROM (SELECT *, text AS t, {2} AS m FROM {0})"
    masked = sql.mask_text("text", masks)
    docs = branch.format("documents", "CAST(doc_id AS VARCHAR)", masked)
    talk = branch.format("conversations", "CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)", masked)

    @query(name, f"{docs} UNION ALL {talk}")
    def run(spark, sf_dir):
        def side(table: str, key: Column) -> DataFrame:
            text = redact.redact_text(F.col("text"), masks)
            rows = corpus.texts(spark, sf_dir, table).select(key.alias("id"), "text", text.alias("masked"))
            return rows.select(
                F.lit(table).alias("origin"), "id", F.md5(F.col("masked").cast("binary")).alias("masked_hash"),
                (F.col("masked") != F.col("text")).alias("changed"),
            )

        talk_id = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        return side("documents", F.col("doc_id").cast("string")).unionByName(side("conversations", talk_id))


mask_query("redact_pii", ("email", "number", "ssn"))
mask_query("redact_email", ("email",))
mask_query("redact_ssn", ("ssn",))

SEC_RULES = select_rules(prefixes=["SEC"])


def _mask_secrets_sql(text: str) -> str:
    for rule in SEC_RULES:
        for pattern in rule.patterns:
            text = f"regexp_replace({text}, {sql.q(pattern)}, '[REDACTED]', 'g')"
    return text


@query("redact_secrets", f"WITH {sql.seeds_cte()} SELECT scan_id, path, md5({_mask_secrets_sql('content')}) AS masked_hash FROM ({sql.seeded_files()})")
def redact_secrets(spark, sf_dir):
    files = corpus.seeded(spark, sf_dir)
    masked = redact.redact_secrets(F.col("content"))
    return files.select("scan_id", "path", F.md5(masked.cast("binary")).alias("masked_hash"))


@query("fingerprint", "SELECT doc_id, " + sql.fingerprint("'./Src\\D' || CAST(doc_id AS VARCHAR) || '.PY'", "'abc001'", "text") + " AS fingerprint, "
    "substring(" + sql.fingerprint("'./Src\\D' || CAST(doc_id AS VARCHAR) || '.PY'", "'abc001'", "text") + ", 1, 12) AS short FROM documents")
def fingerprint_query(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents")
    path = F.concat(F.lit("./Src\\D"), F.col("doc_id").cast("string"), F.lit(".PY"))
    value = fingerprint(path, F.lit(" abc001 "), F.col("text"))
    return docs.select("doc_id", value.alias("fingerprint")).withColumn("short", short_fingerprint(F.col("fingerprint")))


@query("normalize_path", f"WITH {TREE} SELECT scan_id, path, lower(path) AS normal FROM tree")
def normalize_path_query(spark, sf_dir):
    odd = F.concat(F.lit("././"), F.replace("path", F.lit("/"), F.lit("\\")))
    return tree(spark, sf_dir).select("scan_id", "path", normalize_path(odd).alias("normal"))


@query("normalize_snippet", "SELECT doc_id, md5(lower(" + sql.strip("regexp_replace(text, '\\s+', ' ', 'g')") + ")) AS normal_hash FROM documents")
def normalize_snippet_query(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(normalize_snippet(F.col("text")).cast("binary")).alias("normal_hash"))


@query("normalize_package", "SELECT page_id, replace(replace(lower(url), '-', '_'), '.', '_') AS normal FROM pages")
def normalize_package_query(spark, sf_dir):
    return corpus.table(spark, sf_dir, "pages").select("page_id", normalize_package(F.col("url")).alias("normal"))


@query("severity_names", "SELECT doc_id, CASE doc_id % 6 WHEN 5 THEN NULL ELSE CAST(doc_id % 6 AS INTEGER) END AS rank FROM documents")
def severity_names(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents")
    names = F.array(*[F.lit(f" {n.lower()} ") for n in SEVERITIES], F.lit("severe"))
    return docs.select("doc_id", severity_rank(F.get(names, (F.col("doc_id") % 6).cast("int"))).alias("rank"))


@query("to_uri", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'file:///a%20b/%C3%A9%2Bx~/' || CAST(doc_id AS VARCHAR) || '.py' "
    "ELSE 'a b/é/' || CAST(doc_id AS VARCHAR) || '.py' END AS uri FROM documents")
def to_uri_query(spark, sf_dir):
    docs = corpus.table(spark, sf_dir, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".py"))
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/a b/é+x~/"), name)).otherwise(F.concat(F.lit("a b\\é\\"), name))
    return docs.select("doc_id", to_uri(path).alias("uri"))


@query(
    "text_uris",
    "SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, md5('file:///' || replace(url_encode(text), '%2F', '/')) AS uri_hash FROM documents UNION ALL "
    "SELECT 'p' || CAST(page_id AS VARCHAR), md5('file:///' || replace(url_encode(url), '%2F', '/')) FROM pages UNION ALL "
    "SELECT 't' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), md5(replace(text, chr(92), '/')) FROM conversations",
)
def text_uris(spark, sf_dir):
    # Whole texts in four languages as names of files: what a URI must encode, they hold.
    def named(table: str, key: Column, path: Column) -> DataFrame:
        rows = corpus.table(spark, sf_dir, table)
        return rows.select(key.alias("id"), F.md5(to_uri(path).cast("binary")).alias("uri_hash"))

    text = F.col("text")
    docs = named("documents", F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.concat(F.lit("/"), text))
    pages = named("pages", F.concat(F.lit("p"), F.col("page_id").cast("string")), F.concat(F.lit("/"), F.col("url")))
    turns = named("conversations", F.concat(F.lit("t"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")), text)
    return docs.unionByName(pages).unionByName(turns)


_NAMED = " ".join(f"WHEN '{name}' THEN {rank}" for name, rank in SEVERITY_RANK.items())


@query(
    "severity_words",
    "WITH words AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents), "
    f"ranked AS (SELECT upper(word) AS name, CASE upper(word) {_NAMED} END AS rank FROM words) "
    "SELECT name, rank, count(*) AS n FROM ranked GROUP BY ALL",
)
def severity_words(spark, sf_dir):
    # Every word of every text is tried as a severity name, in the case in which it stands.
    words = corpus.table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    ranked = words.groupBy("word").agg(F.count("*").alias("n")).select(F.upper("word").alias("name"), severity_rank(F.col("word")).alias("rank"), "n")
    return ranked.groupBy("name", "rank").agg(F.sum("n").alias("n"))


@query("message_format", over_findings("SELECT rule_id, message, count(*) AS n FROM findings GROUP BY ALL", select_rules(rule_ids=("DEP104", "DEP105"))))
def message_format(spark, sf_dir):
    return seeded(spark, sf_dir, rule_ids=("DEP104", "DEP105"))[2].groupBy("rule_id", "message").agg(F.count("*").alias("n"))


# ---- documents --------------------------------------------------------------------------


def sql_json(value: str) -> str:
    """A JSON string, or null."""
    return f"coalesce(CAST(to_json({value}) AS VARCHAR), 'null')"


def sql_object(fields: dict[str, str]) -> str:
    return "'{' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in fields.items()) + " || '}'"


FINDING_JSON = sql_object(
    {"rule_id": sql_json("rule_id"), "rule_name": sql_json("rule_name"), "severity": sql_json("severity_name")}
    | {"file_path": sql_json("file_path"), "line_number": "CAST(line_number AS VARCHAR)"}
    | {c: sql_json(c) for c in FINDING[6:]}
)


@query("findings_json", over_findings(f"SELECT scan_id, {FINDING_JSON} AS document FROM findings"))
def findings_json(spark, sf_dir):
    return report.finding_json(seeded(spark, sf_dir)[2]).select("scan_id", "document")


EMBED_JSON = sql_object(
    {"rule_id": sql_json("rule_id"), "rule_name": sql_json("rule_name"), "severity": sql_json("severity_name")}
    | {"file_path": sql_json("file_path"), "line_number": "CAST(line_number AS VARCHAR)"}
    | {c: sql_json(c) for c in ("message", "fix", "snippet", "fingerprint")}
    | {"cwe_id": sql_json("coalesce(cwe_id, '')"), "confidence": sql_json("confidence"), "owasp_id": sql_json("coalesce(owasp_id, '')")}
    | {"owasp_url": sql_json(sql_url("owasp_id")), "owasp_llm_id": sql_json("coalesce(owasp_llm_id, '')")}
    | {"owasp_llm_url": sql_json(f"CASE WHEN owasp_llm_id IS NULL THEN '' ELSE {sql.q(fnd.OWASP_LLM_URL)} END")}
    | {"guide_url": sql_json("guide_url")}
)


@query("embed_json", over_findings(f"SELECT scan_id, replace({EMBED_JSON}, '</', '<\\/') AS document FROM findings"))
def embed_json(spark, sf_dir):
    return report.embed_json(seeded(spark, sf_dir)[2]).select("scan_id", "document")


def _number(value: str) -> str:
    return f"CAST({value} AS VARCHAR)"


BREAKDOWN_JSON = sql_object({
    n: sql_object({
        "count": _number(f"n_{n.lower()}"), "weight": f"'{sc.WEIGHTS[n]}'", "raw_deduction": _number(f"n_{n.lower()} * {sc.WEIGHTS[n]}"),
        "cap": f"'{sc.CAPS[n]}'", "applied_deduction": _number(_DEDUCT[n]),
    })
    for n in SEVERITIES
})
SUMMARY_JSON = sql_object(
    {"total": _number(" + ".join(N_COLUMNS))} | {n.lower(): _number(f"n_{n.lower()}") for n in reversed(SEVERITIES)}
)
VERSION = report.__version__


@query("report_json", over_findings(
    f"SELECT scan_id, 0 AS part, '{{\"engine_version\":\"{VERSION}\",\"target\":\"app\",\"profile\":\"\",\"files_scanned\":' || "
    f"CAST(files_scanned AS VARCHAR) || ',\"score\":{{\"value\":' || CAST(score AS VARCHAR) || ',\"breakdown\":' || {BREAKDOWN_JSON} "
    "|| '},\"findings\":[' AS fragment FROM scored UNION ALL "
    "SELECT scan_id, 1 AS part, CASE WHEN row_number() OVER (PARTITION BY scan_id ORDER BY severity DESC, file_path, line_number, "
    "rule_ordinal) = 1 THEN '' ELSE ',' END || " + FINDING_JSON + " AS fragment FROM findings UNION ALL "
    f"SELECT scan_id, 2 AS part, '],\"summary\":' || {SUMMARY_JSON} || '}}' AS fragment FROM scored", more=TREND))
def report_json(spark, sf_dir):
    _, scans, findings = kept(spark, sf_dir)
    return report.report_json(scans, findings).select("scan_id", "part", "fragment")


@query("report_documents", ORACLES["report_json"])
def report_documents(spark, sf_dir):
    # All documents through one folder, saved twice and read back.
    _, scans, findings = kept(spark, sf_dir)
    fragments = state.materialize(report.report_json(scans, findings), "documents")
    folder = state.new_folder(spark, "documents")
    saved.save_documents(fragments.filter(F.col("part") != report.BODY), folder)
    saved.save_documents(fragments, folder)
    return saved.read_documents(spark, folder).select("scan_id", "part", "fragment")


@query("report_sarif", over_findings(
    "SELECT scan_id, rule_id, " + sql_rank(fnd.SARIF_LEVELS) + " AS level, message, file_path AS uri, CAST(line_number AS VARCHAR) AS start_line, "
    "snippet, owasp_id AS owasp, owasp_llm_id AS owasp_llm, cwe_id AS cwe, fingerprint, confidence FROM findings"))
def report_sarif(spark, sf_dir):
    # The result fragments, read back as JSON.
    _, scans, findings = kept(spark, sf_dir)
    body = report.report_sarif(scans, findings).filter(F.col("part") == report.BODY)
    text = F.regexp_replace("fragment", "^,", "")

    def field(path: str) -> Column:
        return F.get_json_object(text, "$." + path)

    place = "locations[0].physicalLocation."
    return body.select(
        "scan_id", field("ruleId").alias("rule_id"), field("level").alias("level"), field("message.text").alias("message"),
        field(place + "artifactLocation.uri").alias("uri"), field(place + "region.startLine").alias("start_line"),
        field(place + "region.snippet.text").alias("snippet"), field("properties.owasp").alias("owasp"),
        field("properties.owasp-llm").alias("owasp_llm"), field("properties.cwe").alias("cwe"),
        field("properties.fingerprint").alias("fingerprint"), field("properties.confidence").alias("confidence"),
    )


@query("sarif_heads", over_findings(
    "SELECT s.scan_id, '2.1.0' AS version, '[]' AS results, CAST(score AS VARCHAR) AS score, CAST(files_scanned AS VARCHAR) AS files_scanned, "
    "CAST(count(DISTINCT f.rule_id) AS INTEGER) AS n_rules, min(f.rule_id) AS first_rule FROM scored s LEFT JOIN findings f USING (scan_id) GROUP BY ALL", more=TREND))
def sarif_heads(spark, sf_dir):
    _, scans, findings = kept(spark, sf_dir)
    # Head and tail of a document make one without results.
    edges = report.report_sarif(scans, findings).filter(F.col("part") != report.BODY)
    parts = edges.groupBy("scan_id").agg(
        F.concat(F.max(F.when(F.col("part") == report.HEAD, F.col("fragment"))), F.max(F.when(F.col("part") == report.TAIL, F.col("fragment")))).alias("whole")
    )
    run = "$.runs[0]."
    whole = F.col("whole")
    rules = F.from_json(F.get_json_object(whole, run + "tool.driver.rules"), "array<struct<id:string>>")
    return parts.select(
        "scan_id", F.get_json_object(whole, "$.version").alias("version"),
        F.get_json_object(whole, run + "results").alias("results"), F.get_json_object(whole, run + "properties.score").alias("score"),
        F.get_json_object(whole, run + "properties.filesScanned").alias("files_scanned"),
        F.size(rules).alias("n_rules"), F.get(rules, F.lit(0))["id"].alias("first_rule"),
    )


@query("export_catalog", over_findings(
    "SELECT r.rule_id, coalesce(n_findings, 0) AS n_findings, " + sql_object(
        {"id": sql_json("r.rule_id"), "name": sql_json("r.rule_name"), "severity": sql_json("r.severity_name")}
        | {"description": sql_json("r.description"), "fix": sql_json("r.fix"), "cwe_id": sql_json("coalesce(r.cwe_id, '')")}
        | {"owasp_id": sql_json("coalesce(r.owasp_id, '')"), "owasp_llm_id": sql_json("coalesce(r.owasp_llm_id, '')")}
        | {"confidence": sql_json("r.confidence"), "guide_url": sql_json("r.guide_url"), "file_extensions": "exts"}
    ) + " AS document FROM rules r JOIN exts_of e USING (rule_id) LEFT JOIN (SELECT rule_id, count(*) AS n_findings FROM findings GROUP BY 1) USING (rule_id)",
    more="exts_of(rule_id, exts) AS (VALUES " + ", ".join(
        f"('{r.rule_id}', '[" + ",".join(f'"{e}"' for e in r.extensions) + "]')" for r in CATALOG
    ) + ")"))
def export_catalog(spark, sf_dir):
    # All entries, each with the number of its findings.
    fired = seeded(spark, sf_dir)[2].groupBy("rule_id").agg(F.count("*").alias("n_findings"))
    return report.export_catalog(spark).join(fired, "rule_id", "left").fillna({"n_findings": 0})


# ---- audits -----------------------------------------------------------------------------


@query("determinism_audit", "SELECT CAST(0 AS BIGINT) AS n_different, count(*) AS n_documents FROM documents")
def determinism_audit(spark, sf_dir):
    files = corpus.seeded(spark, sf_dir)
    again = corpus.seeded(spark, sf_dir)  # a second run from the start
    different = audit.determinism_audit(detect(files), detect(again)).select(F.lit(1).alias("d"), F.lit(0).alias("n"))
    both = different.unionByName(files.select(F.lit(0).alias("d"), F.lit(1).alias("n")))
    return both.agg(F.sum("d").alias("n_different"), F.sum("n").alias("n_documents"))


# Marked values whole, and short ones: digit runs of any length.
SECRET = "(?:[A-Za-z0-9_]|-)*Ex4mple(?:[A-Za-z0-9_]|-)*|[0-9]+"
SECRET_WORDS = f"secrets AS (SELECT DISTINCT unnest(regexp_extract_all(content, '{SECRET}')) AS secret FROM files)"


@query("leak_audit", over_findings(
    " UNION ALL ".join(
        f"SELECT DISTINCT scan_id, rule_id, file_path, line_number, secret, '{field}' AS field FROM findings, secrets WHERE contains({field}, secret)"
        for field in ("snippet", "message", "fix")
    ), more=SECRET_WORDS))
def leak_audit(spark, sf_dir):
    files = corpus.seeded(spark, sf_dir)
    words = F.explode(F.regexp_extract_all("content", F.lit(SECRET), F.lit(0)))
    leaks = audit.leak_audit(state.materialize(detect(files), "findings"), files.select(words.alias("secret")))
    return leaks.select("scan_id", "rule_id", "file_path", "line_number", "secret", "field").distinct()


@query("corpus_unchanged_audit",
    f"WITH {sql.seeds_cte()}, f AS ({sql.seeded_files()}) SELECT scan_id, path, CASE doc_id % 3 WHEN 0 THEN 'removed' ELSE 'changed' END AS change, "
    "sha256(content) AS hash_before FROM f WHERE doc_id % 3 <> 2")
def corpus_unchanged_audit(spark, sf_dir):
    before = corpus.seeded(spark, sf_dir)
    after = before.filter(F.col("doc_id") % 3 != 0).withColumn(
        "content", F.when(F.col("doc_id") % 3 == 1, F.concat("content", F.lit("\n"))).otherwise(F.col("content"))
    )
    return audit.corpus_changes(before, after).select("scan_id", "path", "change", "hash_before")


# ---- streams ----------------------------------------------------------------------------

EPOCH = "2024-01-01 00:00:00"


def arriving(spark, sf_dir) -> DataFrame:
    """The seeded corpus as a stream of files, one a minute."""
    schema = corpus.table(spark, sf_dir, "documents").schema
    docs = live.read_stream(spark, f"{sf_dir}/documents*.parquet", schema)
    minute = F.timestamp_add("MINUTE", F.col("doc_id").cast("int"), F.to_timestamp(F.lit(EPOCH)))
    return corpus.with_seeds(docs, minute.alias("arrived_at"))


# The whole catalogue and rules with hits in the prose.
LIVE_RULES = (*CATALOG, *OWN_RULES)
STREAMED = sql.prelude(LIVE_RULES)


def streamed(spark, sf_dir, make: Callable[[DataFrame], DataFrame], update: bool = False) -> DataFrame:
    """Run a stream over all that has arrived and read the table it wrote."""
    folder = state.new_folder(spark, "stream")
    stream = make(live.scan_stream(arriving(spark, sf_dir), LIVE_RULES))
    write = live.upsert_counts if update else live.append_to
    live.run_available(write(stream, f"{folder}/table", f"{folder}/checkpoint"))
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


@query("stream_scan", STREAMED + f"SELECT {columns(SHORT)} FROM findings")
def stream_scan(spark, sf_dir):
    return streamed(spark, sf_dir, lambda found: found.select(*SHORT))


@query("stream_new_findings", STREAMED + "SELECT DISTINCT fingerprint, rule_id FROM findings")
def stream_new_findings(spark, sf_dir):
    return streamed(spark, sf_dir, lambda found: live.new_findings(found).select("fingerprint", "rule_id"))


WINDOWED = (
    ", timed AS (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id AS INTEGER)) AS t FROM findings), "
    "edge AS (SELECT max(t) - INTERVAL 1 HOUR AS mark FROM timed) "
)


@query("stream_severity_windows", STREAMED + WINDOWED +
    "SELECT strftime(time_bucket(INTERVAL 2 HOUR, t, TIMESTAMP '2024-01-01 00:00:00'), '%Y-%m-%d %H:%M:%S') AS window_start, severity, count(*) AS n_findings "
    "FROM timed, edge GROUP BY time_bucket(INTERVAL 2 HOUR, t, TIMESTAMP '2024-01-01 00:00:00'), severity, mark "
    "HAVING time_bucket(INTERVAL 2 HOUR, t, TIMESTAMP '2024-01-01 00:00:00') + INTERVAL 2 HOUR <= mark")
def stream_severity_windows(spark, sf_dir):
    out = streamed(spark, sf_dir, lambda found: live.severity_windows(found, late="1 hour", width="2 hours"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "severity", "n_findings")


@query("stream_sliding_windows", STREAMED + WINDOWED +
    ", hops AS (SELECT severity, mark, time_bucket(INTERVAL 1 HOUR, t, TIMESTAMP '2024-01-01 00:00:00') - to_hours(CAST(h AS INTEGER)) AS s "
    "FROM timed, edge, range(0, 2) r(h)) SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, severity, count(*) AS n_findings "
    "FROM hops WHERE s + INTERVAL 2 HOUR <= mark GROUP BY s, severity")
def stream_sliding_windows(spark, sf_dir):
    out = streamed(spark, sf_dir, lambda found: live.severity_windows(found, late="1 hour", width="2 hours", slide="1 hour"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "severity", "n_findings")


@query("stream_session_windows", STREAMED + WINDOWED +
    ", gaps AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > INTERVAL 20 MINUTE THEN 1 ELSE 0 END AS fresh FROM timed "
    "WINDOW w AS (PARTITION BY severity ORDER BY t)), runs AS (SELECT *, sum(fresh) OVER (PARTITION BY severity ORDER BY t) AS no FROM gaps) "
    "SELECT strftime(min(t), '%Y-%m-%d %H:%M:%S') AS window_start, severity, count(*) AS n_findings FROM runs, edge "
    "GROUP BY severity, no, mark HAVING max(t) + INTERVAL 20 MINUTE <= mark")
def stream_session_windows(spark, sf_dir):
    out = streamed(spark, sf_dir, lambda found: live.severity_windows(found, late="1 hour", gap="20 minutes"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "severity", "n_findings")


@query("stream_score_latest", STREAMED + ", scans AS (SELECT DISTINCT scan_id FROM findings), "
    + COUNTS + ", " + SCORED + f" SELECT scan_id, {columns(N_COLUMNS)}, score FROM scored")
def stream_score_latest(spark, sf_dir):
    return live.latest_scores(streamed(spark, sf_dir, live.running_counts, update=True))


@query("stream_score_changes", STREAMED + ", scans AS (SELECT DISTINCT scan_id FROM findings), "
    + COUNTS + ", " + SCORED + " SELECT scan_id, score FROM scored")
def stream_score_changes(spark, sf_dir):
    return keyed.newest_scores(streamed(spark, sf_dir, keyed.score_changes)).select("scan_id", "score")


@query("stream_sightings", STREAMED + WINDOWED.replace(", edge AS (SELECT max(t) - INTERVAL 1 HOUR AS mark FROM timed)", "")
    + ", before AS (SELECT fingerprint, rule_id, t, lag(t) OVER (PARTITION BY fingerprint ORDER BY t) AS last FROM timed) "
    "SELECT fingerprint, rule_id, CASE WHEN last IS NULL THEN 'first' ELSE 'again' END AS kind, strftime(t, '%Y-%m-%d %H:%M:%S') AS seen_at "
    "FROM before WHERE last IS NULL OR t - last > INTERVAL 3 HOUR")
def stream_sightings(spark, sf_dir):
    out = streamed(spark, sf_dir, lambda found: keyed.sightings(found, horizon="3 hours"))
    return out.select("fingerprint", "rule_id", "kind", F.date_format("seen_at", "yyyy-MM-dd HH:mm:ss").alias("seen_at"))


assert set(ORACLES) <= set(QUERIES) and len(SEEDS) == 100
