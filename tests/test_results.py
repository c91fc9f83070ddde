"""Scores, history, suppressions, profiles, gates, reports and audits."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from riskloom.operators import audit, history, policy, report, score, suppress
from riskloom.operators import findings as fnd
from riskloom.operators.custom import detect_with
from riskloom.operators.detect import detect
from pyspark.sql.window import Window

from riskloom.operators.joins import is_bounded
from riskloom.operators.sequence import with_neighbours
from riskloom.rules import RuleSpec
from riskloom.sources import documents, state, tables

SEVERITY = {"INFO": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


@pytest.mark.parametrize(
    "names,expected",
    [
        ([], 100), (["CRITICAL"], 75), (["CRITICAL"] * 4, 25), (["CRITICAL", "HIGH", "MEDIUM"], 60), (["INFO"] * 9, 100),
        (["CRITICAL"] * 9 + ["HIGH"] * 9 + ["MEDIUM"] * 9 + ["LOW"] * 9, 0), (["LOW"] * 6, 90),
    ],
)
def test_scores(spark, names, expected):
    scans = spark.createDataFrame([("s",)], "scan_id string")
    found = spark.createDataFrame([("s", SEVERITY[n]) for n in names], "scan_id string, severity int")
    assert score.score(scans, found).first().score == expected


@pytest.mark.parametrize("value,label", [(100, "GREEN"), (90, "GREEN"), (89, "YELLOW"), (70, "YELLOW"), (69, "ORANGE"), (40, "ORANGE"), (39, "RED"), (0, "RED")])
def test_labels(spark, value, label):
    assert spark.range(1).select(score.label_column(F.lit(value), 1)).first()[0] == label


@pytest.fixture(scope="module")
def runs(spark):
    rows = [
        ("r1", "a.py", "eval(x)\neval(x)\nhashlib.md5(y)"),
        ("r1", "b.py", "DEBUG = True"),
        ("r2", "a.py", "pad\neval(x)"),
        ("r2", "c.py", "exec(z)"),
        ("r3", "a.py", "clean"),
    ]
    files = spark.createDataFrame(rows, "scan_id string, path string, content string")
    scans = tables.files_scanned(files).withColumns(
        {
            "project": F.lit("p"), "target": F.lit('t"x'), "profile": F.lit(""),
            "saved_at": F.to_timestamp(F.concat(F.lit("2024-01-0"), F.substring("scan_id", 2, 1))),
        }
    )
    return scans.cache(), detect(files).cache()


def test_clean_scan_scores_100(runs):
    got = {r.scan_id: (r.score, r.n_critical) for r in score.score(*runs).collect()}
    assert got == {"r1": (30, 2), "r2": (65, 1), "r3": (100, 0)}


def test_breakdown_and_summary(runs):
    rows = {(r.scan_id, r.severity_name): r for r in score.score_breakdown(*runs).collect()}
    assert len(rows) == 15
    assert rows["r1", "CRITICAL"].applied_deduction == 50 and rows["r3", "HIGH"].applied_deduction == 0
    assert {r.scan_id: r.total for r in score.summary(*runs).collect()} == {"r1": 4, "r2": 2, "r3": 0}


def test_order(runs):
    rows = fnd.order_findings(runs[1].filter("scan_id = 'r1'")).collect()
    assert [(r.rule_id, r.file_path, r.line_number) for r in rows] == [
        ("CRY007", "a.py", 1), ("CRY007", "a.py", 2), ("CRY003", "a.py", 3), ("CFG001", "b.py", 1),
    ]
    assert [r.severity for r in fnd.sort_findings(runs[1], "severity").collect()][0] == 4


def test_search(runs):
    assert fnd.search(runs[1], text="MD5").count() == 1
    assert fnd.search(runs[1], severity="CRITICAL", confidence="medium").count() == 3
    assert fnd.filter_by_severity(runs[1], "bogus").count() == 6


def test_diff_and_collapse_of_equal_lines(runs):
    changes = {r.fingerprint: r.status for r in history.diff(runs[1], "r1", "r2").collect()}
    assert sorted(changes.values()) == ["new", "persistent", "resolved", "resolved"]
    assert {r.status for r in history.diff(runs[1], None, "r2").collect()} == {"new"}


def test_consecutive_diff(runs):
    counts = {r.scan_id: (r.n_new, r.n_resolved, r.n_persistent) for r in history.diff_counts(history.diff_consecutive(*runs)).collect()}
    assert counts == {"r1": (3, 0, 0), "r2": (1, 2, 1), "r3": (0, 2, 0)}


def test_trend(runs):
    trend = history.score_trend(score.score(*runs)).orderBy("saved_at").collect()
    assert [(r.score, r.delta, r.label_short) for r in trend] == [(30, None, "CRITICAL"), (65, 35, "ISSUES"), (100, 35, "READY")]
    assert history.trend_caption(score.score(*runs)).first().caption == "↑ Based on 3 scans. Score range: 30-100"
    flat = score.score(*runs).withColumn("score", F.lit(70))
    assert history.trend_caption(flat).first().caption == "→ Score stable at 70/100 across 3 scans."
    assert sorted(r.scan_id for r in history.latest_scans(runs[0], 2).collect()) == ["r2", "r3"]


def test_suppressions(spark, runs):
    scans, found = runs
    schema = "fingerprint string, reason string, reviewer string, date date"
    eval_print = found.filter("rule_id = 'CRY007'").first().fingerprint
    day = datetime.date(2024, 1, 1)
    known = spark.createDataFrame([(eval_print, "old", "ann", day)], schema)
    added = suppress.add_suppressions(known, spark.createDataFrame([(eval_print, "new", "bob", day), ("f", "x", "", day), ("f", "y", "", day)], schema))
    assert sorted((r.fingerprint, r.reason) for r in added.collect()) == sorted([(eval_print, "old"), ("f", "x")])
    gone = spark.createDataFrame([("f",), ("g",)], "fingerprint string")
    assert [r.fingerprint for r in suppress.remove_suppressions(added, gone).collect()] == [eval_print]
    assert {r.fingerprint: r.removed for r in suppress.removed_any(added, gone).collect()} == {"f": True, "g": False}
    counts = {r.scan_id: r.n_suppressed for r in suppress.suppressed_count(scans, found, known).collect()}
    assert counts == {"r1": 2, "r2": 1, "r3": 0}
    marked = suppress.with_status(found, history.diff_consecutive(scans, found), known).filter("scan_id = 'r2'")
    assert {r.rule_id: r.status for r in marked.collect()} == {"CRY007": "suppressed", "CRY008": "new"}
    # Suppressed findings still count.
    assert policy.gate(scans, found).filter("failed").count() == 2


def test_profiles(spark, runs):
    profiles = state.built_in_profiles(spark)
    hobby = policy.apply_profile(runs[1], profiles, "hobby")
    assert hobby.filter("severity < 3").count() == 0
    everything = policy.apply_profile(runs[1], profiles)
    assert {r.profile for r in everything.select("profile").distinct().collect()} == {"hobby", "saas", "enterprise"}
    own = runs[1].limit(1).withColumn("rule_id", F.lit("TOK001"))
    made = state.profiles_of(spark, [{"name": "open"}, {"name": "part", "enabled_rule_prefixes": ["CRY00", "SEC"]}])
    assert policy.apply_profile(runs[1], made, "open").count() == runs[1].filter("severity >= 1").count()
    part = policy.apply_profile(runs[1].unionByName(own), made, "part")
    assert {r.rule_id for r in part.collect()} == {"CRY003", "CRY007", "CRY008", "TOK001"}
    with pytest.raises(ValueError, match="sass"):
        policy.apply_profile(runs[1], made, "sass")


def test_gates(runs):
    scans, found = runs
    assert {r.scan_id: r.failed for r in policy.gate_new_only(scans, found).collect()} == {"r1": True, "r2": True, "r3": False}
    quiet = found.filter("rule_id <> 'CRY008'")
    assert {r.scan_id: r.failed for r in policy.gate_new_only(scans, quiet).collect()} == {"r1": True, "r2": False, "r3": False}
    assert policy.gate(scans, found, ["LOW"]).filter("failed").count() == 0


def assemble(fragments, scan_id):
    rows = fragments.filter(F.col("scan_id") == scan_id).orderBy("part", "order").collect()
    return json.loads("".join(r.fragment for r in rows))


def test_json_report(runs):
    fragments = report.report_json(*runs)
    document = assemble(fragments, "r1")
    assert list(document) == ["engine_version", "target", "profile", "files_scanned", "score", "findings", "summary"]
    assert document["target"] == 't"x' and document["score"]["value"] == 30 and document["summary"]["total"] == 4
    assert [f["rule_id"] for f in document["findings"]] == ["CRY007", "CRY007", "CRY003", "CFG001"]
    assert document["findings"][0]["severity"] == "CRITICAL" and document["findings"][0]["owasp_llm_id"] is None
    assert assemble(fragments, "r3")["findings"] == []


def test_sarif_report(runs):
    document = assemble(report.report_sarif(*runs), "r1")
    run = document["runs"][0]
    assert document["version"] == "2.1.0" and run["properties"]["score"] == 30
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["CFG001", "CRY003", "CRY007"]
    assert run["tool"]["driver"]["rules"][0]["relationships"][0]["target"]["id"] == "489"
    first = run["results"][0]
    assert first["level"] == "error" and first["locations"][0]["physicalLocation"]["region"]["startLine"] == 1
    assert "owasp-llm" not in first["properties"] and first["properties"]["cwe"] == "CWE-95"
    assert assemble(report.report_sarif(*runs), "r3")["runs"][0]["results"] == []


def test_written_documents_read_back(spark, runs, tmp_path):
    report.write_documents(report.report_json(*runs), str(tmp_path / "docs"))
    parts = sorted((tmp_path / "docs" / "scan_id=r1").glob("part-*"))
    document = json.loads("".join(p.read_text() for p in parts))
    assert len(document["findings"]) == 4


def test_documents_share_a_folder(spark, runs, tmp_path):
    """Many scans in one folder, each document whole; a scan saved again is replaced, a failed save leaves nothing."""
    path = str(tmp_path / "documents")

    def texts(scan=None):
        rows = sorted(documents.read_documents(spark, path, scan).collect(), key=lambda r: (r.file, r.line))
        out = {}
        for r in rows:
            out[r.scan_id] = out.get(r.scan_id, "") + r.fragment
        return {name: json.loads(text) for name, text in out.items()}

    assert texts() == {}
    whole = report.report_json(*runs)
    documents.save_documents(whole.filter("scan_id <> 'r3'"), path)
    first = texts()
    assert "r3" not in first and len(first["r1"]["findings"]) == 4
    assert [f["rule_id"] for f in first["r1"]["findings"]] == [f["rule_id"] for f in assemble(whole, "r1")["findings"]]
    documents.save_documents(whole.filter("scan_id = 'r1' AND part <> 1").unionByName(whole.filter("scan_id = 'r3'")), path)
    second = texts()
    assert second["r1"]["findings"] == [] and set(second) == {*first, "r3"} and second["r2"] == first["r2"]
    assert texts("r2") == {"r2": first["r2"]}
    broken = whole.withColumn("fragment", F.when(F.col("part") == 2, F.lit("two\nlines")).otherwise(F.col("fragment")))
    with pytest.raises(Exception, match="one line"):
        documents.save_documents(broken, path)
    assert texts() == second
    documents.save_documents(whole.filter("scan_id = 'r2'"), path, mode="overwrite")
    assert texts() == {"r2": first["r2"]}


def test_script_safe_json(corpus):
    found = detect(corpus(("a.html", "x.innerHTML = 1 </script>")))
    assert "</script>" not in report.embed_json(found).first().document


def test_rules_fired_takes_the_first(runs):
    rows = {r.rule_id: r for r in score.rules_fired(runs[1].filter("scan_id = 'r1'")).collect()}
    assert rows["CRY007"].line_number == 1


def test_leak_audit(spark, corpus):
    found = detect(corpus(("a.go", "Log(TOKEN, 'hunter2hunter2')"), ("b.py", "if pwd == 'hunter2hunter2':")))
    secrets = spark.createDataFrame([("hunter2hunter2",), ("og(T",), ("",), (None,), ("absent",)], "secret string")
    leaks = audit.leak_audit(found, secrets).collect()
    assert sorted((r.file_path, r.field, r.secret) for r in leaks) == [("a.go", "snippet", "hunter2hunter2"), ("a.go", "snippet", "og(T")]


def test_leak_audit_of_one_long_text(spark, corpus):
    """Windows carry no text, so a megabyte is a million short rows."""
    found = detect(corpus(("a.py", "eval(x) # " + "ab" * 500_000 + " s3cret-value")))
    leaks = audit.leak_audit(found, spark.createDataFrame([("s3cret-value",), ("zz",)], "secret string"))
    assert [r.secret for r in leaks.collect()] == ["s3cret-value"]


def test_only_windows_near_the_hits_become_rows(spark):
    """A bitmap of the keys tests windows where they are cut; a full bitmap spares nothing and loses nothing."""
    keys = spark.createDataFrame([(f"key-{i:012d}",) for i in range(200)] + [("é\u2028\U0001f600",)], "_key string")
    texts = spark.createDataFrame(
        [(0, "plain " * 20_000), (1, "x" * 505 + "key-000000000007" + "y" * 900), (2, "aé\u2028\U0001f600b"), (3, "key-000000000200")],
        "_id long, text string",
    )
    met = {(r["_id"], r["_key"]) for r in audit.windows_met(texts, keys).collect()}
    hits = {(1, "key-000000000007"), (2, "é\u2028\U0001f600")}
    assert hits <= met and len(met) < 300
    full = spark.range(64 * 20).selectExpr("concat('k', lpad(id, 15, '0')) AS _key")
    assert len(audit.key_bitmap(full, 64).first().bits) == 1
    assert audit.key_bitmap(keys.limit(0)).first().bits == [0]


def test_determinism_and_corpus_audit(corpus):
    files = corpus(("a.py", "eval(x)"), ("b.py", "exec(x)"))
    assert audit.determinism_audit(detect(files), detect(files.repartition(3))).count() == 0
    assert audit.determinism_audit(detect(files), detect(files.limit(0))).count() == 2
    after = corpus(("a.py", "eval(y)"), ("c.py", ""))
    assert {(r.path, r.change) for r in audit.corpus_changes(files, after).collect()} == {
        ("a.py", "changed"), ("b.py", "removed"), ("c.py", "added"),
    }


def test_evaluate(spark):
    predicted = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    truth = spark.createDataFrame([(1, True), (2, False), (3, True), (4, False)], "id int, positive boolean")
    row = audit.evaluate(predicted, truth, "id").first()
    assert (row.tp, row.fp, row.fn, row.tn, row.precision, row.recall, row.fpr) == (1, 1, 1, 1, 0.5, 0.5, 0.5)


def test_python_check(corpus):
    rule = RuleSpec("TAB001", "Tab", "LOW", "why", "fix", "")

    def tabs(path, content):
        return [(n, "tab") for n, line in enumerate(content.splitlines(), 1) if "\t" in line]

    rows = detect_with(corpus(("a.py", "x\n\ty")), rule, tabs).collect()
    assert [(r.rule_id, r.line_number, r.severity) for r in rows] == [("TAB001", 2, 1)]


def test_one_scan_with_most_findings(spark):
    """A scan with nearly all rows gives the same whole results."""
    files = spark.range(3000).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("s"), F.col("id") % 7)).otherwise(F.lit("hot")).alias("scan_id"),
        F.concat(F.lit("f"), F.col("id"), F.lit(".py")).alias("path"),
        F.lit("eval(x)").alias("content"),
    )
    found = detect(files)
    scans = tables.files_scanned(files).withColumns(
        {"project": F.lit("p"), "target": F.lit("t"), "profile": F.lit(""), "saved_at": F.to_timestamp(F.lit("2024-01-01"))}
    )
    assert len(assemble(report.report_json(scans, found), "hot")["findings"]) == 2700
    assert history.diff_consecutive(scans, found).filter("status <> 'resolved'").count() == 3000


def test_neighbours_across_ranges_equal_one_window(spark):
    """Ties, one time for most rows, a hot key and a null key included."""
    at = F.when(F.col("id") % 3 == 0, F.col("id") * 7919 % 5000 / 3).otherwise(F.lit(77)).cast("long")
    rows = spark.range(5000).select(
        F.when(F.col("id") % 50 == 0, F.lit("b")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.lit("a")).alias("project"),
        F.timestamp_seconds(at).alias("saved_at"),
        F.concat(F.lit("s"), F.col("id")).alias("scan_id"),
    )
    order, fields = ["saved_at", "scan_id"], ["scan_id"]
    cut = with_neighbours(rows, "project", order, fields)
    window = Window.partitionBy("project").orderBy(*order)
    value = F.struct("scan_id")
    whole = rows.withColumns({"before": F.lag(value).over(window), "after": F.lead(value).over(window)})
    assert sorted(whole.collect(), key=str) == sorted(cut.select(*whole.columns).collect(), key=str)


def test_broadcast_only_after_measuring(spark):
    table = spark.range(100).withColumn("text", F.repeat(F.lit("x"), F.lit(1000)))
    assert is_bounded(table) and not is_bounded(table, max_rows=99) and not is_bounded(table, max_bytes=50_000)


def test_null_projects_stay(spark, runs):
    scans, found = runs
    nameless = scans.withColumn("project", F.lit(None).cast("string"))
    want = sorted(map(str, history.diff_consecutive(scans, found).collect()))
    assert sorted(map(str, history.diff_consecutive(nameless, found).collect())) == want
    scored = score.score(nameless, found)
    assert history.score_trend(scored).count() == scans.count()


def test_saved_suppressions(spark, tmp_path):
    folder = str(tmp_path / "known")
    schema = "fingerprint string, reason string, reviewer string, date date"
    day = datetime.date(2024, 1, 1)

    def entries():
        return {r.fingerprint: r.reason for r in state.load_saved_suppressions(spark, folder).collect()}

    def rows(*pairs):
        return spark.createDataFrame([(f, reason, "ann", day) for f, reason in pairs], schema)

    def prints(*names):
        return spark.createDataFrame([(n,) for n in names], "fingerprint string")

    assert entries() == {} and state.prune_suppressions(spark, folder) == 0
    assert state.change_suppressions(spark, folder, rows(("a", "first"), ("b", "first"))).count() == 0
    removed = state.change_suppressions(spark, folder, rows(("a", "later"), ("c", "first")), prints("b", "x"))
    assert {r.fingerprint: r.removed for r in removed.collect()} == {"b": True, "x": False}
    assert entries() == {"a": "first", "c": "first"}
    # A save that broke off leaves entries without a version.
    rows(("z", "broken")).withColumn("version", F.lit("broken")).write.mode("append").partitionBy("version").parquet(f"{folder}/entries")
    assert entries() == {"a": "first", "c": "first"}
    state.change_suppressions(spark, folder, remove=prints("a", "c"))
    assert entries() == {}
    state.save_suppressions(rows(("d", "new")), folder)
    # Of five folders (the empty version has none) and one broken, the two newest versions stay.
    assert state.prune_suppressions(spark, folder, keep=2) == 3
    assert entries() == {"d": "new"}


def test_change_of_suppressions_by_two(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "known")
    row = spark.createDataFrame([("a", "r", "ann", datetime.date(2024, 1, 1))], "fingerprint string, reason string, reviewer string, date date")
    state.save_suppressions(row, folder)
    real = state.materialize

    def meanwhile(df, label):
        if label == "entries":
            state.save_suppressions(row, folder)
        return real(df, label)

    monkeypatch.setattr(state, "materialize", meanwhile)
    with pytest.raises(RuntimeError, match="meanwhile"):
        state.change_suppressions(spark, folder, remove=row.select("fingerprint"))
    assert state.load_saved_suppressions(spark, folder).count() == 1
