"""Directories, tables, filters and stored state."""

import datetime

import pytest
from pyspark.sql import functions as F

from riskloom.operators.detect import detect
from riskloom.sources import state, tables
from riskloom.sources import tree as tree_module
from riskloom.sources.tree import _children, left_out, list_tree, read_corpus, read_tree


def make_tree(root):
    files = {
        "app.py": b"eval(x)\n", ".gitignore": b".env\n", ".env": b"A=1\n", "_priv.py": b"x", "pkg/__init__.py": b"",
        ".github/ci.yml": b"on: push", ".hidden/x.py": b"eval(x)", "node_modules/m/x.js": b"eval(x)", "lib.egg-info/x.py": b"x",
        "img.PNG": b"eval(x)", "latin.py": "é".encode("latin-1"), "big.py": b"a" * 1_048_577, "edge.py": b"a" * 1_048_576,
        "deep/a/b/c/d.py": b"eval(x)", "skipped/x.py": b"x", "skip.me": b"x",
        ".riskloomignore": b"# note\n\nskipped/\nskip.me\n",
    }
    for name, content in files.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)


def test_read_corpus(spark, tmp_path):
    make_tree(tmp_path)
    files = read_corpus(spark, str(tmp_path))
    paths = {r.path for r in files.select("path").collect()}
    assert paths == {
        "app.py", ".gitignore", ".env", "_priv.py", "pkg/__init__.py", ".github/ci.yml", "edge.py", "deep/a/b/c/d.py",
        ".riskloomignore",
    }
    found = {(r.file_path, r.rule_id) for r in detect(files).collect()}
    assert ("deep/a/b/c/d.py", "CRY007") in found and (".env", "GIT006") in found and (".gitignore", "GIT003") in found


def test_exclude_list_replaces_the_defaults(spark, tmp_path):
    make_tree(tmp_path)
    paths = {r.path for r in read_corpus(spark, str(tmp_path), exclude=["deep"]).select("path").collect()}
    assert "node_modules/m/x.js" in paths and "deep/a/b/c/d.py" not in paths and "skipped/x.py" not in paths


def test_listing_is_the_same_however_it_is_shared_out(spark, tmp_path):
    make_tree(tmp_path)
    listed = sorted(r.path for r in list_tree(spark, str(tmp_path), exclude=None).collect())
    assert listed == sorted(str(f.relative_to(tmp_path)) for f in tmp_path.rglob("*") if f.is_file())


def test_problems_are_rows_and_unreadable_files_fail(spark, tmp_path):
    make_tree(tmp_path)
    tree = read_tree(spark, str(tmp_path))
    assert {(r.problem, r.n_files) for r in left_out(tree).collect()} == {("too large", 1), ("not UTF-8", 1)}
    assert {r.path for r in tree.filter("problem is not null").collect()} == {"big.py", "latin.py"}
    (tmp_path / "loop").symlink_to(tmp_path / "loop")
    (tmp_path / "self.py").symlink_to(tmp_path / "self.py")
    (tmp_path / "deep" / "gone").mkdir()
    listed = list_tree(spark, str(tmp_path))
    (tmp_path / "deep" / "gone").rmdir()
    assert listed.count() > 10
    broken = "path string, size long, problem string"
    row = spark.createDataFrame([("x.py", 0, "unreadable: gone")], broken)
    assert left_out(row.select(F.lit("s").alias("scan_id"), "*")).first().n_files == 1


def test_an_unreadable_folder_fails_the_scan_or_is_a_row(spark, tmp_path, monkeypatch):
    assert [p for *_, p in _children(str(tmp_path), "none", None)] == ["unreadable: No such file or directory"]
    (tmp_path / "a.py").write_text("x")
    rows = spark.createDataFrame([("a.py", 1, None), ("b.py", 1, None)], "path string, size long, problem string")
    monkeypatch.setattr(tree_module, "list_tree", lambda *_, **__: rows)
    assert {(r.path, r.problem) for r in read_tree(spark, str(tmp_path)).collect()} == {("a.py", None), ("b.py", "unreadable: No such file or directory")}
    assert read_corpus(spark, str(tmp_path), on_error="skip").count() == 1
    with pytest.raises(Exception, match="cannot read b.py"):
        read_corpus(spark, str(tmp_path)).collect()


def test_a_flat_folder_of_many_names(spark, tmp_path):
    for n in range(100_000):
        (tmp_path / f"f{n}").touch()
    assert list_tree(spark, str(tmp_path)).count() == 100_000


def test_single_file_and_missing_path(spark, tmp_path):
    make_tree(tmp_path)
    assert [r.path for r in read_corpus(spark, str(tmp_path / "img.PNG")).collect()] == ["img.PNG"]
    assert read_corpus(spark, str(tmp_path / "none")).count() == 0


def test_invalid_text_is_dropped(spark):
    raw = spark.createDataFrame([(b"ok \xc3\xa9",), (b"\xe9",), (b"\xef\xbb\xbfbom",)], "content binary")
    assert [r.content for r in tables.filter_utf8(raw).collect()] == ["ok é", "﻿bom"]


def test_history_round_trip(spark, tmp_path, corpus):
    files = corpus(("007", "a.py", "eval(x)"), ("008", "a.py", "exec(x)\neval(x)"), ("009", "a.py", "x"))
    scans = tables.files_scanned(files).withColumns(
        {"project": F.lit("p"), "saved_at": F.to_timestamp(F.concat(F.lit("2024-01-"), F.substring("scan_id", 2, 2)))}
    )
    state.save_scans(scans, detect(files), str(tmp_path / "h"))
    all_scans, all_findings = state.load_history(spark, str(tmp_path / "h"))
    assert sorted(r.scan_id for r in all_scans.collect()) == ["007", "008", "009"]
    assert sorted(r.scan_id for r in all_findings.collect()) == ["007", "008", "008"]
    newest, findings = state.load_history(spark, str(tmp_path / "h"), newest=2)
    assert sorted(r.scan_id for r in newest.collect()) == ["008", "009"]
    assert {r.scan_id for r in findings.collect()} == {"008"}
    # A save that broke off shows nothing, and a scan saved again replaces the old one.
    detect(files).select("*", F.lit("broken").alias("save_id"), F.lit(0).alias("bucket")).write.mode("append").partitionBy("bucket").parquet(str(tmp_path / "h" / "findings"))
    state.save_scans(scans.filter("scan_id = '008'"), detect(files).filter("rule_id = 'CRY008'"), str(tmp_path / "h"))
    again, found = state.load_history(spark, str(tmp_path / "h"))
    assert again.count() == 3
    assert sorted((r.scan_id, r.rule_id) for r in found.collect()) == [("007", "CRY007"), ("008", "CRY008")]


def test_scan_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"score": 70, "findings": [{"fingerprint": "x"}], "_meta": {"saved_at": "2024-01-02_030405_000006", "fingerprints": ["f", "g", "f"]}}')
    (tmp_path / "b.json").write_text('{"score": {"value": 40}, "findings": [{"fingerprint": "x"}, {"rule_id": "r"}, {"fingerprint": ""}], "_meta": {"fingerprints": []}}')
    (tmp_path / "c.json").write_text('{"score": ')
    scans, held = state.load_scan_documents(spark, str(tmp_path))
    assert {r.scan_id: r.score for r in scans.collect()} == {"a": 70, "b": 40, "c": None}
    assert scans.filter("scan_id = 'a'").first().saved_at == datetime.datetime(2024, 1, 2, 3, 4, 5, 6)
    assert sorted((r.scan_id, r.fingerprint) for r in held.collect()) == [("a", "f"), ("a", "g"), ("b", "x")]


def test_suppression_documents(spark, tmp_path):
    (tmp_path / "good.json").write_text(
        '[{"fingerprint": "f1", "reason": "r", "reviewer": "ann", "date": "2024-02-03"}, {"reason": "no print"}]'
    )
    (tmp_path / "bad.json").write_text('[{"fingerprint": ')
    rows = state.load_suppressions(spark, str(tmp_path)).collect()
    assert [(r.fingerprint, r.date) for r in rows] == [("f1", datetime.date(2024, 2, 3))]


def test_profiles(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"name": "p", "min_severity": "LOUD", "severity_overrides": {"A": "HIGH", "B": "X"}}')
    row = state.load_profiles(spark, str(tmp_path)).first()
    assert (row.min_severity, row.severity_overrides, row.enabled_rule_prefixes) == (1, {"A": 3}, [])
    built_in = {r.name: r for r in state.built_in_profiles(spark).collect()}
    assert built_in["hobby"].min_severity == 3 and built_in["saas"].severity_overrides["CRY001"] == 4


def test_newest_scans_open_few_files_and_compaction_keeps_what_counts(spark, tmp_path):
    folder = str(tmp_path / "h")
    scans = spark.range(200).select(
        F.lit("p").alias("project"), F.format_string("%04d", "id").alias("scan_id"), F.timestamp_seconds(F.col("id") * 1000).alias("saved_at")
    )
    rows = spark.range(2000).select(F.format_string("%04d", F.col("id") % 200).alias("scan_id"), F.col("id").cast("string").alias("fingerprint"))
    state.save_scans(scans, rows, folder)
    state.save_scans(scans.filter("scan_id >= '0190'"), rows.filter("scan_id >= '0190' AND fingerprint > '5'"), folder)
    _, found = state.load_history(spark, folder, newest=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    # Only the folders of these scans are opened: all others may hold anything.
    held = {r.bucket for r in spark.read.parquet(f"{folder}/findings").filter("scan_id IN ('0197', '0198', '0199')").select("bucket").distinct().collect()}
    kept = {}
    for file in (tmp_path / "h" / "findings").glob("bucket=*/*.parquet"):
        if int(file.parent.name.split("=")[1]) not in held:
            kept[file] = file.read_bytes()
            file.write_bytes(b"no parquet")
            file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert 1 <= len(held) <= 3 and len(kept) > 50
    assert {r.scan_id for r in found.collect()} == {"0197", "0198", "0199"}
    for file, data in kept.items():
        file.write_bytes(data)
        file.with_name(f".{file.name}.crc").unlink(missing_ok=True)

    before = [sorted(map(str, t.collect())) for t in state.load_history(spark, folder)]
    gone = state.compact_history(spark, folder)
    assert gone > 60
    assert [sorted(map(str, t.collect())) for t in state.load_history(spark, folder)] == before
    assert spark.read.parquet(f"{folder}/findings").count() == len(before[1])
    # once more changes nothing, and neither does a copy that a broken compaction left
    saved = spark.read.parquet(f"{folder}/scans")
    state._append(saved.drop("save_id"), spark.read.parquet(f"{folder}/findings").drop("save_id", "bucket"), folder)
    assert [sorted(map(str, t.collect())) for t in state.load_history(spark, folder)] == before
    state.compact_history(spark, folder)
    assert [sorted(map(str, t.collect())) for t in state.load_history(spark, folder)] == before


def test_unreadable_ignore_file_fails_the_scan(spark, tmp_path):
    (tmp_path / "a.py").write_text("eval(x)")
    (tmp_path / tables.IGNORE_FILE).write_bytes(b"\xff\xfe")
    with pytest.raises(ValueError, match="cannot read"):
        read_tree(spark, str(tmp_path)).count()
