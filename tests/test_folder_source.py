"""The folder data source: rows as the tree reader gives them, pushed filters, files that arrive."""

import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThan, StringEndsWith, StringStartsWith

from riskloom.operators.detect import detect
from riskloom.sources import folder
from riskloom.sources.tree import read_tree
from riskloom.streaming import scan as live


@pytest.fixture
def put(tmp_path):
    root = tmp_path / "tree"

    def write(name, text):
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(text if isinstance(text, bytes) else text.encode())

    write("a.py", "eval(x)")
    return write


def fill(put):
    for name in (".env", "src/.hidden/x.py", "src/_c.py", "src/b.js", "x.PNG", ".github/w.yml", "node_modules/m.js", "deep/er/and/deeper.py", "skip/z.py", "e.tar.gz"):
        put(name, "exec(y)\n" * 3)
    put("latin.py", b"\xe9")
    put("big.py", "x" * 2000)
    put(".riskloomignore", "skip/\n")


def test_rows_equal_the_tree_reader(spark, tmp_path, put):
    fill(put)
    root = str(tmp_path / "tree")
    for options, same in (({}, {}), ({"filters": "false"}, {"apply_filters": False}), ({"exclude": "deep"}, {"exclude": ["deep"]})):
        got = folder.folder_files(spark, root, maxBytes=1000, filesPerPartition=2, **options)
        want = read_tree(spark, root, max_bytes=1000, **same)
        if options == {"filters": "false"}:  # the tree reader has no limit then
            want = want.withColumn("problem", F.when(F.col("size") > 1000, "too large").otherwise(F.col("problem")))
            want = want.withColumn("content", F.when(F.col("problem").isNull(), F.col("content")))
        columns = ["path", "size", "content", "problem"]
        assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_filters_reach_the_reader(spark, tmp_path, put):
    fill(put)
    files = folder.folder_files(spark, str(tmp_path / "tree"))
    some = files.filter("path LIKE 'src/%' AND path LIKE '%.py' AND size < 100")
    plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert "StringStartsWith(path,src/)" in plan and "StringEndsWith(path,.py)" in plan and "LessThan(size,100)" in plan
    assert [r.path for r in some.collect()] == ["src/_c.py"]
    files.createOrReplaceTempView("some_files")
    assert spark.sql("SELECT count(*) AS n FROM some_files WHERE path IN ('a.py', 'nope') AND size >= 7").first().n == 1
    assert spark.sql("SELECT count(*) AS n FROM some_files WHERE size > 100 OR path = 'a.py'").first().n == 2
    # filters of one query do not stay for the next
    assert files.count() > 8 and files.filter("path = 'a.py'").count() == 1 and files.count() > 8
    plain = spark.read.format(folder.FORMAT).load(str(tmp_path / "tree"))
    assert plain.filter("path = 'a.py'").count() == 1 and plain.count() == files.count()


def test_pushed_filters_prune_folders(tmp_path, put):
    fill(put)
    files = folder.FolderFiles({"path": str(tmp_path / "tree")})
    rest = list(files.push([StringStartsWith(("path",), "deep/er"), StringEndsWith(("path",), ".py"), GreaterThan(("size",), 3), IsNotNull(("path",))]))
    assert [type(f) for f in rest] == [IsNotNull]
    assert [f for f, *_ in files.folders()] == ["deep/er/and"]
    named = folder.FolderFiles({"path": str(tmp_path / "tree")})
    assert list(named.push([In(("path",), ("a.py", "src/_c.py")), EqualTo(("problem",), "x"), LessThan(("size",), 9)]))
    assert sorted(f for f, *_ in named.folders()) == ["", "src"]


def test_large_folders_are_dealt_out_and_faults_are_rows(spark, tmp_path, put):
    for i in range(50):
        put(f"many/f{i}.py", str(i))
    files = folder.FolderFiles({"path": str(tmp_path / "tree"), "filesPerPartition": "8"})
    parts = [p for p in files.parts() if p.folder == "many"]
    assert len(parts) == 7
    names = [name for p in parts for batch in files.read(p) for name in batch["path"].to_pylist()]
    assert sorted(names) == sorted(f"many/f{i}.py" for i in range(50))
    os.symlink("/nowhere", tmp_path / "tree" / "link.py")
    (gone,) = (b for b in files.read(folder.FolderPart("gone", 0, 1)))
    assert gone["problem"].to_pylist() == ["unreadable: No such file or directory"]
    assert folder.folder_files(spark, str(tmp_path / "empty")).count() in (0, 1)
    with pytest.raises(ValueError):
        folder.FolderFiles({"path": "s3://bucket/x"})


def test_stream_equals_batch_after_three_arrivals_and_restarts(spark, tmp_path, put):
    root = str(tmp_path / "tree")

    def run():
        found = live.scan_stream(folder.folder_stream(spark, root, settleSeconds=0.3, filesPerPartition=2))
        live.run_available(live.append_to(found, str(tmp_path / "out"), str(tmp_path / "cp")))
        return spark.read.schema(found.schema).parquet(str(tmp_path / "out"))

    time.sleep(0.5)
    assert run().count() == 1
    fill(put)
    time.sleep(0.5)
    second = run().count()
    # a file moved in keeps its old time stamps and is new all the same
    (tmp_path / "old.py").write_text("eval(old)")
    os.utime(tmp_path / "old.py", (1, 1))
    os.rename(tmp_path / "old.py", tmp_path / "tree" / "old.py")
    time.sleep(0.5)
    got = run()
    assert got.count() == second + 1
    files = folder.folder_files(spark, root).filter("problem is null").select(F.lit("scan").alias("scan_id"), "path", "content")
    want = detect(files)
    assert sorted(map(str, got.drop("arrived_at").collect())) == sorted(map(str, want.collect()))
    assert run().count() == got.count()


def test_a_file_that_is_being_written_waits(tmp_path, put):
    reader = folder.FolderStreamReader(folder.FolderFiles({"path": str(tmp_path / "tree")}), settle=60)
    until = reader.latestOffset()
    assert [b for p in reader.partitions(reader.initialOffset(), until) for b in reader.read(p)] == []
    settled = folder.FolderStreamReader(folder.FolderFiles({"path": str(tmp_path / "tree")}), settle=0)
    (batch,) = (b for p in settled.partitions(until, settled.latestOffset()) for b in settled.read(p))
    assert batch["path"].to_pylist() == ["a.py"]
