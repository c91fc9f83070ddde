"""Streams: equality with the batch scan, repeats, late rows, running scores."""

import datetime

import pytest
from pyspark.sql import functions as F

from riskloom.operators.detect import detect
from riskloom.streaming import scan as live

SCHEMA = "scan_id string, path string, content string, arrived_at timestamp"


def at(hour, minute=0, day=1):
    return datetime.datetime(2024, 1, day, hour, minute)


@pytest.fixture
def drop(spark, tmp_path):
    """Add a file of rows to the watched folder; later files arrive later."""
    count = iter(range(100))

    def add(*rows):
        target = tmp_path / "in" / f"{next(count):03d}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(target))

    return add


def run(spark, tmp_path, make, write=live.append_to):
    stream = make(live.scan_stream(live.read_stream(spark, str(tmp_path / "in" / "*"), SCHEMA)))
    live.run_available(write(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))


def test_stream_equals_batch(spark, tmp_path, drop):
    rows = [("s", "a.py", "eval(x)\nc.messages.create(", at(1)), ("s", "Dockerfile", "FROM x", at(2))]
    drop(*rows)
    got = run(spark, tmp_path, lambda found: found).drop("arrived_at")
    want = detect(spark.createDataFrame(rows, SCHEMA))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 3


def test_only_arriving_files_are_scanned(spark, tmp_path, drop):
    drop(("s", "a.py", "eval(x)", at(1)))
    assert run(spark, tmp_path, lambda found: found).count() == 1
    drop(("s", "b.py", "exec(x)", at(2)))
    assert run(spark, tmp_path, lambda found: found).count() == 2


def test_first_sightings(spark, tmp_path, drop):
    drop(("s", "a.py", "eval(x)\neval(x)", at(1)), ("t", "a.py", "eval(x)", at(2)))
    assert run(spark, tmp_path, live.new_findings).count() == 1
    drop(("s", "a.py", "eval(x)\nexec(x)", at(3)))
    assert sorted(r.rule_id for r in run(spark, tmp_path, live.new_findings).collect()) == ["CRY007", "CRY008"]


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path, drop):
    def windows(found):
        return live.severity_windows(found, late="1 hour", width="1 hour")

    drop(("s", "a.py", "eval(x)", at(1, 10)), ("s", "b.py", "eval(x)", at(1, 50)))
    run(spark, tmp_path, windows)
    drop(("s", "c.py", "eval(x)", at(1, 20)), ("s", "d.py", "eval(x)", at(9)))
    run(spark, tmp_path, windows)
    drop(("s", "late.py", "eval(x)", at(1, 30)), ("s", "e.py", "eval(x)", at(20)))
    rows = {r.window_start.hour: r.n_findings for r in run(spark, tmp_path, windows).collect()}
    assert rows == {1: 3, 9: 1}


def test_running_scores(spark, tmp_path, drop):
    def step():
        return {r.scan_id: r.score for r in live.latest_scores(run(spark, tmp_path, live.running_counts, live.upsert_counts)).collect()}

    drop(("s", "a.py", "eval(x)", at(1)))
    assert step() == {"s": 75}
    drop(("s", "b.py", "eval(x)", at(2)), ("t", "b.py", "DEBUG = True", at(2)))
    assert step() == {"s": 50, "t": 90}


def test_running_scores_stay_in_few_folders(spark, tmp_path, drop):
    """Many micro-batches, compacted on the way, and a batch that runs again."""

    def write(stream, path, checkpoint):
        return live.upsert_counts(stream, path, checkpoint, compact_every=2)

    for n in range(7):
        drop((f"s{n % 2}", f"{n}.py", "x = 1 # TODO\neval(x)" if n < 4 else "DEBUG = True", at(1, n)))
        counts = run(spark, tmp_path, live.running_counts, write)
    assert len(list((tmp_path / "out").glob("batch=*"))) <= 5
    want = {r.scan_id: r.n for r in detect(spark.read.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))).groupBy("scan_id").agg(F.count("*").alias("n")).collect()}
    latest = live.latest_scores(counts).collect()
    assert {r.scan_id: r.n_critical + r.n_high + r.n_medium + r.n_low + r.n_info for r in latest} == want
