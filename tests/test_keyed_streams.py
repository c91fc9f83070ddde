"""Streams with a state per key: scores that change, findings that come again, states that go."""

import datetime

import pytest

from riskloom.streaming import keyed
from riskloom.streaming import scan as live

SCHEMA = "scan_id string, rule_id string, severity int, fingerprint string, arrived_at timestamp"


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


@pytest.fixture
def arrive(spark, tmp_path):
    """Let rows arrive, run the stream as a new query on its checkpoint, and return all it has written."""
    count = iter(range(100))

    def run(make, *rows):
        if rows:
            spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "in" / f"{next(count):03d}"))
        stream = make(live.read_stream(spark, str(tmp_path / "in" / "*"), SCHEMA))
        live.run_available(live.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
        return spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))

    return run


def states(spark, tmp_path, name):
    """Keys that a state holds."""
    return {r[0][0] for r in spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "cp")).select("key").collect()}


def test_scores_change_once_per_batch_and_idle_scans_go(spark, tmp_path, arrive):
    def make(found):
        return keyed.score_changes(found, idle="10 days")

    arrive(make, *[("a", "R", 4, "x", day(0))] * 3, ("b", "R", 2, "x", day(0)))
    # beyond the cap of a severity the score stays, and there is no row
    out = arrive(make, *[("a", "R", 4, "x", day(1))] * 30)
    assert {(r.scan_id, r.n_findings, r.score) for r in out.collect()} == {("a", 3, 25), ("b", 1, 95)}
    arrive(make)  # a restart without new rows
    out = arrive(make, ("a", "R", 4, "x", day(0)), ("b", "R", 1, "x", day(30)))
    assert {(r.scan_id, r.n_findings, r.score) for r in out.collect()} == {("a", 3, 25), ("b", 1, 95), ("b", 2, 93)}
    out = arrive(make, ("a", "R", 1, "x", day(31)))
    now = {r.scan_id: (r.n_findings, r.score) for r in keyed.newest_scores(out).collect()}
    assert now == {"a": (1, 98), "b": (2, 93)}
    arrive(make, *[(f"s{i}", "R", 1, "x", day(100 + 20 * i)) for i in range(6)])
    arrive(make, ("end", "R", 1, "x", day(300)))
    assert states(spark, tmp_path, "last") <= {"s5", "end"}


def test_findings_that_come_again_over_three_horizons(spark, tmp_path, arrive):
    def make(found):
        return keyed.sightings(found, horizon="30 days", memory="100 days")

    arrive(make, ("a", "R1", 4, "f1", day(0)), ("a", "R1", 4, "f1", day(3)), ("a", "R2", 4, "f2", day(0)), ("b", "R1", 4, "f1", day(40)))
    arrive(make, ("a", "R1", 4, "f1", day(60)), ("a", "R2", 4, "f2", day(50)))
    arrive(make, ("a", "R1", 4, "f1", day(95)), ("a", "R3", 4, "f3", day(300)))
    arrive(make, ("a", "R1", 4, "f1", day(301)))
    out = arrive(make, ("a", "R1", 4, "f1", day(302)), ("a", "R1", 4, "f3", day(303)))
    rows = sorted((r.fingerprint, r.seen_at, r.kind, r.last_seen_at) for r in out.collect())
    assert rows == [
        ("f1", day(0), "first", None), ("f1", day(40), "again", day(3)), ("f1", day(95), "again", day(60)), ("f1", day(301), "first", None),
        ("f2", day(0), "first", None), ("f2", day(50), "again", day(0)), ("f3", day(300), "first", None),
    ]
    assert states(spark, tmp_path, "seen") == {"f1", "f3"}
