"""Running scores and sightings with a state per project and per fingerprint.

Rows are merged inside each task before they are shuffled, so a project or fingerprint that holds most
rows of a batch brings a row per task to its key. States live in RocksDB, outside the heap, and go by event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.score import CAPS, WEIGHTS
from ..rules import SEVERITIES
from ..rules.spec import SEVERITY_RANK

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COUNTS = [f"n_{name.lower()}" for name in SEVERITIES]
SCORE_CHANGES = "scan_id string, changed_at timestamp, n_findings long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", score int"
SIGHTINGS = "fingerprint string, rule_id string, kind string, seen_at timestamp, last_seen_at timestamp"


def _use_rocksdb(spark: SparkSession) -> None:
    """Maps and timers need a state store with column families; sessions start with another."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def _millis(span: str) -> int:
    return int(pd.Timedelta(span).total_seconds() * 1000)


def _to_millis(at: pd.Timestamp) -> int:
    return int(at.value // 1_000_000)


class _Scores(StatefulProcessor):
    """Counts per severity of one scan; forgets a scan that had no finding for ``idle`` milliseconds."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "severity int", "n long")
        self.last = handle.getValueState("last", "score int, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        merged = pd.concat(list(rows))  # a row per task and severity
        for severity, n in merged.groupby("severity")["n"].sum().items():
            before = self.counts.getValue((int(severity),))[0] if self.counts.containsKey((int(severity),)) else 0
            self.counts.updateValue((int(severity),), (int(before + n),))
        held = {k[0]: v[0] for k, v in self.counts.iterator()}
        counts = [held.get(SEVERITY_RANK[name], 0) for name in SEVERITIES]
        score = max(0, 100 - sum(min(n * WEIGHTS[name], CAPS[name]) for n, name in zip(counts, SEVERITIES)))
        at = merged["at"].max()
        known = self.last.get() if self.last.exists() else None
        until = max(_to_millis(at) + self.idle, known[1] if known else 0)
        if known is None or until > known[1]:
            if known is not None:
                self.handle.deleteTimer(known[1])
            self.handle.registerTimer(until)
        self.last.update((score, until))
        if known is None or known[0] != score:
            # the newest time so far, so that the changes of a scan are in order however late rows come
            changed = pd.Timestamp(until - self.idle, unit="ms")
            yield pd.DataFrame([(key[0], changed, sum(held.values()), *counts, score)], columns=["scan_id", "changed_at", "n_findings", *_COUNTS, "score"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def score_changes(findings: DataFrame, *, time: str = "arrived_at", late: str = "1 day", idle: str = "90 days") -> DataFrame:
    """A row whenever the score of a scan changes, with its counts so far: :data:`SCORE_CHANGES`.

    Findings count however late they come. A scan without findings for ``idle`` of event time, seen from the
    watermark, loses its state; later ones start it anew at 100.
    """
    _use_rocksdb(findings.sparkSession)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = []
        for batch in batches:
            parts.append(batch.groupby(["scan_id", "severity"], as_index=False).agg(n=("n", "sum"), at=("at", "max")))
            if len(parts) > 64:
                parts = [pd.concat(parts).groupby(["scan_id", "severity"], as_index=False).agg(n=("n", "sum"), at=("at", "max"))]
        if parts:
            yield pd.concat(parts).groupby(["scan_id", "severity"], as_index=False).agg(n=("n", "sum"), at=("at", "max"))

    rows = findings.select("scan_id", "severity", F.lit(1).cast("long").alias("n"), F.col(time).alias("at"))
    merged = rows.mapInPandas(merge, "scan_id string, severity int, n long, at timestamp").withWatermark("at", late)
    return merged.groupBy("scan_id").transformWithStateInPandas(_Scores(_millis(idle)), SCORE_CHANGES, "Append", "EventTime")


def newest_scores(changes: DataFrame) -> DataFrame:
    """The score of each scan now, from the rows of :func:`score_changes`.

    Counts are those of the last change, so findings beyond the cap of a severity may have come since.
    """
    newest = changes.groupBy("scan_id").agg(F.max_by(F.struct(*[c for c in changes.columns if c != "scan_id"]), F.struct("changed_at", "n_findings")).alias("now"))
    return newest.select("scan_id", "now.*")


class _Sightings(StatefulProcessor):
    """When one fingerprint was seen last, kept for ``memory`` milliseconds."""

    def __init__(self, horizon: int, memory: int):
        self.horizon, self.memory = horizon, memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spans = pd.concat(list(rows)).sort_values("first")
        known = self.seen.get() if self.seen.exists() else None
        last, out = (known[0] if known else None), []
        for rule_id, first, end in zip(spans["rule_id"], spans["first"], spans["last"]):
            if last is None:
                out.append((key[0], rule_id, "first", first, None))
            elif _to_millis(first) - last > self.horizon:
                out.append((key[0], rule_id, "again", first, pd.Timestamp(last, unit="ms")))
            last = max(last or 0, _to_millis(end))
        until = last + self.memory
        if known is None or known[1] != until:
            if known is not None:
                self.handle.deleteTimer(known[1])
            self.handle.registerTimer(until)
        self.seen.update((last, until))
        if out:
            yield pd.DataFrame(out, columns=["fingerprint", "rule_id", "kind", "seen_at", "last_seen_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def sightings(
    findings: DataFrame, *, time: str = "arrived_at", late: str = "1 day", horizon: str = "30 days", memory: str = "365 days"
) -> DataFrame:
    """First sightings of fingerprints, and those that come again after more than ``horizon``: :data:`SIGHTINGS`.

    A fingerprint not seen for ``memory``, from the watermark, is forgotten, and its next sighting is a first one;
    so the state is bounded by what was seen within that time.
    """
    _use_rocksdb(findings.sparkSession)
    gap = pd.Timedelta(horizon)

    def spans(rows: pd.DataFrame) -> pd.DataFrame:
        """Sightings no further apart than the horizon as one row."""
        rows = rows.sort_values(["fingerprint", "first"], ignore_index=True)
        reach = rows.groupby("fingerprint")["last"].cummax().groupby(rows["fingerprint"]).shift()
        opens = reach.isna() | (rows["first"] - reach > gap)
        return rows.groupby(["fingerprint", opens.cumsum().rename("span")], as_index=False).agg(
            rule_id=("rule_id", "min"), first=("first", "min"), last=("last", "max")
        )[["fingerprint", "rule_id", "first", "last"]]

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = spans(batch if held is None else pd.concat([held, batch]))
            if len(held) > 100_000:
                yield held
                held = None
        if held is not None and len(held):
            yield held

    rows = findings.select("fingerprint", "rule_id", F.col(time).alias("first"), F.col(time).alias("last"))
    merged = rows.mapInPandas(merge, "fingerprint string, rule_id string, first timestamp, last timestamp").withWatermark("last", late)
    return merged.groupBy("fingerprint").transformWithStateInPandas(_Sightings(_millis(horizon), _millis(memory)), SIGHTINGS, "Append", "EventTime")
