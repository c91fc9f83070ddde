"""The same scan on files that arrive over time.

Matching is stateless per file, so the batch operators run unchanged on a stream. State is
kept only for first sightings, windows and running counts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.detect import IGNORE_MARKER, detect
from ..operators.score import score_column
from ..rules import CATALOG, SEVERITIES, RuleSpec
from ..rules.spec import SEVERITY_RANK
from ..storage import delete


def scan_stream(
    files: DataFrame, rules: Iterable[RuleSpec] = CATALOG, *, time: str = "arrived_at", marker: str = IGNORE_MARKER
) -> DataFrame:
    """Findings of a stream of ``(scan_id, path, content, time)``, each with its file's time."""
    return detect(files, rules, marker=marker, keep=[time])


def new_findings(findings: DataFrame, *, time: str = "arrived_at", horizon: str = "30 days") -> DataFrame:
    """The first sighting of each fingerprint. After the horizon its state goes and it is reported again."""
    return findings.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["fingerprint"])


def severity_windows(
    findings: DataFrame,
    *,
    time: str = "arrived_at",
    late: str = "1 day",
    width: str = "1 day",
    slide: str | None = None,
    gap: str | None = None,
) -> DataFrame:
    """Findings per severity and time window: tumbling, sliding with ``slide``, sessions with ``gap``.

    Windows are emitted once the watermark, ``late`` behind the newest time, has passed their end;
    those still open at the end are not. Sessions of the few severities merge inside each task
    before they are shuffled.
    """
    if gap:
        findings.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        span = F.session_window(time, gap)
    else:
        span = F.window(time, width, slide) if slide else F.window(time, width)
    counted = findings.withWatermark(time, late).groupBy(span.alias("span"), "severity").agg(F.count("*").alias("n_findings"))
    return counted.select(
        F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "severity", "n_findings"
    )


def running_counts(findings: DataFrame) -> DataFrame:
    """Counts per scan and severity so far; Spark keeps one row of state for each."""
    return findings.groupBy("scan_id", "severity").agg(F.count("*").alias("n_findings"))


def latest_scores(counts: DataFrame) -> DataFrame:
    """Scores from the counts that :func:`running_counts` has emitted so far.

    ``counts`` is the table of :func:`upsert_counts`; rows of a scan and severity may repeat and
    the largest count is the newest.
    """
    newest = counts.groupBy("scan_id", "severity").agg(F.max("n_findings").alias("n_findings"))
    columns = [
        F.coalesce(F.sum(F.when(F.col("severity") == SEVERITY_RANK[n], F.col("n_findings"))), F.lit(0)).alias(f"n_{n.lower()}")
        for n in SEVERITIES
    ]
    return newest.groupBy("scan_id").agg(*columns).withColumn("score", score_column())


def append_to(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append rows to a parquet table exactly once."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint
    )


def upsert_counts(stream: DataFrame, path: str, checkpoint: str, compact_every: int = 16) -> DataStreamWriter:
    """Keep the counts of :func:`running_counts` as a table of bounded size, one folder per micro-batch.

    Counts only grow, so the largest of a scan and severity is its newest and rows may repeat. Every
    ``compact_every`` batches the folder of the batch takes in the folders since the last such one,
    which go when the next one has been written. A repeated batch overwrites its own folder from
    inputs that are still there, so a retry changes nothing.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if batch_id and batch_id % compact_every == 0:
            since = [f"{path}/batch={k}" for k in range(batch_id - compact_every, batch_id)]
            old = spark.read.schema(batch.schema).parquet(*since)
            rows = old.unionByName(batch).groupBy("scan_id", "severity").agg(F.max("n_findings").alias("n_findings"))
        rows.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if batch_id % compact_every == 0:
            for k in range(max(0, batch_id - 2 * compact_every), batch_id - compact_every):
                delete(spark, f"{path}/batch={k}")

    return stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)


def run_available(writer: DataStreamWriter) -> None:
    """Process all that has arrived, then stop."""
    writer.trigger(availableNow=True).start().awaitTermination()


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet files as they arrive; a path with a wildcard names single files."""
    return spark.readStream.schema(schema).parquet(path)
