"""Join helpers for uneven keys and small sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_bounded(stored: DataFrame, max_rows: int = 100_000, max_bytes: int = 32 << 20) -> bool:
    """Whether a stored table is small enough to broadcast."""
    size = stored.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0)).alias("b")).first()
    return size["n"] <= max_rows and size["b"] <= max_bytes


def frequent(stored: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Keys that hold more than ``1 / share`` of a stored table, with the parts to cut each into.

    There are fewer than ``share`` such keys and fewer than ``2 * share`` parts at any size, so
    the result may be broadcast and rows of the other side may be repeated for each part.
    """
    part = max(1.0, stored.count() / share)
    counts = stored.groupBy(F.col(key).alias("_key")).count().filter((F.col("count") > part) & F.col("_key").isNotNull())
    return counts.select("_key", F.ceil(F.col("count") / part).cast("int").alias("_parts"))


def join_uneven(stored: DataFrame, side: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join a stored table with ``side``, few rows per key, when a key may hold most of the table.

    Rows of a frequent key spread over its parts by their other columns. ``how`` may be inner,
    left or left_semi; the columns of both stay.
    """
    hot = frequent(stored, key)
    rest = [c for c in stored.columns if c != key] or [key]
    placed = F.coalesce(F.pmod(F.xxhash64(*rest), F.col("_parts")), F.lit(0)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    left = stored.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left").withColumn("_part", placed).drop("_key", "_parts")
    right = side.join(F.broadcast(hot), F.col(key) == F.col("_key"), "left").withColumn("_part", each).drop("_key", "_parts")
    return left.join(right, [key, "_part"], how).drop("_part")


def join_per_scan(facts: DataFrame, per_scan: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows of scans, a stored table, with one row per scan when one scan may hold most rows."""
    return join_uneven(facts, per_scan, "scan_id", how)
