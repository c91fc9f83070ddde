"""The row before and after each row of a sequence of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize


def with_neighbours(rows: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Add ``before`` and ``after``, structs of ``fields`` of the next rows in ``order`` per ``key``.

    A key may hold most rows, so the rows are cut into ranges of ``(key, *order)`` and stored once.
    Windows run inside the ranges, and the edges of the ranges, two rows each, are joined back at
    the seams. A null key is a sequence like any other.
    """
    cut = rows.repartitionByRange(key, *order).withColumns({"_key": F.struct(key), "_range": F.spark_partition_id()})
    cut = materialize(cut, "ranges")
    value, at = F.struct(*fields), F.struct(*order)
    seams = Window.partitionBy("_key").orderBy("_range")
    edges = cut.groupBy("_key", "_range").agg(F.min_by(value, at).alias("_first"), F.max_by(value, at).alias("_last"))
    edges = edges.select("_key", "_range", F.lag("_last").over(seams).alias("_left"), F.lead("_first").over(seams).alias("_right"))
    inner = Window.partitionBy("_key", "_range").orderBy(*order)
    near = cut.withColumns({"before": F.lag(value).over(inner), "after": F.lead(value).over(inner)})
    return near.join(edges, ["_key", "_range"]).select(
        *rows.columns, F.coalesce("before", "_left").alias("before"), F.coalesce("after", "_right").alias("after")
    )
