"""Helpers that several operators share: stored tables, joins on uneven keys, numbering, components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize, release

# White space of the word contracts: x20 and x09 to x0D.
SPACE = r"\x20\x09-\x0D"


BATCH_BYTES = "4m"


def small_batches(spark: SparkSession) -> None:
    """Have rows reach Python in batches of few megabytes, however long their texts.

    Spark counts rows, ten thousand of them, and 64 MB as it is set at first; a session that sets other bytes keeps them.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, BATCH_BYTES)


Batches = Iterator[pa.RecordBatch]


def lean(compute: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The same function of a task's batches, with memory that they left unused given back to the system.

    Worker processes outlive their tasks, and the pool of Arrow and the C library keep what they once took.
    """

    def release() -> None:
        pa.default_memory_pool().release_unused()
        pa.system_memory_pool().release_unused()

    def each(batches: Batches) -> Batches:
        for batch in batches:
            yield batch
            del batch
            release()

    def run(batches: Batches) -> Batches:
        yield from compute(each(batches))
        release()

    return run


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` as long and ``text`` as string, in small batches for tasks; other columns only if named."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


Hot = dict[int, list]  # frequent keys by the number of parts to cut each into


def cut_into(counts: DataFrame, part: float) -> Hot:
    """Keys with more than ``part`` rows, from ``_key, count``, with a power of two of parts for each."""
    found: Hot = {}
    for key, n in counts.filter((F.col("count") > part) & F.col("_key").isNotNull()).select("_key", "count").collect():
        found.setdefault(1 << math.ceil(math.log2(n / part)), []).append(bytes(key) if isinstance(key, bytearray) else key)
    return found


def frequent(large: DataFrame, on: str, share: int = 1000, total: int | None = None) -> Hot:
    """Keys that hold more than ``1 / share`` of a stored table, with the parts to cut each into.

    There are fewer than ``share`` of them and fewer than ``3 * share`` parts, whatever the size of the
    table, so they are looked up in the plan, without a join, and rows may be repeated for each part.
    """
    part = max(1.0, (large.count() if total is None else total) / share)
    return cut_into(large.groupBy(F.col(on).alias("_key")).count(), part)


def _parts(hot: Hot, on: str) -> Column:
    out = F.lit(1)
    for parts, keys in hot.items():
        out = F.when(F.col(on).isin(keys), parts).otherwise(out)
    return out


def dealt(large: DataFrame, hot: Hot, on: str, part: str) -> DataFrame:
    """Add the part of each row: rows of a frequent key spread by their other columns."""
    rest = [c for c in large.columns if c != on] or [on]
    return large.withColumn(part, F.pmod(F.xxhash64(*rest), _parts(hot, on)).cast("int"))


def repeated(small: DataFrame, hot: Hot, on: str, part: str) -> DataFrame:
    """Repeat the rows of a frequent key for each of its parts."""
    return small.withColumn(part, F.explode(F.sequence(F.lit(0), _parts(hot, on) - 1)))


def join_uneven(large: DataFrame, small: DataFrame, on: str, total: int | None = None, how: str = "inner") -> DataFrame:
    """Join of a stored ``large`` with ``small`` (few rows per key) when a key may hold most of ``large``.

    Rows with a null key join with nothing.
    """
    hot = frequent(large, on, total=total)
    return dealt(large, hot, on, "_part").join(repeated(small, hot, on, "_part"), [on, "_part"], how).drop("_part")


def number_rows(df: DataFrame, group: list[str], name: str, rows_per_task: int = 20_000) -> DataFrame:
    """A gapless number from 0 within each group, without a group passing through one task.

    Rows get a stored row number first, are dealt by its hash, numbered within each part and
    shifted by the sizes of the parts before. Equal rows and nulls in ``group`` are fine.
    """
    stored = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    parts = 64 + stored.count() // rows_per_task  # more than a few keys, so that they spread evenly
    stored = stored.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(parts)).cast("int"))
    # Null groups as values of their own, so that joins keep them.
    keys = [f"_key{i}" for i in range(len(group))]
    stored = stored.withColumns({k: F.struct(F.col(g)) for k, g in zip(keys, group)})
    sizes = stored.groupBy(*keys, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys, F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inner = Window.partitionBy(*keys, "_part").orderBy("_row")
    numbered = stored.withColumn(name, F.row_number().over(inner).cast("long") - 1)
    numbered = numbered.join(shifts, [*keys, "_part"]).withColumn(name, F.col(name) + F.col("_shift"))
    return numbered.select(*df.columns, name)


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Connected components of links ``(a, b)``: ``(node, root)`` with the smallest node as root.

    Alternating large-star and small-star steps; each keeps at most one row per link, is
    written to the shared folder and joins on hubs through :func:`join_uneven`.
    """
    links = _ordered(edges.select("a", "b"))
    stored, state = materialize(links, "links"), None
    for _ in range(max_rounds):
        sign = stored.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == state:
            break
        state = sign
        # large star: the larger neighbours of a node link to the smallest of its neighbourhood
        both = stored.union(stored.select(F.col("b"), F.col("a")))
        least = both.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("low"))
        least = least.select("b", F.least("b", "low").alias("low"))
        large = materialize(_ordered(join_uneven(stored, least, "b", sign[0]).select(F.col("a"), F.col("low").alias("b"))), "links")
        # small star: a node and its smaller neighbours link to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = join_uneven(large, low, "a", sign[0]).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct(F.col("a"), F.col("low").alias("b")))).alias("e"))
        fresh = materialize(_ordered(small.select("e.a", "e.b")), "links")
        release(stored, large)
        stored = fresh
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = stored.groupBy("a").agg(F.min("b").alias("root"))
    return roots.select(F.col("a").alias("node"), "root").union(stored.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct links with the larger node first, without loops."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
