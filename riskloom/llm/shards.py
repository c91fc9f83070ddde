"""Sharding by k-d tree partitioning.

Points are groups of equal texts. A node is cut along the widest of the metadata dimensions at the
weighted median, found from distributed histograms of bounded size that close in on the cut, until
every leaf holds one shard's share of the bytes. Groups too large to be a point, yet with room in a
shard, are given one whole beforehand, and the tree fills what room they leave.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, number_rows, release

ROW_BYTES = 8  # added to the UTF-8 length of each text
POINT_SHARE = 20  # points of the tree weigh 1/20 of a shard at most, besides single rows
BINS = 2048
_LOW, _HIGH = 0, (1 << 62) - 1


def _dimensions(docs: DataFrame, columns: tuple[str, ...]):
    """Each dimension as a long below 2**30: numbers by their logarithm, strings by a hash that keeps equal ones together."""
    out = []
    kinds = dict(docs.dtypes)
    for name in columns:
        c = F.col(f"`{name}`")
        if kinds[name] == "string":
            value = F.when(c.isNull(), F.lit(0).cast("long")).otherwise(F.shiftrightunsigned(F.xxhash64(c), 34))
        else:
            value = F.least(F.greatest(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(float(1 << 30)))
            value = (F.log2(value + 1) * F.lit(float(1 << 25))).cast("long")
        out.append(value)
    return out


def kd_shards(docs: DataFrame, shards: int = 24, dimensions: tuple[str, ...] = ("n_chars", "lang", "source")) -> DataFrame:
    """Shard of every row: ``doc_id, size, text_crc32, shard, slot``; sizes of shards come near equal.

    ``size`` is the text's UTF-8 length plus 8, a null text counting as empty. Equal texts form one
    point with the metadata of their least row and go to one shard together. A group of more than 1/20 of a
    shard takes its place first, the largest first, in the shard with least room that holds it; only one that
    no shard has room for, as one beyond a whole shard, is dealt out in small parts, by id and metadata of its rows, so
    rows equal in these stay together unless their id is null. How rows lie in files changes no shard of a row with
    an id. Dimensions that ``docs`` lacks are left out; nulls in them sort first. Rows may repeat and ids may be null.
    ``slot`` numbers the rows of a shard from 0 without gaps. No rows give no rows.
    """
    used = tuple(c for c in dimensions if c in docs.columns)
    values = _dimensions(docs, used)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        *[v.alias(f"d{i}") for i, v in enumerate(values)],
    )
    # What deals out the rows of a group that must be cut; without an id, the place of the row.
    names = [f"d{i}" for i in range(len(used))]
    nameless = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("deal", F.xxhash64("doc_id", *names, nameless)), "rows")
    total = rows.agg(F.sum("size").alias("bytes")).first()["bytes"]
    if total is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    place = F.struct(*names, "deal")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.min(place).alias("at"), F.max("size").alias("most"))
    groups = materialize(groups.select("group", "bytes", "most", *[F.col(f"at.{d}").alias(d) for d in names]), "groups")
    limit = max(1, total // (shards * POINT_SHARE))
    heavy = groups.filter(F.col("bytes") > limit).select("group", "bytes", "most").collect()  # fewer than shards * 20
    whole, room = _whole_groups([(r["group"], r["bytes"]) for r in heavy], shards, total / shards)
    # Copies of a text have one size, so rows per part are even.
    plan = [(r["group"], max(1, min(-(-r["bytes"] // limit), r["bytes"] // r["most"])), whole.get(r["group"])) for r in heavy]
    large = F.broadcast(docs.sparkSession.createDataFrame(plan, "group long, parts int, whole int"))
    rows = rows.join(large, "group", "left")
    given = rows.filter("whole is not null").withColumnRenamed("whole", "shard")
    rows = rows.filter("whole is null").withColumn("part", F.coalesce(F.pmod("deal", "parts"), F.lit(0)).cast("int"))
    weights = rows.groupBy("group", "part").agg(F.sum("size").alias("bytes"))
    points = weights.join(groups.select("group", *names), "group")
    tie = F.shiftrightunsigned(F.xxhash64("group", "part"), 32)
    points = materialize(points.withColumn("tie", tie).withColumn("node", F.lit(0)), "points")

    # node -> (shards below it, first shard, bytes); every level cuts all nodes at once.
    nodes = {0: (shards, 0, total - sum(size for group, size, _ in heavy if group in whole))}
    while any(n > 1 for n, _, _ in nodes.values()):
        keys = _order_keys(points, names, nodes)
        made = _cut(points.join(F.broadcast(keys), "node"), nodes, room)
        old = points
        points = materialize(_descend(points.join(F.broadcast(keys), "node"), made).select(*old.columns), "points")
        release(old)
        fresh = {}
        for node, (n, first, total) in nodes.items():
            if node in made:
                low, _, below = made[node]
                fresh[2 * node + 1] = (low, first, below)
                fresh[2 * node + 2] = (n - low, first + low, total - below)
            else:
                fresh[node] = (n, first, total)
        nodes = fresh
    # rows to shards: the points outnumber no shuffle partition by much more than rows do
    spark = docs.sparkSession
    leaf = spark.createDataFrame([(node, first) for node, (_, first, _) in nodes.items()], "node int, shard int")
    placed = points.join(F.broadcast(leaf), "node").select("group", "part", "shard")
    out = [part.select("doc_id", "size", "text_crc32", "shard") for part in (_join_points(rows, placed), given)]
    return number_rows(out[0].union(out[1]), ["shard"], "slot")


def _whole_groups(heavy: list[tuple[int, int]], shards: int, target: float) -> tuple[dict[int, int], list[float]]:
    """``(shard of each group that keeps whole, bytes that are free in each shard)``, for few ``(group, bytes)``."""
    room, whole = [target] * shards, {}
    for group, size in sorted(heavy, key=lambda g: (-g[1], g[0])):
        fitting = [shard for shard in range(shards) if room[shard] >= size]
        if fitting:
            whole[group] = min(fitting, key=lambda shard: (room[shard], shard))
            room[whole[group]] -= size
    return whole, room


def _order_keys(points: DataFrame, names: list[str], nodes: dict) -> DataFrame:
    """Per open node the dimension of widest spread, relative to its spread over all points."""
    spread = points.groupBy("node").agg(*[F.struct(F.min(d), F.max(d)).alias(d) for d in names], F.lit(0).alias("_"))
    rows = {r["node"]: r for r in spread.collect()}  # one row per node: at most as many as shards
    whole = [max(1, max(r[d][1] for r in rows.values()) - min(r[d][0] for r in rows.values())) for d in names] if rows else []
    widest = []
    for node, (n, _, _) in nodes.items():
        if n > 1:
            widths = [(rows[node][d][1] - rows[node][d][0]) / w for d, w in zip(names, whole)] if node in rows else []
            widest.append((node, max(range(len(names)), key=lambda i: (widths[i], -i)) if widths else -1))
        else:
            widest.append((node, -1))
    return points.sparkSession.createDataFrame(widest, "node int, axis int")


def _key(points: DataFrame):
    names = sorted(c for c in points.columns if c[0] == "d" and c[1:].isdigit())
    value = F.lit(0).cast("long")
    for i, d in enumerate(names):
        value = F.when(F.col("axis") == i, F.col(d)).otherwise(value)
    return F.shiftleft(value, 32).bitwiseOR(F.col("tie"))


def _cut(points: DataFrame, nodes: dict, room: list[float]) -> dict[int, tuple[int, int, int]]:
    """Per open node ``(shards below the cut, cut key, bytes below)``; ``room`` says what each shard has free.

    Each round sums the bytes of ``BINS`` equal ranges per node and goes on in the range that holds
    the wanted weight, until the range is one key or weighs next to nothing.
    """
    spark = points.sparkSession
    keyed = points.withColumn("key", _key(points))
    state = {}
    for node, (n, first, total) in nodes.items():
        if n > 1:
            share = sum(room[first : first + n // 2]) / max(1e-9, sum(room[first : first + n]))
            state[node] = {"low": _LOW, "high": _HIGH, "before": 0, "want": total * share, "total": total, "n": n}
    done = {}
    while state:
        edges = [(node, s["low"], max(1, -(-(s["high"] - s["low"] + 1) // BINS))) for node, s in state.items()]
        frame = spark.createDataFrame(edges, "node int, low long, step long")
        highs = spark.createDataFrame([(node, s["high"]) for node, s in state.items()], "node int, high long")
        hist = (
            keyed.join(F.broadcast(frame.join(highs, "node")), "node")
            .filter("key between low and high")
            .groupBy("node", ((F.col("key") - F.col("low")) / F.col("step")).cast("long").alias("bin"))
            .agg(F.sum("bytes").alias("bytes"), F.min("key").alias("least"), F.max("key").alias("most"))
            .collect()  # at most BINS rows per node
        )
        bins: dict[int, list] = {}
        for r in hist:
            bins.setdefault(r["node"], []).append(r)
        for node in list(state):
            s = state[node]
            rows = sorted(bins.get(node, []), key=lambda r: r["bin"])
            before = s["before"]
            for r in rows:
                if before + r["bytes"] >= s["want"] or r is rows[-1]:
                    break
                before += r["bytes"]
            if not rows:
                done[node] = (s["n"] // 2, s["low"], s["before"])
                state.pop(node)
            elif r["least"] == r["most"] or r["bytes"] * 20_000 <= s["total"]:
                # The cut falls before or behind this range, whichever comes nearer to the wanted weight.
                after = before + r["bytes"]
                if after - s["want"] <= s["want"] - before:
                    done[node] = (s["n"] // 2, r["most"] + 1, after)
                else:
                    done[node] = (s["n"] // 2, r["least"], before)
                state.pop(node)
            else:
                s.update(low=r["least"], high=r["most"], before=before)
    return done


def _descend(points: DataFrame, made: dict) -> DataFrame:
    spark = points.sparkSession
    rows = [(node, key) for node, (_, key, _) in made.items()]
    cut = spark.createDataFrame(rows, "node int, cut long")
    moved = points.withColumn("key", _key(points)).join(F.broadcast(cut), "node", "left")
    side = F.when(F.col("cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + F.when(F.col("key") < F.col("cut"), 1).otherwise(2))
    return moved.withColumn("node", side.cast("int"))


def _join_points(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows with the shard of their point. A point weighs 1/20 of a shard at most, so keys stay even."""
    return rows.join(placed, ["group", "part"])
