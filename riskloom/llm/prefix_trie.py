"""Prefix trie of conversations over range shards, with a skeleton of splitter paths.

A conversation is the path of its turns, one digest per turn. Splitters, paths of a sample in order,
cut the sorted conversations into shards. A node that is not the beginning of a splitter has all its
members in one shard, which finishes it in one sorted pass. Nodes on splitter paths, the skeleton, may
reach over shards: the trie of the splitters is broadcast, shards give partial sums for its nodes, and
a reduction combines them.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

DIGEST = 16  # bytes of a turn in a path
SHARD_TURNS = 20_000  # turns of a shard, about, until there are MAX_SHARDS
MAX_SHARDS = 1 << 16
SAMPLE_PER_SHARD = 16
SKELETON_NODES = 1 << 20  # splitters are cut so that they never hold more turns together
SPLITTER_TURNS = 512
CHUNK_IDS = 4096  # ids of conversations in one row of a skeleton node

COUNTED = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(conversations: DataFrame, heads: bool = True) -> DataFrame:
    """``conv_id, path, sizes``: digests and UTF-8 bytes of the rebuilt turns of every conversation.

    Turns stand by turn (null first), then role and text, so ties have one order. The first ``h``
    turns come from the first conversation of five, as far as it has them, the others are its own;
    ``h`` is ``crc32(conv_id) % 9``. Rows without a conversation id belong to none. With ``heads``
    off, conversations stay as they are.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(" "), role, text), 256), 1, 2 * DIGEST))
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.sha2(text, 256).alias("order"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"),
    ).filter("conv_id IS NOT NULL")
    group = F.col("conv_id") - F.col("conv_id") % 5
    listed = turns.withColumn("group", group).repartition("group").groupBy("group", "conv_id")
    listed = listed.agg(F.array_sort(F.collect_list(F.struct("turn", "role", "order", "digest", "size"))).alias("turns"))
    listed = listed.withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))))
    if heads:
        first = listed.filter("conv_id = group").select("group", F.slice("turns", 1, 8).alias("first"))
        h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
        own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
        head = F.slice(F.coalesce("first", F.slice("turns", 1, 0)), 1, h)
        listed = listed.join(first, "group", "left").withColumn("turns", F.concat(head, own))
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    return listed.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))


class Skeleton:
    """The trie of splitter paths: the number of each prefix, its parent, depth and children."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.numbers: dict[bytes, int] = {b"": 0}
        self.parents, self.children = [-1], [0]
        for path, _ in splitters:
            above = 0
            for end in range(DIGEST, len(path) + 1, DIGEST):
                prefix = path[:end]
                at = self.numbers.get(prefix)
                if at is None:
                    at = self.numbers[prefix] = len(self.parents)
                    self.parents.append(above)
                    self.children.append(0)
                    self.children[above] += 1
                above = at

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.splitters, (path, conv_id))

    def ancestors(self, at: int) -> list[int]:
        """The node and all above it."""
        out = []
        while at >= 0:
            out.append(at)
            at = self.parents[at]
        return out


def skeleton(paths: DataFrame, shard_turns: int = SHARD_TURNS, max_shards: int = MAX_SHARDS) -> Skeleton:
    """Splitters at the weighted quantiles of a sample of conversations.

    The sample holds about ``SAMPLE_PER_SHARD`` conversations per shard, taken by the hash of their
    ids, and paths are cut to a length that bounds the whole. Any path and id divides the order, so
    the sample decides how even shards are and nothing else.
    """
    weight = (F.size("sizes") + 1).cast("long")
    rows, total = paths.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    shards = max(1, min(max_shards, -(-total // shard_turns)))
    if shards == 1:
        return Skeleton([])
    longest = max(8, min(SPLITTER_TURNS, SKELETON_NODES // shards))
    share = min(1.0, SAMPLE_PER_SHARD * shards / rows)
    picked = paths.filter(F.pmod(F.xxhash64("conv_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    cut = F.expr(f"substring(path, 1, {longest * DIGEST})")
    sample = sorted((bytes(r.path), r.conv_id, r.w) for r in picked.select(cut.alias("path"), "conv_id", weight.alias("w")).toLocalIterator())
    step, passed, reached, splitters = sum(w for *_, w in sample) / shards, 0, 0, []
    for path, conv_id, w in sample:
        if passed >= step * (reached + 1):
            reached = int(passed / step)
            splitters.append((path, conv_id))
        passed += w
    return Skeleton(splitters)


class _Node:
    """A node whose members are being read."""

    __slots__ = ("children", "conv", "depth", "digest", "ids", "kids", "leaves", "n", "number", "saved", "size")

    def __init__(self, depth: int, size: int, number: int | None):
        self.depth, self.size, self.number = depth, size, number
        self.conv, self.n, self.kids, self.leaves, self.saved = None, 0, 0, 0, 0
        self.children: list[tuple] = []  # finished children that wait for the smallest member of this node
        self.digest = None
        self.ids: list[int] = []


class ShardPass:
    """One pass over the sorted conversations of a shard.

    Holds the open path and the finished children of its nodes, never the members.
    """

    def __init__(self, trie: Skeleton, shard: int):
        self.trie, self.shard = trie, shard
        self.path = b""
        self.open = [_Node(0, 0, 0)]
        self.nodes: list[tuple] = []  # finished nodes
        self.partials: list[tuple] = []  # sums of skeleton nodes
        self.ends: list[tuple] = []  # ids that end at skeleton nodes
        self.chunks = 0

    def read(self, conv_id: int, path: bytes, sizes: list[int]) -> None:
        if path != self.path:
            shared, limit = 0, min(len(path), len(self.path))
            while shared < limit and path[shared : shared + DIGEST] == self.path[shared : shared + DIGEST]:
                shared += DIGEST
            depth = shared // DIGEST
            while len(self.open) > depth + 1:
                self._close()
            for d in range(depth, len(sizes)):
                above = self.open[-1]
                number = None if above.number is None else self.trie.numbers.get(path[: DIGEST * (d + 1)])
                self.open.append(_Node(d + 1, sizes[d], number))
            self.path = path
        node = self.open[-1]
        node.n += 1
        node.conv = conv_id if node.conv is None else min(node.conv, conv_id)
        node.ids.append(conv_id)
        if len(node.ids) >= CHUNK_IDS:
            self._hash(node)

    def _hash(self, node: _Node) -> None:
        if not node.ids:
            return
        joined = ",".join(map(str, node.ids))
        if node.number is not None:
            self.ends.append((node.number, self.shard, self.chunks, joined))
            self.chunks += 1
        else:
            if node.digest is None:
                node.digest = hashlib.sha256()
            else:
                joined = "," + joined
            node.digest.update(joined.encode())
        node.ids = []

    def _close(self) -> None:
        node = self.open.pop()
        self._hash(node)
        above = self.open[-1] if self.open else None
        if above is not None:
            above.n += node.n
            above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
        for child in node.children:
            self.nodes.append((*child[:2], node.conv, None, *child[2:]))
        if node.number is not None:
            self.partials.append((node.number, node.conv, node.depth, node.size, node.n, node.kids, node.leaves, node.saved))
            return
        saved = node.saved + (node.n - 1) * node.size
        leaves = node.leaves if node.kids else 1
        digest = (node.digest or hashlib.sha256()).hexdigest()
        done = (node.conv, node.depth, node.n, node.kids, leaves, saved, digest)
        above.kids += 1
        above.leaves += leaves
        above.saved += saved
        if above.number is None:
            above.children.append(done)
        else:
            self.nodes.append((*done[:2], None, above.number, *done[2:]))

    def finish(self) -> None:
        while self.open:
            self._close()

    def taken(self) -> list[tuple]:
        """All that is finished so far, as rows of :data:`SHARD_ROW`."""
        rows = [(0, a, b, c, d, n, k, l, s, t) for a, b, c, d, n, k, l, s, t in self.nodes]
        rows += [(1, conv, depth, size, number, n, kids, leaves, saved, None) for number, conv, depth, size, n, kids, leaves, saved in self.partials]
        rows += [(2, shard, chunk, None, number, 0, 0, 0, 0, ids) for number, shard, chunk, ids in self.ends]
        self.nodes, self.partials, self.ends = [], [], []
        return rows


# kind 0: a finished node; 1: sums of a skeleton node, its last text's bytes in parent_conv_id; 2: ids that end
# at a skeleton node, by shard and chunk in conv_id and depth.
SHARD_ROW = pa.schema(
    [("kind", pa.int32()), *((c, pa.int64()) for c in (
        "conv_id", "depth", "parent_conv_id", "skeleton", "n_convs", "n_children", "n_leaves", "saved_tokens")),
     ("ends", pa.string())]
)
SHARD_DDL = "kind int, conv_id long, depth long, parent_conv_id long, skeleton long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, max_shards: int = MAX_SHARDS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``. A null role or text is empty, a null turn comes first, turns that tie stand by role and
    text, and equal rows are turns of their own. Rows without a conversation id are in no conversation.
    A conversation without turns ends at the root. No conversations give no nodes. Texts of any length
    count as their digest; other columns are not read.

    No task holds the members of a node: equal paths may lie in several shards, and their ids reach the
    hash in chunks, in order.
    """
    spark = conversations.sparkSession
    paths = materialize(rebuilt(conversations), "paths")
    trie = skeleton(paths, shard_turns, max_shards)
    shared = spark.sparkContext.broadcast(trie.splitters)
    n_shards = len(trie.splitters) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Skeleton(shared.value).shard
        for batch in batches:
            shards = [find(p, c) for p, c in zip(batch["path"].to_pylist(), batch["conv_id"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, pa.int64())], names=[*batch.schema.names, "shard"])

    placed = paths.mapInArrow(place, "conv_id long, path binary, sizes array<long>, shard long")
    placed = placed.repartitionByRange(n_shards, "shard").sortWithinPartitions("shard", "path", "conv_id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, now = Skeleton(shared.value), None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SHARD_ROW)], schema=SHARD_ROW)

        for batch in batches:
            for conv_id, path, sizes, shard in zip(*(batch[c].to_pylist() for c in ("conv_id", "path", "sizes", "shard"))):
                if now is None or now.shard != shard:
                    if now is not None:
                        now.finish()
                        yield batch_of(now.taken())
                    now = ShardPass(trie, shard)
                now.read(conv_id, path, sizes)
                if len(now.nodes) >= 10_000 or len(now.ends) >= 64:
                    yield batch_of(now.taken())
        if now is not None:
            now.finish()
            yield batch_of(now.taken())

    rows = materialize(placed.mapInArrow(walk, SHARD_DDL), "trie")
    sums = rows.filter("kind = 1").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_conv_id").alias("size"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
    )
    known = _skeleton_table(spark, shared, len(trie.parents))
    sums = sums.join(known, "skeleton").withColumn("n_children", F.col("n_children") + F.col("skeleton_children"))
    own_leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    sums = sums.withColumn("n_leaves", F.col("n_leaves") + own_leaf)
    sums = sums.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size"))
    sums = materialize(sums, "skeleton")
    # Splitters are cut in length, so a node has a bounded number of nodes above it.
    under = sums.select(F.explode("above").alias("skeleton"), "n_leaves", "saved_tokens")
    under = under.groupBy("skeleton").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = _digests(rows.filter("kind = 2").select("skeleton", F.col("conv_id").alias("shard"), F.col("depth").alias("chunk"), "ends"))
    empty = F.lit(hashlib.sha256().hexdigest())
    convs = sums.select("skeleton", "conv_id")  # at most SKELETON_NODES rows or 8 a shard, whatever the conversations
    parents = F.broadcast(convs.select(F.col("skeleton").alias("parent"), F.col("conv_id").alias("parent_conv")))
    crossing = sums.drop("n_leaves", "saved_tokens").join(under, "skeleton").join(ends, "skeleton", "left").join(parents, "parent", "left")
    crossing = crossing.withColumn("parent_conv_id", F.col("parent_conv")).withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    local = rows.filter("kind = 0").withColumnRenamed("ends", "ends_sha256").withColumnRenamed("skeleton", "parent")
    local = local.join(parents, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent_conv"))
    return local.select(COUNTED).union(crossing.select(COUNTED))


def _skeleton_table(spark: SparkSession, shared: Broadcast, size: int) -> DataFrame:
    """Parent, children and ancestors of each skeleton node, made in tasks from the broadcast splitters."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Skeleton(shared.value)
        for batch in batches:
            at = batch["id"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array([None if trie.parents[i] < 0 else trie.parents[i] for i in at], pa.int64()),
                 pa.array([trie.children[i] for i in at], pa.int64()), pa.array([trie.ancestors(i) for i in at], pa.list_(pa.int64()))],
                names=["skeleton", "parent", "skeleton_children", "above"],
            )

    ids = spark.range(0, size, 1, max(1, size // 10_000))
    return ids.mapInArrow(describe, "skeleton long, parent long, skeleton_children long, above array<long>")


def _digests(chunks: DataFrame) -> DataFrame:
    """SHA-256 of the chunks of each skeleton node, joined by commas in order; each is read once and not held."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, value = None, None
        for batch in batches:
            out = []
            for at, ids in zip(batch["skeleton"].to_pylist(), batch["ends"].to_pylist()):
                if at != node:
                    if node is not None:
                        out.append((node, value.hexdigest()))
                    node, value = at, hashlib.sha256(ids.encode())
                else:
                    value.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_pydict({"skeleton": [n for n, _ in out], "ends_sha256": [d for _, d in out]})
        if node is not None:
            yield pa.RecordBatch.from_pydict({"skeleton": [node], "ends_sha256": [value.hexdigest()]})

    ordered = chunks.repartition("skeleton").sortWithinPartitions("skeleton", "shard", "chunk")
    return ordered.mapInArrow(digest, "skeleton long, ends_sha256 string")
