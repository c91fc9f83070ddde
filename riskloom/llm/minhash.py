"""Near duplicates by b-bit MinHash.

Every distinct shingle set gets its minima, cut to the low bits and packed. Sets that agree on
a band of whole minima are candidates; packed signatures give a collision-corrected estimate by
bit counts, and what that cannot rule out is settled on the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, components, dealt, frequent, join_uneven, lean, materialize, release, repeated, texts
from .hashing import LOWER, WordHashes, windows

ROWS = 5  # minima in a band
MISS = 1e-6  # chance that a pair right at the threshold shares no band
BITS = 4  # low bits kept of a minimum
MARGIN = 6.5  # standard errors below the threshold at which an estimate rules a pair out
COUNTERS = 1 << 18  # of shingles, for an order with rare ones first

_SIGNED = "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>, signature binary"


def n_bands(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands needed so that a pair at the threshold is missed with a chance of ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def shingle_set(text: str | None, shingle: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one shingle as a whole."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(hashes.of(words), min(shingle, len(words))))


def _signer(shingle: int, bands: int, rows: int):
    n = bands * rows
    draw = np.random.RandomState(20_240_607)
    factors = (draw.randint(0, 2**62, n, dtype=np.int64).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
    shifts = draw.randint(0, 2**62, n, dtype=np.int64).astype(np.uint64)

    def minima(sets: list[np.ndarray]) -> np.ndarray:
        """One row of minima per set; the sets lie one after another, in blocks that fit a cache."""
        out = np.empty((len(sets), n), np.uint32)
        at = 0
        while at < len(sets):
            end, size = at, 0
            while end < len(sets) and (end == at or size + len(sets[end]) <= 16_384):
                size += len(sets[end])
                end += 1
            if end == at + 1 and size > 65_536:  # one very long text
                for i in range(n):
                    out[at, i] = min(
                        int(((sets[at][k : k + 65_536] * factors[i] + shifts[i]) >> np.uint64(32)).min())
                        for k in range(0, size, 65_536)
                    )
            else:
                block = np.concatenate(sets[at:end])
                starts = np.cumsum([0, *map(len, sets[at : end - 1])])
                work = np.empty_like(block)
                for i in range(n):
                    np.multiply(block, factors[i], out=work)
                    work += shifts[i]
                    out[at:end, i] = np.minimum.reduceat(work, starts) >> np.uint64(32)
            at = end
        return out

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        places = np.arange(8 // BITS, dtype=np.uint8) * BITS
        for batch in batches:
            sets = [shingle_set(t, shingle, hashes) for t in batch["text"].to_pylist()]
            full = [s for s in sets if len(s)]
            low = minima(full)
            whole = low.reshape(len(full), bands, rows)
            packed = (low & np.uint32(2**BITS - 1)).astype(np.uint8)
            packed = np.pad(packed, ((0, 0), (0, -n % (8 // BITS)))).reshape(len(full), -(-n * BITS // 8), 8 // BITS)
            packed = np.bitwise_or.reduce(packed << places, axis=2).astype(np.uint8)
            keys, band_keys, signatures, k = [], [], [], 0
            for s in sets:
                if not len(s):
                    keys.append(None), band_keys.append(None), signatures.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                band_keys.append(
                    [xxhash.xxh3_64_intdigest(whole[k, j].tobytes(), seed=j) - 2**63 for j in range(bands)]
                )
                signatures.append(packed[k].tobytes())
                k += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["text_hash"], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys, pa.binary()), pa.array(band_keys, pa.list_(pa.int64())), pa.array(signatures, pa.binary()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "set_key", "bands", "signature"],
            )

    return sign


def _verifier(threshold_percent: int, n: int):
    threshold, chance = threshold_percent / 100, 2.0**-BITS
    agree = chance + (1 - chance) * threshold  # share of equal low bits at the threshold, chance hits included
    least = n * agree - MARGIN * math.sqrt(n * agree * (1 - agree))
    padding = -n % (8 // BITS)
    places = [np.uint8((2**BITS - 1) << (BITS * i)) for i in range(8 // BITS)]

    def linked(a: np.ndarray, b: np.ndarray) -> bool:
        common = len(a) + len(b) - len(np.union1d(a, b))
        return 100 * common >= threshold_percent * (len(a) + len(b) - common)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left = np.frombuffer(b"".join(batch["a_signature"].to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            right = np.frombuffer(b"".join(batch["b_signature"].to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            differ = left ^ right
            equal = sum((differ & place == 0).sum(axis=1) for place in places) - padding
            keep = np.zeros(batch.num_rows, bool)
            for i in np.flatnonzero(equal >= least):
                keep[i] = linked(
                    np.frombuffer(batch["a_members"][i].as_buffer(), np.uint64),
                    np.frombuffer(batch["b_members"][i].as_buffer(), np.uint64),
                )
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return verify


def _members(shingle: int):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, shingle, hashes).tobytes() for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["set_key"], batch["signature"], pa.array(sets, pa.binary())], names=["set_key", "signature", "members"]
            )

    return fetch


def _across_groups(active: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of sets of different groups that may reach the threshold; none that do are missing.

    In an order of all shingles, rare ones first, similar sets share one within their prefixes, and
    what follows the first shared one bounds their overlap. So near copies that differ from each
    other in too much never meet, however many share most of their words. The order comes from
    counters of bounded number, summed over all sets. Of the sets that meet at a shingle, those
    outside its largest group meet the others, so a large group forms no pairs within itself.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for members in batch["members"]:
                total += np.bincount(np.frombuffer(members.as_buffer(), np.uint64) & np.uint64(COUNTERS - 1), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    counted = active.select("members").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    weight = np.zeros(COUNTERS, np.int64)
    weight[counted["at"].to_numpy(int)] = counted["n"].to_numpy(int)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, places, sizes = [], [], []
            for members in batch["members"]:
                tokens_here = np.frombuffer(members.as_buffer(), np.uint64)
                n = len(tokens_here)
                length = n - -(-percent * n // 100) + 1
                order = np.lexsort((tokens_here, weight[tokens_here & np.uint64(COUNTERS - 1)]))[:length]
                tokens.append(tokens_here[order].view(np.int64))
                places.append(np.arange(length, dtype=np.int32))
                sizes.append(np.full(length, n, np.int32))
            repeat = pa.array(np.repeat(np.arange(batch.num_rows), [len(t) for t in tokens]))
            flat = [np.concatenate(c) for c in (tokens, places, sizes)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[0]), pa.array(flat[1]), pa.array(flat[2]), batch["set_key"].take(repeat), batch["root"].take(repeat)],
                names=["token", "place", "size", "set_key", "root"],
            )

    held = active.mapInArrow(prefixes, "token long, place int, size int, set_key binary, root binary")
    held = materialize(held, "prefixes")
    by_root = held.groupBy("token", "root").agg(F.count("*").alias("n"))
    main = by_root.groupBy("token").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("main"))
    met = materialize(join_uneven(held, main.filter("roots > 1").drop("roots"), "token"), "met")
    release(held)
    minor = met.filter("root <> main").select(
        "token", F.col("place").alias("b_place"), F.col("size").alias("b_size"), F.col("set_key").alias("b"), F.col("root").alias("b_root")
    )
    left = F.least(F.col("size") - F.col("place"), F.col("b_size") - F.col("b_place"))
    enough = (100 + percent) * left >= percent * (F.col("size") + F.col("b_size"))
    other = F.expr("root <> b_root and (root = main or set_key > b)")
    return join_uneven(met, minor, "token").filter(other & enough).select(F.col("set_key").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity_percent: int = 80, rows: int = ROWS) -> DataFrame:
    """Per document its near-duplicate group: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when the Jaccard similarity of their sets of ``shingle``-word shingles
    reaches ``similarity_percent``; groups are the connected components, named by their smallest
    doc_id, whose document is kept. A null or empty text, or one without words, has no shingles
    and is linked with nothing. Every row counts as a document: rows that share an id share the
    verdict of that id, and a null id is its own (null) group name unless a partner has an id.
    Equal sets are one node, so copies cost one row each. Other columns are not read.
    """
    grouped = _grouped(docs, shingle, similarity_percent, rows)
    least = grouped.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    with_group = join_uneven(grouped.filter("group is not null"), least, "group")
    alone = grouped.filter("group is null").withColumn("least", F.col("doc_id"))
    return with_group.unionByName(alone).select(
        "doc_id", "n_shingles", F.col("least").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("least")).alias("kept")
    )


def first_of_each(docs: DataFrame, shingle: int = 5, similarity_percent: int = 80, rows: int = ROWS) -> DataFrame:
    """One row of each near-duplicate group, with all its columns: that of the smallest doc_id.

    Rows that repeat an id and a text count as one. Rows without words are in no group and all stay.
    """
    grouped = _grouped(docs, shingle, similarity_percent, rows)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = grouped.filter("group is not null").groupBy("group").agg(F.min(place).alias("at"), F.count("*").alias("rows"))
    same_id = grouped.filter("group is not null").groupBy("doc_id", "text_hash").count().filter("count > 1")
    first = first.select(F.col("at.doc_id").alias("id"), F.col("at.text_hash").alias("hash")).join(
        same_id.select(F.col("doc_id").alias("same"), F.col("text_hash").alias("as"), F.lit(True).alias("repeated")),
        F.col("id").eqNullSafe(F.col("same")) & (F.col("hash") == F.col("as")), "left",
    ).drop("same", "as")
    # The row as one column, so that no name of its columns meets one of ours.
    text = F.col("text").cast("string")
    with_words = F.coalesce(text.rlike(f"[^{SPACE}]"), F.lit(False))
    rows_of = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("own"), F.xxhash64(text).alias("own_hash"), with_words.alias("words"))
    stay = rows_of.filter("words").join(first, F.col("own").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("hash")))
    once = stay.filter("repeated is null").select("row")
    again = stay.filter("repeated").withColumn("whole", F.col("row.text")).dropDuplicates(["own", "whole"]).select("row")
    return once.unionByName(again).unionByName(rows_of.filter("not words").select("row")).select("row.*")


def _grouped(docs: DataFrame, shingle: int, similarity_percent: int, rows: int) -> DataFrame:
    """``doc_id, text_hash, n_shingles, group`` per row, stored; the group is null without shingles."""
    bands = n_bands(similarity_percent / 100, rows)
    hashed = texts(docs).withColumn("text_hash", F.xxhash64("text"))
    signed = materialize(hashed.mapInArrow(lean(_signer(shingle, bands, rows)), _SIGNED), "signed")
    nodes = signed.filter("n_shingles > 0").groupBy("set_key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("rep"),
        F.first(F.struct("bands", "signature")).alias("print"),
    )
    nodes = materialize(nodes.select("set_key", "rep.doc_id", "rep.text_hash", "print.bands", "print.signature"), "nodes")

    # Buckets of two sets or more, with their sizes; the members of all buckets grow with the sets.
    spread = nodes.select("set_key", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    spread = materialize(spread, "spread")
    members = materialize(join_uneven(spread, shared, "bucket"), "members")
    release(spread)
    # A set that meets many others lies in the middle of its group: the best one to compare all with.
    reach = members.groupBy("set_key").agg(F.sum("size").alias("reach"))
    members = materialize(members.drop("size").join(reach, "set_key"), "members")

    wanted = nodes.join(reach.select("set_key"), "set_key").select("set_key", "doc_id", "text_hash", "signature")
    found = hashed.alias("d").join(
        wanted.alias("w"), (F.col("d.text_hash") == F.col("w.text_hash")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
    )
    found = found.select("w.set_key", "w.signature", "d.text").dropDuplicates(["set_key"])
    sets = materialize(found.mapInArrow(lean(_members(shingle)), "set_key binary, signature binary, members binary"), "sets")

    verify = _verifier(similarity_percent, bands * rows)

    def settle(pairs: DataFrame) -> DataFrame:
        placed, sides = pairs, {}
        for side in ("a", "b"):
            hot = frequent(pairs, side)
            placed = dealt(placed, hot, side, f"_{side}")
            of = sets.select(F.col("set_key").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in ("signature", "members")])
            sides[side] = repeated(of, hot, side, f"_{side}")
        for side, of in sides.items():
            placed = placed.join(of, [side, f"_{side}"])
        columns = ["a", "b", "a_signature", "b_signature", "a_members", "b_members"]
        return placed.select(columns).mapInArrow(lean(verify), "a binary, b binary")

    # One pivot per bucket, the set of most reach, meets all members.
    top = members.groupBy("bucket").agg(F.max(F.struct("reach", "set_key")).alias("top"))
    pivots = top.select("bucket", F.col("top.set_key").alias("b"))
    pairs = join_uneven(members, pivots, "bucket").filter("set_key <> b").select(F.col("set_key").alias("a"), "b")
    links = materialize(settle(materialize(pairs.distinct(), "pairs")), "similar")
    groups = components(links)

    # Buckets of one group are settled; the members of the others are compared across groups.
    roots = reach.select("set_key").join(groups, F.col("set_key") == F.col("node"), "left")
    roots = materialize(roots.select("set_key", F.coalesce("root", "set_key").alias("root")), "roots")
    by_group = members.join(roots, "set_key").groupBy("bucket", "root").agg(F.lit(1).alias("_"))
    mixed = by_group.groupBy("bucket").agg(F.count("*").alias("groups")).filter("groups > 1").select("bucket")
    active = join_uneven(members, mixed, "bucket").select("set_key").distinct()
    active = materialize(active.join(roots, "set_key").join(sets.select("set_key", "members"), "set_key"), "active")
    if not active.isEmpty():
        pairs = materialize(_across_groups(active, similarity_percent), "pairs")
        links = materialize(links.union(settle(pairs)), "similar")
        groups = components(links)

    named = signed.join(groups.withColumnRenamed("node", "set_key"), "set_key", "left")
    named = named.withColumn("group", F.coalesce("root", "set_key"))
    return materialize(named.select("doc_id", "text_hash", "n_shingles", "group"), "named")
