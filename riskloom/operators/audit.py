"""Checks on results: leaks, determinism, untouched corpora, accuracy against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..storage import materialize

# Characters of a secret, from its end, that make the join key; shorter secrets are keys as a whole.
KEY_LENGTH = 16
PIECE = 512  # characters of a text whose windows start in one row
BITS_PER_KEY = 16
MAX_BITS = 1 << 26  # 8 MB


def key_bitmap(keys: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row, ``bits`` as longs: bit ``hash % size`` is set for each ``_key``, with 16 bits a key up to ``max_bits``.

    With more keys than that the bitmap fills up and spares less; what it lets through is joined all the same.
    """
    wanted = max(64, keys.count() * BITS_PER_KEY)
    size = min(max_bits, 1 << (wanted - 1).bit_length())
    bit = F.pmod(F.xxhash64("_key"), F.lit(size))
    words = keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).cast("int").alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set"))
    every = keys.sparkSession.range(size >> 6).select(F.col("id").cast("int").alias("word"))
    filled = every.join(words, "word", "left").select("word", F.coalesce("set", F.lit(0).cast("long")).alias("set"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "set")))  # at most max_bits / 64 of them
    return filled.agg(F.transform(ordered, lambda w: w["set"]).alias("bits"))


def windows_met(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``_id, _key``: windows of ``texts(_id, text)`` that the bitmap of ``keys(_key)``, a stored table, lets through.

    All windows that equal a key are among them, and few others: windows are tested where they are
    cut, so a text makes about as many rows as it holds keys.
    """
    # At most KEY_LENGTH lengths, one set of windows for each.
    lengths = sorted(r["n"] for r in keys.select(F.length("_key").alias("n")).distinct().collect())
    # A character of a long string is found by walking to it, so texts are cut to pieces first.
    cuts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int"))
    piece = F.transform(cuts, lambda k: F.substring(F.col("text"), k * PIECE + 1, F.lit(PIECE + KEY_LENGTH - 1)))
    bitmap = key_bitmap(keys.select("_key").distinct())
    pieces = texts.select("_id", F.explode(piece).alias("piece")).withColumn("bits", bitmap.scalar())

    def is_set(window):
        def test(bit):
            word = F.get(F.col("bits"), F.shiftright(bit, 6).cast("int"))
            return F.getbit(word, bit.bitwiseAND(63).cast("int")) == 1

        return let(F.pmod(F.xxhash64(window), F.size("bits").cast("long") * 64), test)

    def windows(n: int):
        last = F.least(F.lit(PIECE), F.length("piece") - (n - 1))
        at = F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.col("piece"), i, F.lit(n)))
        return F.when(last >= 1, F.filter(at, is_set))

    none = F.array().cast("array<string>")
    found = F.array_distinct(F.concat(none, *[F.coalesce(windows(n), none) for n in lengths]))
    return pieces.select("_id", F.explode(found).alias("_key"))


def leak_audit(findings: DataFrame, secrets: DataFrame) -> DataFrame:
    """Findings whose snippet, message or fix still shows a known secret of any length.

    A substring search as an equality join: the last characters of each secret meet the windows of
    that length in the texts, as ``(text id, window)``; a bitmap of the keys drops nearly all windows
    before they become rows. Only hits fetch their text and are checked in full. ``findings`` and the
    distinct texts are read more than once; the texts are stored here.
    """
    keyed = secrets.select("secret").distinct().filter(F.length("secret") > 0)
    keyed = materialize(keyed.withColumn("_key", F.right("secret", F.least(F.length("secret"), F.lit(KEY_LENGTH)))), "secrets")
    fields = F.explode(
        F.array(
            *[F.struct(F.lit(name).alias("field"), F.col(name).alias("text")) for name in ("snippet", "message", "fix")]
        )
    )
    where = ["scan_id", "rule_id", "file_path", "line_number", "pos"]
    texts = findings.select(*where, fields.alias("f")).select(*where, "f.*")
    # Messages and fixes repeat in every finding of a rule, so each text is searched once.
    single = texts.select("field", "text").filter(F.length("text") > 0).distinct()
    single = materialize(single.withColumn("_id", F.monotonically_increasing_id()), "texts")
    pairs = windows_met(single.select("_id", "text"), keyed).join(keyed, "_key").select("_id", "secret").distinct()
    leaking = single.join(pairs, "_id").filter(F.col("text").contains(F.col("secret"))).select("field", "text", "secret")
    return texts.join(leaking, ["field", "text"]).select(*where, "field", "secret")


def determinism_audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that differ in number between two runs; none when the runs are equal."""
    columns = sorted(first.columns)
    sides = first.select(*columns, F.lit(1).alias("_n")).unionByName(second.select(*columns, F.lit(-1).alias("_n")))
    return sides.groupBy(*columns).agg(F.sum("_n").alias("surplus")).filter(F.col("surplus") != 0)


def corpus_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files that were added, removed or changed, by content hash."""

    def hashed(files: DataFrame, name: str) -> DataFrame:
        return files.select("scan_id", "path", F.sha2(F.col("content").cast("binary"), 256).alias(name))

    both = hashed(before, "hash_before").join(hashed(after, "hash_after"), ["scan_id", "path"], "full_outer")
    change = (
        F.when(F.col("hash_before").isNull(), F.lit("added"))
        .when(F.col("hash_after").isNull(), F.lit("removed"))
        .when(F.col("hash_before") != F.col("hash_after"), F.lit("changed"))
    )
    return both.withColumn("change", change).filter(F.col("change").isNotNull())


def evaluate(predicted: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Confusion counts and ratios. ``predicted`` holds keys, ``truth`` keys and ``positive``."""
    flagged = predicted.select(key).distinct().withColumn("_hit", F.lit(True))
    both = truth.select(key, F.col("positive")).join(flagged, key, "left").fillna({"_hit": False})
    hit, positive = F.col("_hit"), F.col("positive")
    counts = both.agg(
        F.count_if(hit & positive).alias("tp"),
        F.count_if(hit & ~positive).alias("fp"),
        F.count_if(~hit & positive).alias("fn"),
        F.count_if(~hit & ~positive).alias("tn"),
    )

    def ratio(top: str, *bottom: str):
        total = sum((F.col(b) for b in bottom[1:]), F.col(bottom[0]))
        return F.when(total != 0, F.col(top).cast("double") / total)

    return counts.withColumns(
        {"precision": ratio("tp", "tp", "fp"), "recall": ratio("tp", "tp", "fn"), "fpr": ratio("fp", "fp", "tn")}
    )
