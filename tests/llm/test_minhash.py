import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import chunk_dedup, minhash
from riskloom.llm.common import components, join_uneven, materialize, number_rows


def plain_groups(rows, shingle, percent):
    """Smallest reachable id per row from all pairs."""

    def shingles(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        if not words:
            return set()
        n = min(shingle, len(words))
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}

    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("shingle, percent", [(3, 85), (5, 80)])
def test_groups_equal_all_pairs(documents, shingle, percent):
    rng = random.Random(shingle)
    rows = []
    for family in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([8, 60, 200]))]
        for copy in range(rng.choice([1, 3, 9])):
            words = edited(rng, base, rng.randrange(1 + len(base) // 25) if copy else 0)
            rows.append((len(rows) * 7 % 101, " ".join(words)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "one Word"), (204, "ONE word"), (205, "one other")]
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents(*rows), shingle, percent).collect()}
    assert found == plain_groups(rows, shingle, percent)


def test_chain_around_a_missing_middle(documents):
    """Members that are similar to the middle of a group only, in a group larger than any bucket's pivot alone."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))] + [(i, " ".join(edited(rng, base, 8))) for i in range(1, 40)]
    expected = plain_groups(rows, 3, 85)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents(*rows), 3, 85).collect()}
    assert found == expected


def test_awkward_rows(awkward, no_documents):
    found = minhash.near_duplicates(awkward)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = found.collect()
    assert len(rows) == 10
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append((r.n_shingles > 0, r.component_id, r.kept))
    assert sorted(by_id[None]) == [(False, None, True), (True, None, True)]
    assert by_id[1] == [(False, 1, True)] and by_id[3] == [(False, 3, True)]
    assert by_id[5] == [(True, 5, True)] and by_id[6] == [(True, 5, False)] * 2
    assert minhash.near_duplicates(no_documents).count() == 0
    kept = minhash.first_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 0), (False, 0), (True, 1), (True, 2), (True, 3), (True, 4), (True, 5), (True, 7)
    ]
    assert minhash.first_of_each(no_documents).count() == 0


def test_estimate_never_rules_out_a_link():
    """The bound on equal low bits lies far below what a pair at the threshold shows."""
    rng = np.random.RandomState(1)
    n = minhash.n_bands(0.85) * minhash.ROWS
    agree = 2.0**-minhash.BITS + (1 - 2.0**-minhash.BITS) * 0.85
    least = n * agree - minhash.MARGIN * (n * agree * (1 - agree)) ** 0.5
    assert (rng.binomial(n, agree, 200_000) >= least).all()
    assert (1 - 0.85**minhash.ROWS) ** minhash.n_bands(0.85) <= 1e-6


def test_components_equal_a_plain_search(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(2000, 2001 + i) for i in range(200)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    expected = {n: root(n) for e in edges if e[0] != e[1] for n in e}
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in components(frame).collect()} == expected
    assert components(frame.limit(0)).count() == 0


def test_uneven_join_and_numbers(spark):
    large = materialize(spark.range(5000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("k"), "id"), "t")
    small = spark.createDataFrame([(7, "x"), (4500, "y"), (9999, "z")], "k long, v string")
    found = join_uneven(large, small, "k")
    assert found.count() == 4001 and found.select("id").distinct().count() == 4001
    numbered = number_rows(large.withColumn("g", F.when(F.col("k") == 7, F.lit(None)).otherwise(F.col("k") % 2)), ["g"], "n", 100)
    for _, rows in numbered.toPandas().groupby("g", dropna=False):
        assert sorted(rows["n"]) == list(range(len(rows)))


def test_columns_named_like_helpers(spark):
    names = ["_id", "_hash", "_repeated", "_tag", "_cuts", "_part", "_row", "row", "own", "id", "hash", "words", "repeated", "same", "cuts", "tag"]
    rows = [(i, f"one two three four five six seven {i % 3}", *range(len(names))) for i in range(9)] + [(9, None, *range(len(names)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    kept = minhash.first_of_each(docs, 3, 85)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 9]
    assert minhash.near_duplicates(docs, 3, 85).count() == 10
    cut = chunk_dedup.without_repeats(docs, chunk_dedup.repeated_passages(docs))
    assert cut.columns == docs.columns and cut.count() == 10 and {r.words for r in cut.collect()} == {names.index("words")}
