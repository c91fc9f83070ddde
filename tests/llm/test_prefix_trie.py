import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from riskloom.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """The trie as dictionaries of whole prefixes."""
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                children[tuple(v[: d - 1])].add(tuple(v[:d]))
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(rebuilt[c]) == len(node))))
        leaves, saved, left = 0, 0, [node]
        while left:
            at = left.pop()
            leaves += not children[at]
            saved += (len(members[at]) - 1) * len(at[-1][1].encode()) if at else 0
            left += children[at]
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(conversations, **options):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(conversations, **options).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for c in [*range(-20, 300), 10**12]:
        if rng.random() < 0.1:
            continue
        template = rng.randrange(8)
        for t in range(rng.randrange(12) if rng.random() < 0.9 else 60):
            role = rng.choice(["user", "user", None, ""]) if rng.random() < 0.3 else "user"
            text = rng.choice([f"tpl {template} {t}"] * 12 + [None, "", f"é{rng.randrange(3)}"])
            out.append((c if rng.random() < 0.995 else None, rng.choice([t, t, t, None, 3]), role, text))
    # nothing is left of these, or one conversation stands many times
    out += [(c, 0, "user", "common") for c in range(1000, 1400)]
    return out + out[:40]


def test_equals_plain_trie(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain(rows)
    for options in ({}, {"shard_turns": 37}, {"shard_turns": 300}):
        assert found(frame, **options) == want


def test_short_splitters_and_chunks_change_nothing(spark, rows, monkeypatch):
    for name, value in (("SPLITTER_TURNS", 8), ("SKELETON_NODES", 4), ("CHUNK_IDS", 3), ("SAMPLE_PER_SHARD", 2)):
        monkeypatch.setattr(prefix_trie, name, value)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert found(frame, shard_turns=20) == plain(rows)


def test_equal_conversations_spread_over_shards(spark):
    rows = [(5 * i, 0, "user", "the same") for i in range(500)]
    paths = prefix_trie.rebuilt(spark.createDataFrame(rows, SCHEMA)).cache()
    trie = prefix_trie.skeleton(paths, shard_turns=100)
    assert len(trie.splitters) > 5 and len(trie.parents) == 2
    sizes = defaultdict(int)
    for r in paths.collect():
        sizes[trie.shard(bytes(r.path), r.conv_id)] += 1
    assert max(sizes.values()) < 200
    assert found(spark.createDataFrame(rows, SCHEMA), shard_turns=100) == plain(rows)


def test_empty_tables_other_columns_and_long_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == [] and found(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []
    rows = [(1, 0, "user", "x" * 300_000), (2, 0, "user", "x" * 300_000), (3, None, None, None)]
    more = spark.createDataFrame([(*r, 1, "p", 0) for r in rows], SCHEMA + ", depth int, path string, shard long")
    assert found(more) == plain(rows)
