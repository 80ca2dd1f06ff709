import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from starwright.llm import common
from starwright.llm import conversation_trie as c

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, rebuild):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {k: [x[2:] for x in sorted(v)] for k, v in own.items()}
    paths = own
    if rebuild:
        paths = {}
        for k, turns in own.items():
            h = zlib.crc32(str(k).encode()) % 6
            paths[k] = own.get(k - k % 100, [])[:h] + turns[h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for k, turns in sorted(paths.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(k)
            if d:
                kids[tuple(turns[:d - 1])].add(turns[d - 1])
        ends[tuple(turns)].append(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own_members in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(own_members) - 1) * len(node[-1][1]) if node else 0
    return sorted(((m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(kids[n]), leaves[n], saved[n],
                    hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in members.items()), key=str)


def got(spark, rows, rebuild, extra=False):
    chats = spark.createDataFrame(rows, SCHEMA)
    if extra:
        for name in ("pos", "depth", "a", "b", "n", "place", "part", "chars", "key", "base", "number", "gain"):
            chats = chats.withColumn(name, F.lit("x"))
    return sorted((tuple(r) for r in c.conversation_trie(chats.repartition(3), rebuild).collect()), key=str)


def chats(seed, n=120, turns=9, texts=3):
    rng = random.Random(seed)
    rows = [(k, t, "ua"[t % 2], rng.choice(("hi", "é🙂", "", "x y")[:texts])) for k in range(n)
            for t in range(rng.randint(1, turns))]
    return rows


ODD = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"),
       (None, 0, "user", "none"), (2, 5, "", ""), (200, 0, "user", "base"), (205, 0, "user", "own"), (205, 1, "user", "more"),
       (302, 0, "user", "no base"), (303, 0, "a", "bc"), (304, 0, "ab", "c"), (305, 0, "a:b", "c"), (-7, 0, "user", "x"),
       (-7, 1, "user", "y"), (-305, 0, "a", "z")]


@pytest.mark.parametrize("rebuild", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, rebuild, seed):
    rows = [r for r in ODD if r[0] is None or r[0] >= 0] + [(400 + r[0], *r[1:]) for r in chats(seed)]
    assert got(spark, rows, rebuild, extra=seed == 2) == brute(rows, rebuild)


def test_negative_ids_without_rebuilding(spark):
    assert got(spark, ODD, False) == brute(ODD, False)


@pytest.mark.parametrize("batch", [1, 2, 7])
def test_blocks_of_any_size(spark, monkeypatch, batch):
    """Forests of blocks of one to seven classes merge to the same trie."""
    monkeypatch.setattr(common, "BATCH_ROWS", batch)
    rows = chats(batch, 80, 6, 2)
    assert got(spark, rows, False) == brute(rows, False)


@pytest.mark.parametrize("batch", [2, 10_000])
def test_long_conversations(spark, monkeypatch, batch):
    """Conversations over several segments that part, end or repeat inside a
    segment, at its border, and right after it."""
    monkeypatch.setattr(common, "BATCH_ROWS", batch)
    rng = random.Random(5)
    base = [("ua"[t % 2], f"turn {t}" * (t % 3)) for t in range(5 * c.SEGMENT)]
    rows = []
    for k, cut in enumerate([0, 1, 15, 16, 17, 31, 32, 33, 33, 48, 70, 80, 80, 80, 16, 32]):
        own = base[:cut] + [("u", f"own {k % 3}")] * (0 if k % 4 == 0 else rng.randint(1, 40))
        rows += [(k, t, role, text) for t, (role, text) in enumerate(own)]
    for rebuild in (False, True):
        assert got(spark, rows, rebuild) == brute(rows, rebuild)


def test_one_conversation_holds_most_rows(spark):
    rows = [(1, t, "u", str(t % 7)) for t in range(400)] + [(2, t, "u", str(t % 7)) for t in range(150)] + [
        (3 + r[0], *r[1:]) for r in chats(3, 20)]
    assert got(spark, rows, False) == brute(rows, False)


def test_a_large_group_of_copies(spark):
    """Ends of a node are digested in pieces."""
    rows = [(k, 0, "u", "same") for k in range(30_000)] + [(50_000, 0, "u", "other")]
    assert got(spark, rows, False) == brute(rows, False)


def test_no_turns_left_and_empty_table(spark):
    lone = [k for k in range(300, 400) if zlib.crc32(str(k).encode()) % 6 >= 2][:3]  # no base: nothing is left
    rows = [(k, 0, "u", "x") for k in lone if k % 100]
    assert got(spark, rows, True) == brute(rows, True)
    assert got(spark, [], True) == [] and got(spark, [(None, 0, "u", "x")], False) == []


def test_hashes_are_the_same_in_both_languages(spark):
    keys = [(0, "a" * 22), (3, "é" * 30), (10**12, ""), (7, "xyz" * 200)]
    df = spark.createDataFrame(keys, "segment long, key string")
    rows = df.select("segment", "key", *[h.alias(f"h{i}") for i, h in enumerate(c._hashes(F.col("segment"), F.col("key")))])
    for r in rows.collect():
        assert (r["h0"], r["h1"]) == c._hash(r["segment"], r["key"])
