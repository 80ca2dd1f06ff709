import random
import re

import numpy as np
import pytest
from corpora import make

from starwright.llm import components, ngram_join as j


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(x), low[find(k)]) for k, (i, x) in enumerate(sets))


def test_matches_brute_force(spark, documents):
    got = j.linked_groups(make(spark, documents, extra=True)).collect()
    assert sorted(tuple(r) for r in got) == brute(documents)


@pytest.mark.parametrize("limits", [{}, {"GROUP_BLOCK": 20}, {"HOT": 3, "BUCKET": 500}, {"HOT": 40, "GROUP_BLOCK": 7}])
def test_large_groups(spark, documents, monkeypatch, limits):
    """Groups of many classes, whole and dealt out in blocks, with n-grams that
    are counted and with such that are too frequent for it."""
    for name, value in limits.items():
        monkeypatch.setattr(j, name, value)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = list(documents)
    for i in range(150):  # likeness around the threshold, many unlinked pairs
        own = list(base)
        for _ in range(rng.randint(1, 3)):
            own[rng.randrange(60)] = f"x{i}{rng.random()}"
        rows.append((1000 + i, " ".join(own)))
    got = j.linked_groups(make(spark, rows)).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_shingler_on_buffers_and_long_words():
    """Hashes depend on the text alone, not on what it is hashed with."""
    shingle = j.Shingler()
    rng = random.Random(3)
    texts = [None, "", " ", "A b\tC\x0bd\x0cE f", "x" * 300 + " y z u v w", "one", "É é é é é ß"]
    texts += [" ".join(rng.choice("abcdef") * rng.randint(1, 5) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    long = " ".join(str(i) for i in range(400_000))  # several buffers
    texts += [long, "q" * (j._BUFFER + 5) + " r s t u v", long.upper() + " end"]
    alone = [shingle.sets([t])[0] for t in texts]
    assert all((a == b).all() for a, b in zip(alone, shingle.sets(texts)))
    assert [len(x) for x in alone] == [len(shingles(t)) for t in texts]
    assert len(np.intersect1d(alone[-3], alone[-1])) == len(alone[-3])
    seen = {}
    for t, x in zip(texts, alone):
        assert seen.setdefault(frozenset(shingles(t)), x.tobytes()) == x.tobytes()


def test_letters_with_own_words(spark):
    """Letters of one template, own words at or beyond what a link allows: the
    n-grams of the template come too late in the order to make any pair."""
    body = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(body[:15] + [f"a{i}"] + body[15:35] + [f"b{i}"] + body[35:])) for i in range(300)]
    assert sorted(tuple(r) for r in j.linked_groups(make(spark, rows)).collect()) == brute(rows)
    docs = make(spark, rows).select("doc_id", "text")
    scratch = j.Scratch(spark, "test")
    members, cells = j.first_pass(docs, scratch)
    grams = j.shared_grams(j.all_grams(docs, spark.sparkContext.broadcast(cells), 4, 10**6), 4)
    records = scratch.write(j.prefix_records(grams, members, 4), "records")
    assert j.first_turn(records, records.selectExpr("token", "1 blocks").limit(0)).count() == 0


def test_order_is_by_exact_counts(spark, documents):
    """Places and followers of the prefix n-grams, against counts by hand."""
    docs = make(spark, documents).select("doc_id", "text").where("doc_id is not null")
    scratch = j.Scratch(spark, "test")
    members, cells = j.first_pass(docs, scratch)
    sets = {j._set_key(x): x for x in j.shingler().sets([r["text"] for r in docs.collect()]) if len(x)}
    count = {}
    for x in sets.values():
        for g in x.tolist():
            count[g] = count.get(g, 0) + 1
    want = set()
    for key, x in sets.items():
        order = sorted((count[g] << 48 | g & ((1 << 48) - 1), count[g]) for g in x.tolist())
        odd = np.zeros(j.PARITY, np.uint8)
        for g, c in order:
            odd[g % j.PARITY] ^= c > 1
        parity = np.packbits(odd).tobytes()
        for i, (g, c) in enumerate(order[:j.prefix_length(len(x))]):
            if c > 1:
                want.add((g, key, len(x), i, sum(o == 1 for _, o in order), parity, tuple(o for o, _ in order[i + 1:i + 1 + j.REST])))
    for buckets in (1, 3, 50):
        grams = j.shared_grams(j.all_grams(docs, spark.sparkContext.broadcast(cells), buckets, 10**6), buckets)
        got = [(r["token"], r["set_key"], r["n"], r["pos"], r["alone"], bytes(r["parity"]), tuple(np.frombuffer(r["rest"], "<u8").tolist()))
               for r in j.prefix_records(grams, members, buckets).collect()]
        assert set(got) == want and len(got) == len(want) and want


def test_beginnings_miss_no_link():
    """Whatever begins alike is found by both sides, and nothing in the class's
    own component; the bound never takes a linked pair away."""
    rng = random.Random(4)
    for few, width in ((0, 16), (1, 4), (4, 64), (99, 1), (99, 64), (0, 1024)):
        def parity(x):
            odd = 0
            for g in x:
                odd ^= 1 << g % width
            return odd

        sets = {}
        for key in range(120):
            own = set(rng.sample(range(1, 60), 40)) if key % 2 else set(range(1, 41)) - set(rng.sample(range(1, 41), 5))
            sets[key] = [0, *sorted(own)]  # all have n-gram 0
        tree = j.Beginnings(())
        for key, x in sets.items():
            tree.add(key, len(x), len(x) - 1, key % 7, 0, parity(x), tuple(x[1:1 + few]))
        for key, x in sets.items():
            got = list(tree.partners(len(x), len(x) - 1, key % 7, 0, parity(x), tuple(x[1:1 + few])))
            assert len(got) == len(set(got)) and all(k % 7 != key % 7 for k in got)
            linked = {k for k, y in sets.items() if k % 7 != key % 7
                      and 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y))}
            assert linked <= set(got)
            if few == 99 or width >= 64:
                assert linked == set(got)


def test_trie_finds_what_brute_force_finds():
    rng = np.random.default_rng(0)
    base = np.sort(rng.choice(10_000, 80, replace=False)).astype(np.uint64)
    sets = []
    for _ in range(120):
        own = set(base.tolist())
        for x in rng.choice(base, rng.integers(0, 14), replace=False):
            own.discard(int(x))
            own.add(int(rng.integers(0, 10_000)))
        sets.append(np.array(sorted(own), np.uint64))
    sets += [sets[0][:30], sets[0][:70], sets[0]]
    trie = j.Trie(base[:0])
    for k, x in enumerate(sets):
        trie.add(x, k)
    for probe in (base, sets[0], sets[5][:50]):
        want = [k for k, x in enumerate(sets) if 100 * (o := len(np.intersect1d(x, probe))) >= 80 * (len(x) + len(probe) - o)]
        assert sorted(trie.similar(probe)) == want


def test_prefixes_share_enough():
    """The filter's bound: alike sets share this many of their first n-grams."""
    for a in range(1, 60):
        for b in range(1, 60):
            if 100 * min(a, b) >= 80 * max(a, b):
                assert j.prefix_length(a) - a + j.needed(a, b) >= 1 and j.prefix_length(b) - b + j.needed(a, b) >= 1


def test_drop_near_copies(spark, documents):
    docs = make(spark, documents, extra=True)
    out = j.drop_near_copies(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.where("doc_id is not null").select("doc_id").distinct().collect()) == sorted(
        {i for i, _, low in brute(documents) if i == low})
    assert out.where("doc_id is null").count() == 1


def test_empty_table(spark):
    assert j.linked_groups(make(spark, [])).count() == 0


@pytest.mark.parametrize("edges,want", [
    ([], {}),
    ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}),
    ([(5, i) for i in range(30) if i != 5] + [(50, 51), (51, 52), (52, 50), (60, 60)],
     {i: 0 for i in range(30)} | {50: 50, 51: 50, 52: 50}),
])
def test_components(spark, edges, want):
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == want and got.count() == len(want)
