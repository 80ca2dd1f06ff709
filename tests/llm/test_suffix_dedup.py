import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from corpora import make

from starwright.llm import suffix_dedup as s


def brute(rows, depth):
    """Digests by counting every window."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    windows = Counter(t[p:p + depth] for _, t in texts for p in range(len(t) - depth + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - depth + 1):
            if windows[t[p:p + depth]] > 1:
                gone[p:p + depth] = True
        starts = int(((gone[1:].astype(int) - gone[:-1]) == 1).sum() + gone[0])
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), len(t) - len(kept), starts, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, depth):
    got = s.removal_digests(make(spark, rows, extra=True), depth=depth).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, depth)


def test_matches_brute_force(spark, documents):
    check(spark, documents, s.DEPTH)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlapping_and_partial_repeats(spark, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcd") for _ in range(700))
    rows = []
    for i in range(25):
        a, n = rng.randrange(600), rng.randrange(20, 160)
        rows.append((i, "".join(rng.choice("abcd") for _ in range(rng.randrange(60))) + base[a:a + n]
                     + "".join(rng.choice("abcdé") for _ in range(rng.randrange(60)))))
    rows += [(90, "a" * 300), (91, "ab" * 150), (92, None), (93, "")]
    check(spark, rows, 100)


def test_text_over_several_buffers(spark, monkeypatch):
    """Cuts inside a long text lose no window.  Workers read the module's
    constant, so the real buffer size is used."""
    rng = np.random.default_rng(1)
    body = rng.integers(97, 123, 2_300_000, np.uint8).tobytes().decode()
    at = s._BUFFER - 500  # across the first cut
    rows = [(1, body), (2, body[at:at + 900]), (3, body[2_200_000:2_200_450])]
    got = {r["doc_id"]: r for r in s.removal_digests(make(spark, rows)).collect()}
    assert got[1]["n_removed"] == 1350 and got[1]["n_spans"] == 2
    assert got[2]["n_removed"] == 900 and got[3]["n_removed"] == 450
    assert got[1]["kept_sha256"] == hashlib.sha256((body[:at] + body[at + 900:2_200_000] + body[2_200_450:]).encode()).hexdigest()


def test_remove_repeats_keeps_rows_and_columns(spark, documents):
    docs = make(spark, documents, extra=True)
    out = s.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(documents)
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert kept[100] is None and kept[101] == "" and kept[105] == ""
    assert kept[501] == dict(documents)[501]


def test_empty_table(spark):
    docs = make(spark, [])
    assert s.removal_digests(docs).count() == 0 and s.remove_repeats(docs).count() == 0
