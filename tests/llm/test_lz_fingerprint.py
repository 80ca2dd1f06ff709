import hashlib

import numpy as np
import pytest
from corpora import make

from starwright.llm import lz_fingerprint as z


def phrases(text):
    """Phrases of the parse, as text."""
    known, start = set(), 0
    for i in range(1, len(text) + 1):
        if text[start:i] not in known:
            known.add(text[start:i])
            start = i
    return known


def test_likeness_estimates_the_phrase_sets(documents):
    texts = [t for _, t in documents if t and len(t) > 400][:14]
    for a in texts:
        for b in texts:
            x, y = phrases(a), phrases(b)
            exact = len(x & y) / len(x | y)
            assert abs(z.likeness(z.fingerprint(a), z.fingerprint(b)) - exact) < 0.2
    assert (z.fingerprint(texts[0]) == z.fingerprint(str(texts[0]))).all()


def test_fork_equals_a_parse_from_the_start(documents):
    texts = [t or "" for _, t in documents]
    for a, b in zip(texts, texts[1:]):
        own, edited, text = z.with_edit(a, b)
        assert (own == z.fingerprint(a)).all() and (edited == z.fingerprint(text)).all()


def test_dictionary_starts_anew(monkeypatch, documents):
    monkeypatch.setattr(z, "DICTIONARY", 50)
    text = dict(documents)[501]
    parse = z.Parse().feed(text)
    assert len(parse.known) < 50 and (parse.result() == z.fingerprint(text)).all()


@pytest.mark.parametrize("partitions", [1, 4, 30])
def test_next_document_across_ranges(spark, documents, partitions):
    rows = sorted((i, t or "") for i, t in documents if i is not None)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted(z.compare_edits(make(spark, documents, extra=True)).collect(), key=lambda r: (r["doc_id"], r["n_chars"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    for k, ((i, t), r) in enumerate(zip(rows, got)):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        assert (r["doc_id"], r["n_chars"]) == (i, len(t))
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == z.fingerprint(t).tobytes().hex()
        assert r["edited_fingerprint"] == z.fingerprint(edited).tobytes().hex()
        assert np.isclose(r["near_edited"], z.likeness(z.fingerprint(t), z.fingerprint(edited)))
        assert np.isclose(r["near_next"], z.likeness(z.fingerprint(t), z.fingerprint(after)))


def test_one_document_and_none(spark):
    row = z.compare_edits(make(spark, [(1, "abcd")])).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert z.compare_edits(make(spark, [])).count() == 0
    assert z.fingerprints(make(spark, [(1, None), (2, "")])).select("fingerprint").distinct().count() == 1
