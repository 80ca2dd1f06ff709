import zlib
from collections import Counter

import numpy as np
import pytest
from corpora import make
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from starwright.llm import packing as p
from starwright.llm.tokens import WordEncoder, tokenizer_path


def library_ids(texts):
    t = Tokenizer.from_file(tokenizer_path())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_word_encoder_equals_the_library(documents):
    odd = ["", "  ", "áb ́x e ́", "ΣΑΣ Σ", "x\x1cy \x85z w", "<|startoftext|> a<|endoftext|>b", "I'm we'll don't 's",
           "a\tb\r\nc.", "İ ẞ ŉ", "end. _. 1. é, x.y. ...", "🙂" * 300, "z" * 500 + " z" * 3]
    texts = [t or "" for _, t in documents] + odd
    encoder = WordEncoder(tokenizer_path())
    for _ in range(2):  # cold and from the cache
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == library_ids(texts)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_patterns_hold_every_piece_once(sizes):
    counts = np.zeros(65, np.int64)
    for length, n in sizes.items():
        counts[length] = n
    placed = np.zeros(65, np.int64)
    for lengths, times in p.best_two_fit(counts):
        assert 0 < sum(lengths) <= 64 and times > 0
        for length in lengths:
            placed[length] += times
    assert (placed == counts).all()


def test_second_step_replaces_the_smallest_piece():
    """Greedy takes 6 + 3 of 10; 6 + 2 + 2 fills the bin."""
    counts = np.zeros(11, np.int64)
    counts[[6, 3, 2]] = 1, 1, 2
    assert p.best_two_fit(counts)[0] == ([6, 2, 2], 1)


def test_close_to_the_bound():
    rng = np.random.default_rng(0)
    counts = np.bincount(np.minimum(rng.geometric(1 / 500, 20_000), 2048), minlength=2049)
    bins = sum(times for _, times in p.best_two_fit(counts))
    assert bins <= 1.002 * np.ceil((counts * np.arange(2049)).sum() / 2048)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_every_piece_has_its_place(spark, documents, capacity):
    rows = [(i, t) for i, t in documents if i is not None and i != 105]
    got = p.pack(make(spark, rows, extra=True), tokenizer_path(), capacity).collect()
    want = Counter()
    for (i, _), ids in zip(rows, library_ids([t for _, t in rows])):
        ids = np.array([*ids, 0], "<u4")
        for k, start in enumerate(range(0, len(ids), capacity)):
            own = ids[start:start + capacity]
            want[i, k, start, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0, *(n for _, n in own)])[:-1]) and sum(n for _, n in own) <= capacity
    assert len(sequences) <= 1.005 * sum(r["length"] for r in got) / capacity + 1


def test_repeated_rows_and_null_ids_are_packed(spark):
    got = p.pack(make(spark, [(1, "a b"), (1, "a b"), (None, "c"), (2, None)]), tokenizer_path()).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in got) == [("1", 3), ("1", 3), ("2", 1), ("None", 2)]
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 4


def test_empty_table(spark):
    assert p.pack(make(spark, []), tokenizer_path()).count() == 0
