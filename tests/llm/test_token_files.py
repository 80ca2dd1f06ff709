import zlib

import numpy as np
import pytest
from corpora import make
from hypothesis import given, settings
from hypothesis import strategies as st
from test_packing import library_ids

from starwright.llm import rans, token_files
from starwright.llm.tokens import tokenizer_path


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=3000), st.integers(0, 5))
def test_rans_round_trip(symbols, more):
    symbols = np.array(symbols * (more + 1), np.uint16)
    table = rans.Table(np.bincount(symbols, minlength=rans.SYMBOLS))
    assert (rans.decode(rans.encode(symbols, table), table) == symbols).all()


def test_rans_is_close_to_the_entropy():
    rng = np.random.default_rng(0)
    symbols = np.minimum(rng.zipf(1.3, 400_000), 60_000).astype(np.uint16)
    counts = np.bincount(symbols, minlength=rans.SYMBOLS)
    used = counts[counts > 0] / len(symbols)
    entropy = -(used * np.log2(used)).sum() * len(symbols) / 8
    assert len(rans.encode(symbols, rans.Table(counts))) < 1.02 * entropy + 8 * rans.LANES + 100


def test_damage_is_noticed():
    symbols = np.arange(5000, dtype=np.uint16)
    table = rans.Table(np.bincount(symbols, minlength=rans.SYMBOLS))
    block = bytearray(rans.encode(symbols, table))
    block[len(block) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(block), table)


def test_files_hold_every_document_in_order(spark, documents, tmp_dir):
    rows = [(i, t) for i, t in documents if i is not None and i != 105] + [(600, "word " * 300_000), (601, "after")]
    path = f"{tmp_dir}/files"
    token_files.write_files(make(spark, rows, extra=True), path, tokenizer_path())
    want, before = [], 0
    rows.sort()
    for (i, _), ids in zip(rows, library_ids([t for _, t in rows])):
        ids = np.array([*ids, 1], "<u4")
        want.append((i, before, len(ids), zlib.crc32(ids.tobytes())))
        before += len(ids)
    assert max(n for _, _, n, _ in want) > 2 * token_files.BLOCK  # a document of several blocks
    assert sorted(tuple(r) for r in token_files.read_digests(spark, path).collect()) == want
    blocks = spark.read.parquet(f"{path}/blocks").collect()
    firsts = sorted((b["first"], sum(r["length"] for r in b["runs"])) for b in blocks)
    assert [f for f, _ in firsts] == list(np.cumsum([0, *(n for _, n in firsts)])[:-1])  # checkpoints
    assert all(n <= token_files.BLOCK for _, n in firsts)


def test_repeated_rows_and_null_ids(spark, tmp_dir):
    path = f"{tmp_dir}/files"
    token_files.write_files(make(spark, [(2, "b"), (1, "a"), (1, "a"), (None, "c c"), (1, None)]), path, tokenizer_path())
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.read_digests(spark, path).collect())
    assert [(d, n) for _, d, n in got][:1] == [(None, 3)] and sorted(d for _, d, _ in got[1:]) == [1, 1, 1, 2]
    assert [s for s, _, _ in got] == list(np.cumsum([0, *(n for _, _, n in got)])[:-1])


def test_empty_table(spark, tmp_dir):
    path = f"{tmp_dir}/files"
    token_files.write_files(make(spark, []), path, tokenizer_path())
    assert token_files.read_digests(spark, path).count() == 0


def test_new_words_are_encoded_many_at_a_time():
    from starwright.llm import tokens

    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgäßé"), 6)) for _ in range(3000)] + ["\ufb01ne", "\ufb1d", "\u0130zmir"]  # two split by their normal form
    texts = [" ".join([*rng.choice(words, 200), "a<|endoftext|>. b!!", "e\u0301! J\u030c. x**;", "it's 5%, ½!"]) for _ in range(60)]
    encoder = tokens.WordEncoder(tokenizer_path(), "<u2")
    calls, plain = [], encoder._pack
    encoder._pack = lambda some: (calls.extend(some), plain(some))[1]
    got = encoder.encode(texts)
    assert got == [np.array(ids, "<u2").tobytes() for ids in library_ids(texts)]
    assert len(calls) < 3 * tokens.AT_ONCE  # words one by one: marks, and parts with words that split
    assert encoder.encode([]) == [] and encoder.encode(["", "a"])[0] == b""
