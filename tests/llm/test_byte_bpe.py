import hashlib
import json
import random

import numpy as np
import pytest
from corpora import make
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starwright.llm import byte_bpe as b

PATH = b.tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "b", "the", " ", "  ", "\n", "'", "s", "'re", "ll", "1", "22", "é", "한", "🙂", "<|endoftext|>", "<|endof",
         "<", "|", ".", "\t", "　", "\x85", "'ve", "x" * 45, " " * 50, " ", "²", "Ⅷ", "é"]


def ids(packed):
    return np.frombuffer(packed, "<i4").tolist()


def texts(n, seed=1, parts=PARTS, size=60):
    rng = random.Random(seed)
    return ["".join(rng.choices(parts, k=rng.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize("stretch", [1, 2, 7, 64, b.STRETCH])
def test_stream_equals_library(stretch):
    """Whatever the stretches a text is read in, the ids are the library's."""
    encoder = b.Encoder(b.merge_list(PATH), stretch)
    for text, want in zip(t := texts(1500, stretch), LIBRARY.encode_batch(t, add_special_tokens=False)):
        assert ids(encoder.encode(text)) == want.ids


def test_long_words_in_bounded_memory(monkeypatch):
    rng = random.Random(3)
    merges = b.merge_list(PATH)
    most = 0
    feed = b.OpenWord.feed

    def watched(word, data):
        nonlocal most
        yield from feed(word, data)
        most = max(most, len(word.tail))

    monkeypatch.setattr(b.OpenWord, "feed", watched)
    long = ["a" * 50_000, " " * 70_000 + "x", "ab" * 30_000, "é" * 20_000, "\n" * 30_000, "1" * 40_000, "x" + " " * 70_000,
            "".join(rng.choices("abcdeilnorst", k=100_000)), "".join(rng.choices("=-_*#", k=90_000)), "<|endoftext|>" * 300,
            "한글" * 20_000, "a" * 65_536 + "<|endoftext|>", " " * 65_536 + "<|endoftext|>"]
    for stretch in (1000, b.STRETCH):
        encoder = b.Encoder(merges, stretch)
        for text, want in zip(long, LIBRARY.encode_batch(long, add_special_tokens=False)):
            assert ids(encoder.encode(text)) == want.ids
    assert 0 < most < 2048 + 2 * merges.lookahead


def small_list(tmp_path, seed, letters="ab", n=25):
    """A random merge list over few letters, as a tokenizer file."""
    rng = random.Random(seed)
    vocab = {c: k for k, c in enumerate(b.byte_letters())}
    tokens, merges = list(letters), []
    while len(merges) < n:
        x, y = rng.choice(tokens), rng.choice(tokens)
        if x + y not in vocab and len(x + y) < 12:
            vocab[x + y] = len(vocab)
            tokens.append(x + y)
            merges.append([x, y])
    base = json.loads(open(PATH, encoding="utf-8").read())
    base["model"] |= {"vocab": vocab, "merges": merges}
    base["added_tokens"] = []
    path = str(tmp_path / f"{seed}-{letters}.json")
    open(path, "w", encoding="utf-8").write(json.dumps(base))
    return path


@pytest.mark.parametrize("seed", range(40))
def test_lookahead_is_sufficient(tmp_path, seed):
    """Tokens that end a lookahead before the end of what was read stay, however
    the word goes on; on random merge lists, where chains of rules are dense."""
    letters = ("ab", "abc", "a")[seed % 3]
    merges = b.MergeList(path := small_list(tmp_path, seed, letters, 25 if letters != "a" else 8))
    library = Tokenizer.from_file(path)
    rng = random.Random(seed)
    size = lambda token: len(merges.bytes_of[token])
    for _ in range(150):
        read = "".join(rng.choices(letters, k=rng.randint(1, 60)))
        final = []
        at = 0
        for token in merges.merge(read.encode()):
            at += size(token)
            if at > len(read) - merges.lookahead:
                break
            final.append(token)
        for _ in range(6):
            word = read + "".join(rng.choices(letters, k=rng.randint(0, 40)))
            whole = library.encode(word, add_special_tokens=False).ids
            assert whole[:len(final)] == final
            assert merges._merge_long([merges.first[c] for c in word.encode()]) == whole
            assert merges._merge_short([merges.first[c] for c in word.encode()]) == whole
            opened = b.OpenWord(merges, 1)
            got = [i for k in range(0, len(word), 5) for i in opened.feed(word[k:k + 5].encode())] + opened.finish()
            assert got == whole


def test_other_tokenizers_are_refused(tmp_path):
    with pytest.raises(ValueError):
        b.MergeList(b.tokenizer_path("word_bpe_49k.json"))
    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "x.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        b.MergeList(str(tmp_path / "x.json"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decoder_equals_library(seed):
    """Any ids, also those whose bytes are not UTF-8, and fed in any parts."""
    rng = random.Random(seed)
    merges = b.merge_list(PATH)
    for _ in range(400):
        own = rng.choices([*range(180, 256), *range(100), 50256, 60000, rng.randrange(50257)], k=rng.randint(0, 30))
        want = LIBRARY.decode([i for i in own if i < 50257], skip_special_tokens=False)
        decoder = b.Decoder(merges)
        assert decoder.decode(np.array(own, int)) == want
        decoder.state.reset()
        assert "".join(decoder.feed([i]) for i in own) + decoder.finish() == want


def test_operator(spark, documents):
    rows = [*documents, (700, "a<|endoftext|> b<|endof"), (701, "z" * 3000 + " tail")]
    for extra in (False, True):
        encoded = b.encode_texts(make(spark, rows, extra), PATH)
        got = b.decode_ids(encoded, PATH).collect()
        want = sorted(((i, LIBRARY.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in rows), key=str)
        assert sorted(((r["doc_id"], r["ids"], r["text"]) for r in got), key=str) == want
    none = b.decode_ids(b.encode_texts(make(spark, []), PATH), PATH)
    assert none.collect() == [] and none.columns == ["doc_id", "ids", "text"]
    odd = spark.createDataFrame([(1, None), (2, [None, 64]), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in b.decode_ids(odd, PATH).collect()} == {1: "", 2: "a", 3: ""}


def test_query(spark):
    from starwright.llm.queries import op12_byte_bpe

    sf = "/root/testdata/sf0.001"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit(""))).collect():
        own = LIBRARY.encode(r[1], add_special_tokens=False).ids
        want.append((r[0], len(own), sha(",".join(map(str, own))), sha(LIBRARY.decode(own, skip_special_tokens=False))))
    got = op12_byte_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
