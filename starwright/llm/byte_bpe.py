"""Byte-level BPE as a streaming transducer with bounded lookahead.

A text is cut into words by the tokenizer's pattern, and a word's bytes are
merged pair by pair in the order of the merge list.  Both steps run on a stream:

*Sufficient lookahead.*  Let two words begin with the same bytes x and differ
after them.  Merges are applied rule by rule, each from left to right, so after
any rule there is a boundary f in x, common to both, left of which all tokens
are equal; at first f is the end of x.  Rule (a, b) moves f only if a ends at f
and b begins at f in one of the two words, and then to the start of a; each rule
does so once.  What begins at f afterwards grows from a, so the next rule (a',
b') that moves f has a on the left spine of b', grown there by rules not before
(a, b).  The longest such chain of rules, weighed by the bytes of their left
operands, is how far f can move: ``MergeList.lookahead``.  It depends on the
merge list alone.  Tokens that end at least so many bytes before the end of what
was read are final; they are emitted, and the rest of the word goes on as if it
were a word of its own, because no merge crosses a final boundary.

*Words.*  A match of the pattern that ends two characters before the end of what
was read is final.  A run that reaches the end of a long stretch is fed to the
merges while it is still open.  So an encoder holds a stretch of text and of an
open word's bytes, both bounded, whatever the length of texts and words.

Decoding maps ids to bytes and bytes to text with a state machine for UTF-8 that
keeps at most three bytes between calls; bytes that are not UTF-8 become U+FFFD.

Defined results: a null text is empty and has no ids; special tokens are found
in texts as the library finds them; ids outside the vocabulary decode to
nothing; null ids, repeated rows and extra columns are kept as rows, one output
row per input row (further columns are left out); an empty table stays empty.
"""

from __future__ import annotations

import codecs
import functools
import heapq
import json
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwright.llm.common import batch_limits, whole_text

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
# Characters read at a time, words kept per process, and the longest kept word.
STRETCH, CACHED_WORDS, CACHED_BYTES = 1 << 16, 400_000, 40

# FIXED VALUES: the pattern that byte-level BPE cuts words with.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# The classes of characters that its runs are made of.
_RUNS = [regex.compile(c) for c in (r"\p{L}*+", r"\p{N}*+", r"\s*+", r"[^\s\p{L}\p{N}]*+")]
_SPACE = _RUNS[2]


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary: printable Latin-1
    characters for themselves, the others by 256, 257, ... in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = (b for b in range(256) if b not in set(own))
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class MergeList:
    """The merges of a byte-level tokenizer file, over token ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                 and not pre.get("add_prefix_space") and not spec.get("normalizer")
                 and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix",
                                                    "byte_fallback", "ignore_merges"))
                 and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")))
        if not plain:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        vocab, letters = model["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.first = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]  # id of each byte
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.pairs = {(a, b): (rank, own) for rank, (a, b, own) in enumerate(rules)}
        self.lookahead = self._sufficient_lookahead(rules)

    def _sufficient_lookahead(self, rules: list[tuple[int, int, int]]) -> int:
        made: dict[int, tuple[int, int]] = {}  # token -> rank of its rule, left operand
        reach: dict[int, tuple[list[int], list[int]]] = {}  # left operand -> ranks, largest reach up to each
        most = 0
        for rank, (a, b, own) in enumerate(rules):
            if own in made or any(len(self.bytes_of[x]) > 1 and x not in made for x in (a, b)):
                raise ValueError("the merge list is not in an order in which tokens are built once")
            before, s, limit = 0, b, rank - 1
            while True:  # down the left spine of b; limit: the rule that grows s
                ranks, best = reach.get(s, ((), ()))
                if k := bisect_right(ranks, limit):
                    before = max(before, best[k - 1])
                if s not in made:
                    break
                limit, s = made[s]
            own_reach = len(self.bytes_of[a]) + before
            ranks, best = reach.setdefault(a, ([], []))
            ranks.append(rank)
            best.append(max(own_reach, best[-1] if best else 0))
            made[own] = (rank, a)
            most = max(most, own_reach)
        return most

    def merge(self, data: bytes) -> list[int]:
        """Ids of a word's bytes."""
        ids = [self.first[b] for b in data]
        return self._merge_short(ids) if len(ids) < 48 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        pairs, none = self.pairs, (1 << 62, -1)
        found = [pairs.get(p, none) for p in zip(ids, ids[1:])]
        while found:
            rule = min(found)
            if rule is none:
                break
            k = found.index(rule)
            ids[k:k + 2] = [rule[1]]
            del found[k]
            if k:
                found[k - 1] = pairs.get((ids[k - 1], ids[k]), none)
            if k < len(found):
                found[k] = pairs.get((ids[k], ids[k + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs by rank and place."""
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[p][0], k, p) for k, p in enumerate(zip(ids, ids[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            j = after[k]
            if j >= n or (ids[k], ids[j]) != pair:
                continue
            ids[k], ids[j] = pairs[pair][1], -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (p := (ids[left], ids[right])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], left, p))
        return [i for i in ids if i >= 0]


class OpenWord:
    """A word that is still being read: bytes go in, final ids come out."""

    def __init__(self, merges: MergeList, chunk: int = 2048):
        self.merges, self.tail = merges, b""
        self.limit = merges.lookahead + max(chunk, merges.lookahead)

    def feed(self, data: bytes) -> Iterator[int]:
        for k in range(0, len(data), self.limit):
            self.tail += data[k:k + self.limit]
            if len(self.tail) < self.limit:
                break
            end, final = 0, len(self.tail) - self.merges.lookahead
            for i in self.merges.merge(self.tail):
                if (stop := end + len(self.merges.bytes_of[i])) > final:
                    break
                end = stop
                yield i
            self.tail = self.tail[end:]

    def finish(self) -> list[int]:
        out, self.tail = self.merges.merge(self.tail), b""
        return out


class Encoder:
    """Text in, packed little-endian 32-bit ids out, as soon as they are final."""

    def __init__(self, merges: MergeList, stretch: int = STRETCH):
        self.merges, self.stretch = merges, stretch
        self.seen: dict[str, bytes] = {}
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(merges.special, key=len, reverse=True)) or r"(?!)")
        self._start()

    def _start(self) -> None:
        self.held = ""  # may begin a special token
        self.rest = ""  # words that are not final
        self.open: tuple[OpenWord, regex.Pattern] | None = None

    def encode(self, text: str) -> bytes:
        """Ids of a whole text."""
        return b"".join(self.stream(text[k:k + self.stretch] for k in range(0, len(text), self.stretch)))

    def stream(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of the text that the parts make up."""
        self._start()
        for text in texts:
            yield from self._feed(text)
        yield from self._words(self.held, True)

    def _feed(self, text: str) -> Iterator[bytes]:
        text = self.held + text
        at = 0
        for m in self.special.finditer(text):
            yield from self._words(text[at:m.start()], True)
            yield self._pack([self.merges.special[m[0]]])
            at = m.end()
        held = max((n for s in self.merges.special for n in range(1, len(s)) if text.endswith(s[:n], at)), default=0)
        self.held = text[len(text) - held:]
        yield from self._words(text[at:len(text) - held], False)

    def _words(self, text: str, last: bool) -> Iterator[bytes]:
        """Reads on; ``last``: the text, or what a special token ends, is over."""
        text, self.rest = self.rest + text, ""
        if self.open:
            word, run = self.open
            n = run.match(text).end()
            more = n == len(text) and not last
            if run is _SPACE and (n < len(text) or more):
                n = max(n - 1, 0)  # the last space belongs to what follows
            yield self._pack(word.feed(text[:n].encode("utf-8", "surrogatepass")))
            if more:
                self.rest = text[n:]
                return
            yield self._pack(word.finish())
            text, self.open = text[n:], None
        words = WORDS.findall(text)
        if not last:
            end, held = len(text), 0
            while words and end > len(text) - 2:
                end -= len(words[-1])
                self.rest = words.pop() + self.rest
                held += 1
        yield self._encode(words)
        if len(self.rest) > max(self.stretch, 3) and held == 1:  # longer than any contraction: a run
            run = next(r for r in _RUNS if r.match(self.rest[-1]).end())
            word = OpenWord(self.merges)
            cut = len(self.rest) - 1
            yield self._pack(word.feed(self.rest[:cut].encode("utf-8", "surrogatepass")))
            self.rest, self.open = self.rest[cut:], (word, run)

    def _encode(self, words: list[str]) -> bytes:
        seen = self.seen
        if len(seen) > CACHED_WORDS:
            seen.clear()
        long = {}
        for w in set(words).difference(seen):
            data = w.encode("utf-8", "surrogatepass")
            if len(data) <= CACHED_BYTES:
                seen[w] = self._pack(self.merges.merge(data))
            else:
                word = OpenWord(self.merges)
                long[w] = self._pack([*word.feed(data), *word.finish()])
        if not long:
            return b"".join(map(seen.__getitem__, words))
        return b"".join([long[w] if w in long else seen[w] for w in words])

    @staticmethod
    def _pack(ids: Iterable[int]) -> bytes:
        return np.fromiter(ids, "<i4").tobytes()


class Decoder:
    """Ids in, text out; up to three bytes wait for the rest of a character."""

    def __init__(self, merges: MergeList):
        self.bytes_of = merges.bytes_of
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join([self.bytes_of.get(i, b"") for i in ids]))

    def finish(self) -> str:
        return self.state.decode(b"", True)

    def decode(self, ids: np.ndarray) -> str:
        """Text of whole ids, read ``STRETCH`` at a time."""
        self.state.reset()
        parts = [self.feed(ids[k:k + STRETCH].tolist()) for k in range(0, len(ids), STRETCH)]
        return "".join([*parts, self.finish()])


@functools.lru_cache(maxsize=2)
def merge_list(path: str) -> MergeList:
    """The merge list of this process."""
    return MergeList(path)


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(merge_list(path))


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every text, array of int."""

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            packed = [encoder.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)])
            ids = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], ["doc_id", "ids"])

    batch_limits(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the text of every row's ids; null ids are none."""

    def run(batches):
        decoder = Decoder(merge_list(path))
        for batch in batches:
            ids = batch.column(1)
            text = [decoder.decode(np.asarray(own.values.drop_null()) if own.is_valid else np.empty(0, int)) for own in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(text, pa.string())], ["doc_id", "ids", "text"])

    batch_limits(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
