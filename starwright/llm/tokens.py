"""Token ids of whole texts by a public word BPE, encoded word by word.

The tokenizer drops white space and never joins what it separates, so the ids
of a text are the ids of its words one after the other.  Each worker process
keeps the packed ids of words it has seen (a bounded number) from task to task.
Arrow splits a batch of texts and numbers its distinct words, so that only those
are looked up, and numpy puts their ids together.  New words of letters alone
are encoded many at a time: a word's last token is marked as such in the
vocabulary.  Chunks over ``LONG`` characters are encoded each time.
"""

from __future__ import annotations

import functools
import json
import os
from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_WORDS, LONG = 1_000_000, 64
AT_ONCE = 500  # words encoded as one text
DEFAULT_TOKENIZER = "word_bpe_49k.json"
# The tokenizer always cuts between a letter or digit and marks after it.  Marks
# of its special tokens and accents that join a letter are not among these.
_ENDS = r"([\p{L}\p{N}])([!?#$%*.,;:]+[ \n])"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes texts to packed little-endian ids of the given dtype."""

    def __init__(self, path: str, dtype: str = "<u4"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        if self.tokenizer.get_vocab_size() > np.iinfo(self.dtype).max:
            raise ValueError(f"ids of {path} do not fit into {dtype}")
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.seen: dict[str, bytes] = {"": b""}
        # Which ids end a word; none where the vocabulary does not say.
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        if suffix:
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True

    def _pack(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _pack_letters(self, words: list[str]) -> list[bytes]:
        """As ``_pack``, for words of letters alone."""
        out: list[bytes] = []
        parts = [words[i:i + AT_ONCE] for i in range(0, len(words), AT_ONCE)]
        for part, found in zip(parts, self.tokenizer.encode_batch_fast([" ".join(p) for p in parts],
                                                                       add_special_tokens=False)):
            ids = np.array(found.ids, self.dtype)
            ends = np.flatnonzero(self.ends[ids]) + 1
            # A word gives at least one end, more if its normal form has marks.
            if len(ends) != len(part) or ends[-1] != len(ids):
                out += self._pack(part)
                continue
            packed, cuts = ids.tobytes(), [0, *(ends * self.dtype.itemsize).tolist()]
            out += [packed[i:j] for i, j in zip(cuts, cuts[1:])]
        return out

    def encode(self, texts: Sequence[str] | pa.Array) -> list[bytes]:
        """Packed ids of each text."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        # Only the blank and the line feed are cut at here (and marks that end a
        # word); any other white space stays inside a chunk
        # and is left to the tokenizer.
        cut = pc.replace_substring_regex(texts, _ENDS, r"\1 \2")
        split = pc.split_pattern(pc.replace_substring(cut, "\n", " "), " ")
        flat = split.flatten().dictionary_encode()
        words = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.seen) > CACHED_WORDS:
            self.seen = {"": b""}
        seen = self.seen
        packed = list(map(seen.get, words))
        new = [w for w, ids in zip(words, packed) if ids is None]
        if new:
            short = [w for w in new if len(w) <= LONG]
            letters = [w for w in short if w.isalpha()]
            seen.update(zip(letters, self._pack_letters(letters)))
            other = [w for w in short if not w.isalpha()]
            seen.update(zip(other, self._pack(other)))
            long = [w for w in new if len(w) > LONG]
            once = dict(zip(long, self._pack(long)))
            packed = [(once.get(w) or seen.get(w, b"")) if ids is None else ids for w, ids in zip(words, packed)]
        # The ids of all words one after the other, by the words' numbers.
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // self.dtype.itemsize
        first = np.cumsum(size) - size
        number = flat.indices.to_numpy()
        sizes = size[number]
        before = np.concatenate(([0], np.cumsum(sizes)))
        at = np.repeat(first[number] - before[:-1], sizes)
        at += np.arange(len(at))
        ids = np.frombuffer(b"".join(packed), self.dtype)[at].tobytes()
        cuts = (before[split.offsets.to_numpy() - split.offsets[0].as_py()] * self.dtype.itemsize).tolist()
        return [ids[i:j] for i, j in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=2)
def word_encoder(path: str, dtype: str = "<u4") -> WordEncoder:
    """The encoder of this process."""
    return WordEncoder(path, dtype)
