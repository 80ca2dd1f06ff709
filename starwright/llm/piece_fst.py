"""SentencePiece encoding and decoding as weighted finite-state transduction.

Compiled once per process from a model file:

* no normaliser: texts get a dummy blank in front and every blank becomes the
  escape character, by plain string replacement; models whose normaliser does
  more (a character map, white-space removal) are refused;
* the *pieces* transducer: a trie over the vocabulary, one arc per piece;
* the *byte fallback*: for a character without a piece, one path over the
  pieces of its UTF-8 bytes, at a cost of BYTE each;
* for models that merge pairs (BPE), the *neighbour* acceptor: it reads pieces
  and lets piece b follow piece a only if merging the text of both gives a and
  b again.  A sequence of pieces is the merge result of its text just when all
  its neighbours pass, so the composition has one accepted path, and its arcs
  carry no weights.  For unigram models arcs weigh minus the log probability,
  and any piece may follow.

A text is composed with these; a state is a position and the piece that ends
there.  For models that merge pairs the one accepted path is searched depth
first, with backtracking; for unigram models the path of least weight (tropical
semiring) is read off, left to right.
The composition is done chunk by chunk: no piece holds a blank after another
character, so paths never cross there, nor between two characters that are
neighbours in no piece.  Paths of chunks seen before are kept (a bounded
number).

Decoding is the inverse transduction: pieces to text, byte pieces to bytes (bad
UTF-8 becomes U+FFFD), escapes to blanks, without the dummy blank.

Defined results: null and empty texts have no ids and decode to the empty text;
U+2581 in a text decodes to a blank; rows that repeat are separate rows and rows
with a null id are kept; further columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwright.llm.common import batch_limits, whole_text

SPACE = "▁"
BYTE = 1000.0  # above any sum of piece weights of one character
CHUNKS, PAIRS, LONG = 600_000, 400_000, 64
_NORMAL, _USER, _BYTE = 1, 4, 6  # kinds of pieces in the model format
_UNIGRAM, _BPE = 1, 2
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models with the identity normaliser are supported")
        if model.trainer_spec.model_type not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.dummy = SPACE if norm.add_dummy_prefix else ""
        self.merges = model.trainer_spec.model_type == _BPE
        self.ids, self.scores, self.byte_ids, self.output = {}, {}, {}, []
        for i, p in enumerate(model.pieces):
            out = b""
            if p.type in (_NORMAL, _USER):
                self.ids[p.piece], self.scores[p.piece] = i, p.score
                out = p.piece.replace(SPACE, " ").encode()
            elif p.type == _BYTE:
                out = bytes([int(p.piece[3:-1], 16)])
                self.byte_ids[out[0]] = i
            self.output.append(out)
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        self.joined = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        # Pieces by merging that merging never makes are no arcs.
        arcs = [p for p in self.ids if len(p) == 1 or not self.merges or self._merge(p) == [p]]
        self.trie: dict = {}
        for p in arcs:
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = (self.ids[p], p, 0.0 if self.merges else -self.scores[p])
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunks: dict[str, bytes] = {}

    # -- neighbour acceptor

    def _merge(self, text: str) -> list[str]:
        """Pieces of a short text: the neighbours whose union has the best
        score are joined, the leftmost first, until no union is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def _may_follow(self, a: str | None, b: str | None) -> bool:
        if not self.merges or a is None or b is None or a[-1] + b[0] not in self.joined:
            return True
        key = (a, b)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._merge(a + b) == [a, b]
        return known

    # -- composition and shortest path

    def _arcs(self, text: str, i: int) -> list[tuple]:
        """Arcs from position i: (end, ids, piece, weight), shortest first."""
        node, j, found, n = self.trie, i, [], len(text)
        while j < n and (node := node.get(text[j])) is not None:
            j += 1
            if "" in node:
                found.append((j, *node[""]))
        if text[i] not in self.ids:
            ids = tuple(self.byte_ids[b] for b in text[i].encode())
            found.append((i + 1, ids, None, BYTE * len(ids)))
        return found

    def _only_path(self, text: str) -> list[int]:
        """Ids on the one path that the neighbour acceptor leaves (all others
        weigh infinitely much): depth first, the longest pieces first; a state
        from which no path goes on is not entered twice."""
        n, at, last, dead = len(text), 0, None, set()
        path: list[tuple] = []  # (ids, state before, arcs not tried there)
        arcs = self._arcs(text, 0)
        while at < n:
            while arcs:
                end, ids, piece, _ = arcs.pop()
                if (end, piece) not in dead and self._may_follow(last, piece):
                    path.append((ids, (at, last), arcs))
                    at, last = end, piece
                    arcs = self._arcs(text, at) if at < n else []
                    break
            else:
                dead.add((at, last))
                _, (at, last), arcs = path.pop()
        return [i for ids, _, _ in path for i in (ids if isinstance(ids, tuple) else (ids,))]

    def _shortest(self, text: str) -> list[int]:
        """Ids on the path of least weight through a normalised text."""
        n = len(text)
        # states[i]: last piece (None: bytes or the start) -> weight, ids, state before
        states: list[dict] = [{} for _ in range(n + 1)]
        states[0][None] = (0.0, (), None)
        for i in range(n):
            here = states[i]
            if not here:
                continue
            for j, ids, piece, weight in self._arcs(text, i):
                for last, (cost, *_rest) in here.items():
                    if self._may_follow(last, piece):
                        old = states[j].get(piece)
                        if old is None or cost + weight < old[0]:
                            states[j][piece] = (cost + weight, ids, (i, last))
        last = min(states[n], key=lambda p: states[n][p][0])
        at, out = n, []
        while at:
            _, ids, (at, last) = states[at][last]
            out.append(ids if isinstance(ids, tuple) else (ids,))
        return [i for ids in reversed(out) for i in ids]

    def _chunk(self, chunk: str) -> bytes:
        """Packed ids of a chunk, path by path between characters that no piece
        joins."""
        out, start = [], 0
        for i in range(1, len(chunk) + 1):
            if i == len(chunk) or chunk[i - 1:i + 1] not in self.joined:
                part = chunk[start:i]
                ids = self.chunks.get(part)
                if ids is None:
                    ids = array("H", (self._only_path if self.merges else self._shortest)(part)).tobytes()
                    if len(part) <= LONG:
                        self.chunks[part] = ids
                out.append(ids)
                start = i
        return b"".join(out)

    # -- texts

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, packed as 16-bit numbers."""
        if not text:
            return b""
        chunks = _CHUNK.findall(self.dummy + text.replace(" ", SPACE))
        if len(self.chunks) > CHUNKS:
            self.chunks = {}
        known, once = self.chunks, {}
        for chunk in set(chunks).difference(known):
            ids = self._chunk(chunk)
            (known if len(chunk) <= LONG else once)[chunk] = ids
        if once:
            return b"".join([once[c] if c in once else known[c] for c in chunks])
        return b"".join(map(known.__getitem__, chunks))

    def decode(self, packed: bytes) -> str:
        data = b"".join(map(self.output.__getitem__, array("H", packed)))
        if self.dummy and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """The compiled model of this process."""
    return Transducer(path)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (packed 16-bit numbers) of every text."""

    def run(batches):
        fst = transducer(model)
        for batch in batches:
            ids = [fst.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    batch_limits(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(
        run, "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as packed 16-bit numbers) and
    text of every row of ids."""

    def run(batches):
        fst = transducer(model)
        for batch in batches:
            packed = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(p) // 2 for p in packed], pa.int64()),
                 pa.array([zlib.crc32(p) for p in packed], pa.int64()),
                 pa.array([fst.decode(p) for p in packed], pa.string())],
                ["doc_id", "n_tokens", "ids_crc32", "text"])

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_crc32 long, text string")
