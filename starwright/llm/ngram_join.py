"""N-gram Jaccard join with prefix trees, and the groups it links.

Two texts link when the Jaccard likeness of their sets of word n-grams is at
least NUMERATOR / DENOMINATOR.  Texts with equal sets are one class from the
start; only classes are joined.

1. *Order.*  All n-grams get one global order, rare ones first, by the exact
   number of classes that have them.  N-grams meet once, packed into blobs of a
   few bytes each, and only those that two classes share come back to their
   class; n-grams of one class are the first of its order and need no further
   work.  N-grams in cells (a table of fixed size over the whole corpus) with
   very many documents are not counted: they are the last ones of the order.
2. *Prefixes.*  Sets of likeness t share an n-gram within their first
   n - ceil(t n) + 1 ones.  A class that shares no n-gram there is out.
3. *Prefix trees.*  Classes with the same n-gram in their prefix form a group,
   and what follows it in their order a trie.  A class walks down the trie: sets
   that go on alike share their partial overlap, and a subtree is left as soon
   as the lengths that remain cannot reach the overlap needed, or if it holds
   nothing but the class's own component.  What is found must also pass by
   parity: as many n-grams at least are in one set only as there are bits in
   which the parities of the sets, hashed to PARITY bits, differ.
4. *Two turns.*  Classes linked over any path need no further comparison.  In
   the first turn each class takes one partner in all, the one that most of its
   groups name, so there are no more pairs than classes, whatever the sizes of
   the groups.  In the second turn the classes outside the largest component of their group
   walk the tries again and take all partners in other components.  Groups of
   any size take the same way; they are dealt out in blocks of GROUP_BLOCK.
5. *Check.*  Pairs are checked on the whole sets: those to be compared with one
   class form tries as well, in blocks of BLOCK.

Defined results: null and wordless texts have an empty set and are linked with
nothing; texts of fewer than N words have one n-gram, the whole sequence; rows
with a null id are left out; rows that repeat are separate rows of one class;
further columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import math
from collections import Counter
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starwright.llm.common import Scratch, batch_limits, shuffle_partitions, unused, whole_text
from starwright.llm.components import components

N, NUMERATOR, DENOMINATOR = 5, 80, 100
CELL_BITS = 20
LEADERS, BLOCK, GROUP_BLOCK = 4, 256, 4096
HOT = 50_000  # documents of a cell from which on its n-grams are not counted
BUCKET = 1 << 22  # n-grams counted at a time, about
PARITY = 1024
REST = 8  # n-grams that follow one in a record; what lies beyond counts as possibly shared
_LOW = np.uint64((1 << 48) - 1)
_MOST = (1 << 15) - 1  # largest count that the order tells apart
_CHUNK = 1 << 16  # cells in one record while they are summed


def needed(a: int, b: int) -> int:
    """Least overlap of sets of these sizes that are alike enough."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1 if n else 0


# ---------------------------------------------------------------- sets

_BUFFER, _LONG_WORD = 1 << 20, 256
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the n-grams of texts.

    Words are hashed together, by a polynomial over the bytes of a buffer of
    texts; words over _LONG_WORD bytes are hashed one by one, wherever they
    stand, and texts longer than the buffer are cut between words."""

    def __init__(self, n: int = N):
        self.n = n
        powers = np.full(_BUFFER, _BASE, np.uint64)
        inverse = np.full(_BUFFER, pow(_BASE, -1, 1 << 64), np.uint64)
        powers[0] = inverse[0] = 1
        self.powers, self.inverse = np.multiply.accumulate(powers), np.multiply.accumulate(inverse)

    def _words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of each word of at most _BUFFER bytes."""
        low = _LOWER[np.frombuffer(data, np.uint8)]
        word = np.concatenate(([False], ~_SPACE[low], [False]))
        edges = np.flatnonzero(word[1:] != word[:-1])
        start, stop = edges[::2], edges[1::2]
        sums = np.zeros(len(low) + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * self.powers[:len(low)], out=sums[1:])
        h = _mixed((sums[stop] - sums[start]) * self.inverse[start] + (stop - start).astype(np.uint64))
        for i in np.flatnonzero(stop - start > _LONG_WORD):
            h[i] = xxhash.xxh3_64_intdigest(low[start[i]:stop[i]].tobytes())
        return h, start

    def _long(self, data: bytes) -> np.ndarray:
        """Word hashes of a text of any length."""
        out, at = [], 0
        while at < len(data):
            end = min(at + _BUFFER, len(data))
            if end < len(data):  # back to the last white space
                cut = np.flatnonzero(_SPACE[np.frombuffer(data, np.uint8, end - at, at)])
                if cut.size:
                    end = at + int(cut[-1]) + 1
                else:  # one word fills the buffer
                    rest = np.frombuffer(data, np.uint8, len(data) - end, end)
                    more = np.flatnonzero(_SPACE[rest])
                    end += int(more[0]) if more.size else len(rest)
                    word = _LOWER[np.frombuffer(data, np.uint8, end - at, at)].tobytes()
                    out.append(np.array([xxhash.xxh3_64_intdigest(word)], np.uint64))
                    at = end
                    continue
            out.append(self._words(data[at:end])[0])
            at = end
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def _grams(self, h: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all runs of ``width`` words."""
        out = np.full(max(len(h) - width + 1, 0), width, np.uint64)
        for k in range(width if len(out) else 0):
            out = out * np.uint64(_BASE) + h[k:len(h) - width + 1 + k]
            out ^= out >> np.uint64(29)
        return _mixed(out)

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The set of each text."""
        out: list[np.ndarray] = []
        held: list[bytes] = []
        size = 0

        def flush():
            if not held:
                return
            h, start = self._words(b" ".join(held))
            grams = self._grams(h, self.n)
            ends = np.cumsum([len(d) + 1 for d in held])
            cuts = np.searchsorted(start, np.concatenate(([0], ends)))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a >= self.n:
                    out.append(np.unique(grams[a:b - self.n + 1]))
                else:
                    out.append(self._grams(h[a:b], b - a) if b > a else h[:0])
            held.clear()

        for text in texts:
            data = (text or "").encode()
            if size + len(data) + 1 > _BUFFER:
                flush()
                size = 0
            if len(data) >= _BUFFER:
                h = self._long(data)
                out.append(np.unique(self._grams(h, min(self.n, len(h)))) if len(h) else h)
                continue
            held.append(data)
            size += len(data) + 1
        flush()
        return out


@functools.lru_cache(maxsize=1)
def shingler() -> Shingler:
    """The shingler of this process."""
    return Shingler()


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def first_pass(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """From one pass over all texts: doc_id, n and set_key of every document
    (equal sets have equal keys), and how many documents have n-grams of each
    cell (a table of fixed size, summed by Spark)."""
    size = 1 << CELL_BITS

    def run(batches):
        cells = np.zeros(size, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("set_key", pa.int64()), ("chunk", pa.int32()),
                            ("counts", pa.binary())])
        for batch in batches:
            sets = shingler().sets(batch.column(1).to_pylist())
            if sets:
                cells += np.bincount(_cell(np.concatenate(sets)), minlength=size)
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([_set_key(s) for s in sets], pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())],
                schema=schema)
        none = pa.nulls(size // _CHUNK)
        yield pa.RecordBatch.from_arrays(
            [none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), pa.array(range(size // _CHUNK), pa.int32()),
             pa.array([c.astype("<u4").tobytes() for c in cells.reshape(-1, _CHUNK)])], schema=schema)

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(counts, "<u4").astype("<i8")
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in sums.values()], pa.binary())],
            ["chunk", "counts"])

    both = scratch.write(docs.mapInArrow(run, "doc_id long, n int, set_key long, chunk int, counts binary"), "members")
    rows = both.where("chunk is not null").select("chunk", "counts").repartition(size // _CHUNK, "chunk").mapInArrow(
        total, "chunk int, counts binary").collect()
    cells = np.zeros(size, np.int64)
    for chunk, counts in rows:
        cells[chunk * _CHUNK:(chunk + 1) * _CHUNK] = np.frombuffer(counts, "<i8")
    return both.where("chunk is null").select("doc_id", "n", "set_key"), cells


def _ordered(hashes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return hashes[np.lexsort((hashes, cells[_cell(hashes)]))]


def _set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


# ---------------------------------------------------------------- the global order
#
# In the global order an n-gram is one number: its count in the upper 15 bits,
# 48 bits of its hash below.  Hashes that coincide in two sets only weaken the
# filters; two of one set coincide with a chance of 2^-48.

BLOBS = "bucket int, hot boolean, keys binary, counts binary, grams binary"
_BLOBS = pa.schema([("bucket", pa.int32()), ("hot", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary()),
                    ("grams", pa.binary())])


def _blobs(bucket: np.ndarray, key: np.ndarray, gram: np.ndarray, width: int, hot: bool = False) -> pa.RecordBatch:
    """One row per bucket: its keys, how many n-grams each has, and the n-grams
    in ``width`` bytes.  Equal keys of a bucket stand next to each other."""
    order = np.argsort(bucket, kind="stable")
    bucket, key, gram = bucket[order], key[order], gram[order]
    packed = gram.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)])) if len(bucket) else [0]
    rows = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        own = key[lo:hi]
        first = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
        counts = np.diff(np.append(first, hi - lo)).astype("<u4")
        rows.append((int(bucket[lo]), hot, own[first].astype("<i8").tobytes(), counts.tobytes(), packed[lo:hi].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BLOBS.types)] if rows else
                                      [pa.array([], t) for t in _BLOBS.types], schema=_BLOBS)


def _unpacked(keys: bytes, counts: bytes, grams: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and n-grams of a blob, one of each per n-gram."""
    full = np.zeros((len(grams) // width, 8), np.uint8)
    full[:, :width] = np.frombuffer(grams, np.uint8).reshape(-1, width)
    return np.repeat(np.frombuffer(keys, "<i8"), np.frombuffer(counts, "<u4")), full.view("<u8").ravel()


def all_grams(docs: DataFrame, shared, buckets: int, hot: int) -> DataFrame:
    """Blobs of all n-grams of the documents.  Those of cells with over ``hot``
    documents go by their class and are marked, others by their hash."""

    def run(batches):
        cells = shared.value
        for batch in batches:
            # Copies in one batch are sent once.
            sent = {_set_key(s): s for s in shingler().sets(batch.column(1).to_pylist()) if len(s)}
            if not sent:
                continue
            gram = np.concatenate(list(sent.values()))
            key = np.repeat(np.array(list(sent), np.int64), [len(s) for s in sent.values()])
            many = cells[_cell(gram)] > hot
            bucket = np.where(many, key % buckets, ((gram >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64))
            for is_hot in (False, True):
                own = many == is_hot
                if own.any():
                    yield _blobs(bucket[own], key[own], gram[own] & _LOW, 6, is_hot)

    return docs.select("doc_id", "text").mapInArrow(run, BLOBS)


def shared_grams(blobs: DataFrame, buckets: int) -> DataFrame:
    """Blobs, by class, of the n-grams that more than one class has, as numbers
    of the global order.  One bucket is counted at a time."""

    def ranked(held):
        key, gram = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(gram)
        gram = gram[order]
        same = gram[1:] == gram[:-1]
        some = np.concatenate((same, [False])) | np.concatenate(([False], same))
        key, gram = key[order][some], gram[some]
        order = np.lexsort((key, gram))  # copies of a class count once
        key, gram = key[order], gram[order]
        new = np.concatenate(([True], gram[1:] != gram[:-1])) if len(gram) else np.empty(0, bool)
        once = new.copy()
        once[1:] |= key[1:] != key[:-1]
        key, gram, new = key[once], gram[once], new[once]
        group = np.cumsum(new) - 1
        count = np.bincount(group)[group] if len(group) else group
        key, gram, count = (x[count > 1] for x in (key, gram, count))
        return key, gram | (np.minimum(count, _MOST - 1).astype(np.uint64) << np.uint64(48))

    def by_class(key, gram):
        order = np.argsort(key, kind="stable")
        return _blobs(key[order] % buckets, key[order], gram[order], 8)

    def run(batches):
        at, held = None, []
        for batch in batches:
            for bucket, hot, *blob in zip(*(c.to_pylist() for c in batch.columns)):
                if hot:
                    key, gram = _unpacked(*blob, 6)
                    yield by_class(key, gram | np.uint64(_MOST << 48))
                    continue
                if bucket != at and held:
                    yield by_class(*ranked(held))
                    held = []
                at = bucket
                held.append(_unpacked(*blob, 6))
        if held:
            yield by_class(*ranked(held))

    return blobs.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, BLOBS)


RECORDS = "token long, set_key long, n int, pos int, alone int, parity binary, rest binary"


def prefix_records(grams: DataFrame, members: DataFrame, buckets: int) -> DataFrame:
    """RECORDS: the shared n-grams in the prefixes of all classes that may link:
    the place in the class's order, how many n-grams only the class has, the
    parities of the others, and up to REST n-grams that follow."""
    sizes = members.where("n > 0").select(
        F.pmod("set_key", F.lit(buckets)).cast("int").alias("bucket"), F.lit(True).alias("hot"), "set_key", "n").distinct()
    rows = grams.select("bucket", F.lit(False).alias("hot"), F.lit(None).cast("long").alias("set_key"),
                        F.lit(None).cast("int").alias("n"), "keys", "counts", "grams").unionByName(
        sizes, allowMissingColumns=True)

    def of_bucket(sizes, held):
        if not sizes or not held:
            return
        key, gram = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((gram, key))
        key, gram = key[order], gram[order]
        # N-grams that several copies sent stand next to each other.
        once = np.concatenate(([True], (key[1:] != key[:-1]) | (gram[1:] != gram[:-1])))
        key, gram = key[once], gram[once]
        cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        out = []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            k = int(key[lo])
            n = sizes[k]
            alone = n - (hi - lo)
            inside = min(prefix_length(n) - alone, hi - lo)
            if inside <= 0:
                continue
            own = gram[lo:hi]
            packed = own.astype("<u8").tobytes()
            odd = np.bincount((own % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) % 2
            parity = np.packbits(odd.astype(np.uint8)).tobytes()
            out += [(int(own[i]), k, n, alone + i, alone, parity, packed[8 * i + 8:8 * min(i + 1 + REST, hi - lo)]) for i in range(inside)]
            if len(out) > 20_000:
                yield _records(out)
                out = []
        if out:
            yield _records(out)

    def run(batches):
        at, sizes, held = None, {}, []
        for batch in batches:
            for bucket, is_size, set_key, n, *blob in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at:
                    yield from of_bucket(sizes, held)
                    at, sizes, held = bucket, {}, []
                if is_size:
                    sizes[set_key] = n
                else:
                    held.append(_unpacked(*blob, 8))
        yield from of_bucket(sizes, held)

    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, RECORDS)


def _records(rows: list) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      ["token", "set_key", "n", "pos", "alone", "parity", "rest"])


# ---------------------------------------------------------------- candidates

class Beginnings:
    """Prefix tree of what follows an n-gram in the order of its classes."""

    __slots__ = ("edge", "children", "ends", "least", "most", "only")

    def __init__(self, edge: tuple):
        self.edge, self.children, self.ends = edge, {}, []
        self.least, self.most, self.only = 1 << 62, 0, None

    def _holds(self, n: int, left: int, component: int, first: bool) -> None:
        self.least, self.most = min(self.least, n), max(self.most, left)
        self.only = component if first or self.only == component else None

    def add(self, key: int, n: int, left: int, component: int, alone: int, parity: int, rest: tuple) -> None:
        """A class with ``left`` n-grams after this one, which begin with
        ``rest``; ``alone`` n-grams are in no other set, ``parity`` is of the rest."""
        node, at, end = self, 0, (key, n, left, component, alone, parity)
        while True:
            node._holds(n, left, component, not node.ends and not node.children)
            if at == len(rest):
                node.ends.append(end)
                return
            child = node.children.get(rest[at])
            if child is None:
                child = node.children[rest[at]] = Beginnings(rest[at:])
                at = len(rest)
            else:
                same = next((i for i, (x, y) in enumerate(zip(child.edge, rest[at:])) if x != y),
                            min(len(child.edge), len(rest) - at))
                if same < len(child.edge):  # branch inside the edge
                    upper = Beginnings(child.edge[:same])
                    upper.least, upper.most, upper.only = child.least, child.most, child.only
                    child.edge = child.edge[same:]
                    upper.children[child.edge[0]] = child
                    node.children[rest[at]] = child = upper
                at += same
            node = child

    def partners(self, n: int, left: int, component: int, alone: int, parity: int, rest: tuple):
        """Keys of classes in other components whose overlap may suffice."""
        known, last = set(rest), rest[-1] if len(rest) < left and rest else 1 << 64
        if not rest and left:
            last = -1
        # Overlap so far, n-grams of the tree's class and of this one gone by.
        stack = [(self, 1, 0, 0)]
        while stack:
            node, overlap, theirs, own = stack.pop()
            for x in node.edge:
                if x > last:
                    break  # may be shared: beyond what is known of this class
                theirs += 1
                overlap += x in known
            if node.edge:
                own = bisect.bisect_right(rest, node.edge[-1])
            if node.only == component or overlap + min(node.most - theirs, left - own) < needed(n, node.least):
                continue
            for key, size, more, of, single, odd in node.ends:
                if of == component:
                    continue
                need = needed(n, size)
                if overlap + min(more - theirs, left - own) >= need and (
                        alone + single + (parity ^ odd).bit_count() <= n + size - 2 * need):
                    yield key
            stack += [(child, overlap, theirs, own) for child in reversed(node.children.values())]


def find(rows: DataFrame, every: bool) -> DataFrame:
    """Pairs (a: a class that walks, b) of one block of a group that may link,
    and in how many blocks they were found.  With ``every`` all classes walk and
    take their first partner, else those that walk take all.  A block's own
    classes come before those that walk over it."""

    def run(batches):
        at, own, walkers, found = None, [], [], Counter()

        def unpacked(alone, parity, rest):
            return alone, int.from_bytes(parity), tuple(np.frombuffer(rest, "<u8").tolist())

        def block():
            if len(own) < 2 and not walkers or (not every and not walkers):
                return
            index = any(pos < n - needed(n, n) + 1 for _, n, pos, *_ in own + walkers)
            if not index:  # the smaller class of a link has the n-gram this early
                return
            tree = Beginnings(())
            for key, n, pos, component, *more in own:
                tree.add(key, n, n - pos - 1, component, *unpacked(*more))
            for key, n, pos, component, *more in own if every else walkers:
                for other in tree.partners(n, n - pos - 1, component, *unpacked(*more)):
                    found[key, other] += 1
                    if every:
                        break

        def out():
            rows = [(*pair, votes) for pair, votes in found.items()]
            found.clear()
            columns = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "votes"])

        for batch in batches:
            for token, part, walks, *record in zip(*(c.to_pylist() for c in batch.columns)):
                if (token, part) != at:
                    block()
                    at, own, walkers = (token, part), [], []
                (walkers if walks else own).append(record)
                if len(walkers) == GROUP_BLOCK:  # the tree is built again for the next ones
                    block()
                    walkers = []
            if len(found) > 50_000:
                yield out()
        block()
        yield out()

    n = shuffle_partitions(rows.sparkSession)
    return rows.select("token", "block", "walks", "set_key", "n", "pos", "component", "alone", "parity", "rest").repartition(
        n, "token", "block").sortWithinPartitions("token", "block", "walks", "set_key").mapInArrow(
        run, "a long, b long, votes long").groupBy("a", "b").agg(F.sum("votes").alias("votes"))


def first_turn(records: DataFrame, blocks: DataFrame) -> DataFrame:
    """(a: partner, b: class): one partner per class, the one found most often.
    In groups of several blocks LEADERS classes of the group are in all blocks,
    so that blocks are linked."""
    record = ["set_key", "n", "pos", "alone", "parity", "rest"]
    dealt = records.join(blocks, "token", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = dealt.withColumn("block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
    first = [F.min(F.struct(F.xxhash64("set_key", F.lit(i)), *record)) for i in range(LEADERS)]
    leaders = records.join(blocks, "token").groupBy("token", "blocks").agg(F.array(*first).alias("first"))
    spread = leaders.select("token", "blocks", F.explode("first").alias("of")).select(
        "token", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        *(F.col(f"of.{c}").alias(c) for c in record))
    columns = ["token", "block", *record]
    rows = own.select(*columns).unionByName(spread.select(*columns)).dropDuplicates(["token", "block", "set_key"])
    found = find(rows.withColumns({"walks": F.lit(False), "component": F.col("set_key")}), True)
    return found.groupBy(F.col("a").alias("b")).agg(F.max(F.struct("votes", "b"))["b"].alias("a")).select("a", "b")


def second_turn(records: DataFrame, blocks: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """All partners (a < b) in other components of the classes outside the largest
    component of their group.  Groups that lie in one component are done."""
    placed = scratch.write(records.join(groups, records["set_key"] == groups["node"], "left").select(
        *records.columns, F.coalesce("component", "set_key").alias("component")), "placed")
    sizes = placed.groupBy("token", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("n", "component"))["component"].alias("largest"),
                                         F.count("*").alias("components")).where("components > 1").drop("components")
    dealt = placed.join(largest, "token").join(blocks, "token", "left").withColumn(
        "blocks", F.coalesce("blocks", F.lit(1)))
    own = dealt.withColumns({"block": F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"), "walks": F.lit(False)})
    walking = dealt.where("component <> largest").withColumns({
        "block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "walks": F.lit(True)})
    return find(own.unionByName(walking), False).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# ---------------------------------------------------------------- prefix trees

class Trie:
    """Prefix tree of ordered sets; chains without a branch are one edge."""

    __slots__ = ("edge", "children", "ends", "least", "most")

    def __init__(self, edge: np.ndarray):
        self.edge, self.children, self.ends = edge, {}, []
        self.least, self.most = 1 << 62, 0

    def add(self, ordered: np.ndarray, name) -> None:
        node, at, n = self, 0, len(ordered)
        while True:
            node.least, node.most = min(node.least, n), max(node.most, n)
            if at == n:
                node.ends.append((name, n))
                return
            first = int(ordered[at])
            child = node.children.get(first)
            if child is None:
                child = node.children[first] = Trie(ordered[at:])
                child.ends.append((name, n))
                child.least = child.most = n
                return
            m = min(len(child.edge), n - at)
            differ = np.flatnonzero(child.edge[:m] != ordered[at:at + m])
            same = int(differ[0]) if differ.size else m
            if same < len(child.edge):  # branch inside the edge
                upper = Trie(child.edge[:same])
                upper.least, upper.most = child.least, child.most
                child.edge = child.edge[same:]
                upper.children[int(child.edge[0])] = child
                node.children[first] = child = upper
            node, at = child, at + same

    def similar(self, probe: np.ndarray) -> list:
        """Names of the sets that link with the probe (sorted hashes)."""
        out, n = [], len(probe)
        stack = [(self, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            if len(node.edge):
                spot = np.minimum(np.searchsorted(probe, node.edge), n - 1)
                overlap += int(np.count_nonzero(probe[spot] == node.edge))
                depth += len(node.edge)
            if overlap + min(node.most - depth, n - overlap) < needed(n, node.least):
                continue
            out += [name for name, size in node.ends if overlap >= needed(n, size)]
            stack += [(child, overlap, depth) for child in node.children.values()]
        return out


def compare(candidates: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidates (a, b) that link.  The sets b of one a form tries of at
    most BLOCK sets; a very frequent a has several blocks, in several tasks."""
    blocks = candidates.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = candidates.join(blocks, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.col("b").alias("set_key"))
    heads = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                          F.col("a").alias("set_key"))
    rows = members.unionByName(heads).join(sets, "set_key").select(
        "a", "block", (F.col("a") != F.col("set_key")).alias("member"), "set_key", "hashes")

    def run(batches):
        key, probe, trie, held = None, None, None, 0
        for batch in batches:
            out = []
            for a, block, member, b, packed in zip(*(c.to_pylist() for c in batch.columns)):
                hashes = np.frombuffer(packed, "<u8")
                if (a, block) != key or held == BLOCK:
                    if held:
                        out += [(key[0], x) for x in trie.similar(probe)]
                    trie, held = Trie(hashes[:0]), 0
                if (a, block) != key:
                    key, probe = (a, block), np.sort(hashes)  # the head's row comes first
                if member:
                    trie.add(hashes, b)
                    held += 1
            yield _links(out)
        if held:
            yield _links([(key[0], x) for x in trie.similar(probe)])

    n = shuffle_partitions(candidates.sparkSession)
    return rows.repartition(n, "a", "block").sortWithinPartitions("a", "block", "member").mapInArrow(
        run, "a long, b long")


def _links(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int64()),
                                       pa.array([b for _, b in rows], pa.int64())], ["a", "b"])


def ordered_sets(docs: DataFrame, wanted: DataFrame, shared) -> DataFrame:
    """set_key and hashes, rare cells first, of the wanted documents."""

    def run(batches):
        cells = shared.value
        for batch in batches:
            sets = shingler().sets(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([_set_key(s) for s in sets], pa.int64()),
                 pa.array([_ordered(s, cells).tobytes() for s in sets], pa.binary())], ["set_key", "hashes"])

    return docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(
        run, "set_key long, hashes binary")


# ---------------------------------------------------------------- the join

def linked_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id
    reachable over links, itself included)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    batch_limits(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).where(
        F.col("doc_id").isNotNull())
    members, cells = first_pass(docs, scratch)
    shared = spark.sparkContext.broadcast(cells)  # of fixed size
    total = members.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    hot = max(HOT, 2 * math.ceil(total / (1 << CELL_BITS)))
    buckets = max(shuffle_partitions(spark), math.ceil(total / BUCKET))
    grams = shared_grams(all_grams(docs, shared, buckets, hot), buckets)
    records = scratch.write(prefix_records(grams, members, buckets), "records")
    blocks = records.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_BLOCK).select(
        "token", F.ceil(F.col("n") / GROUP_BLOCK).cast("int").alias("blocks"))
    blocks = scratch.write(blocks, "blocks")

    # A class is named by its set and stands for its document of smallest id.
    classes = members.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"))

    def whole_sets(pairs, name):
        involved = pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct()
        wanted = scratch.write(classes.join(involved, "set_key", "left_semi").select("doc_id"), f"wanted-{name}")
        return scratch.write(ordered_sets(docs, wanted, shared).dropDuplicates(["set_key"]), f"sets-{name}")

    first = scratch.write(first_turn(records, blocks), "first")
    links = scratch.write(compare(first, whole_sets(first, "first")), "links")
    groups = scratch.write(components(links), "groups")
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = scratch.write(second_turn(records, blocks, groups, scratch).join(done, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        groups = components(stars.unionByName(compare(rest, whole_sets(rest, "rest"))))

    # The smallest document of each component, then back to every document.
    of = classes.join(groups, classes["set_key"] == groups["node"], "left").select(
        "set_key", "doc_id", F.coalesce("component", "set_key").alias("component"))
    of = scratch.write(of, "of")
    lowest = of.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = of.join(lowest, "component").select("set_key", "component_id")
    out = scratch.write(
        members.join(named, "set_key", "left").select(
            "doc_id", F.col("n").cast("long").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), "out")
    scratch.drop("members", "records", "blocks", "first", "links", "groups", "placed", "rest", "of", "wanted-first",
                 "sets-first", "wanted-rest", "sets-rest")
    return out


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the documents linked, over any path, with
    one of smaller id; columns as they are."""
    groups = linked_groups(docs, id_col, text_col)
    copies = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(unused("copy", docs))).distinct()
    return docs.join(copies, docs[id_col].cast("long") == copies[0], "left_anti")
