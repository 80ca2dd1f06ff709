"""Prefix trie of conversations by union-find over sorted neighbours.

A node stands for a distinct sequence of first turns; its members are the
conversations that begin with it.  Conversations are cut into segments of
SEGMENT turns, so that no row grows with a conversation.  A segment's key are
the 128-bit hashes of its turns one after the other; what stands before it is
known by a hash (``a``, ``b``), and segments with the same past form a group.

1. Equal segments of a group become one class (counted before they move).  The
   classes are sorted over the cluster by (segment number, past, key), so that
   classes that share turns are neighbours, also across partitions.
2. Each block of neighbours has edges between them, as deep as the turns they
   share.  Taken in descending depth, an edge unites two components under a node
   at its depth: a new branching node, or the top of a component if that is as
   deep.  A node stands for its turns and those above it up to its parent.
3. Nodes that touch an end of their block may go on in the next one.  These are
   at most 2 * SEGMENT in a block (the path to its first and its last class), and
   the tops of its groups: the contracted forest.  They are merged by the hash of
   their turns, over blocks, partitions and segments; all others are final.

Sums over subtrees become sums over members: each node gives its part to its
smallest member, and a node's subtree holds what its members hold, less what its
own smallest member holds above it.  So the forest is built twice, first to
count members, then to add up those parts.

Defined results: rows with a null conversation id are left out; turns are ordered
by number (null first), then role, then text; null roles and texts are empty;
rows that repeat wholly are separate turns; further columns are ignored; a
conversation without turns is a member of the root only; an empty table has no
nodes.  A node's digest of the conversations that end at it is sequential by
definition: their ids are put in order and joined to pieces over the cluster, and
one task per node only reads the pieces, one after the other.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starwright.llm.common import Scratch, batch_limits, whole_text

SEGMENT = 16
_CHARS = 22  # a turn's hash: 128 bits in base 64
PIECE_BYTES = 1 << 16
# A block's rows: final; open (may go on in other blocks); full (its children are
# in the next segment); a group's top.
_FINAL, _OPEN, _FULL, _TOP = range(4)
_ROW = ("block long, state int, a long, b long, depth long, pa long, pb long, conv_id long, parent_conv_id long, "
        "n long, chars long, gain long, leaf long, children long")


# ---------------------------------------------------------------- turns

def numbered_turns(chats: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, part, place, turn, chars) of all turns, and per conversation
    and part of the sorted table (conv_id, part, shift, n_own): ``place +
    shift`` is a turn's place in its conversation.  A conversation is spread over
    as many parts as its size takes."""
    rows = chats.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("number"),
        whole_text("role").alias("role"), whole_text("text").alias("text"))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    placed = scratch.write(
        # Ranges need no more than the beginnings of texts.
        rows.repartitionByRange("conv_id", "number", F.substring("role", 1, 16), F.substring("text", 1, 64))
        .sortWithinPartitions("conv_id", "number", "role", "text")
        .select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"),
                F.substring(F.base64(F.unhex(digest)), 1, _CHARS).alias("turn"),
                F.length("text").cast("long").alias("chars")), "placed")
    parts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    own = Window.partitionBy("conv_id")  # a row per part
    before = F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return placed, parts.select("conv_id", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
                                F.sum("n").over(own).alias("n_own"), before.isNull().alias("is_first"))


def plain_turns(chats: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, turn, chars, n_turns) and conversations (conv_id,
    n_turns) as they are."""
    placed, parts = numbered_turns(chats, scratch)
    turns = placed.join(parts, ["conv_id", "part"]).select(
        "conv_id", (F.col("place") + F.col("shift")).alias("pos"), "turn", "chars", F.col("n_own").alias("n_turns"))
    return turns, scratch.write(parts.where("is_first").select("conv_id", F.col("n_own").alias("n_turns")), "convs")


def rebuilt_turns(chats: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The same for conversations that begin with turns of another one: the
    first h turns (crc32 of the id, modulo 6) of conversation ``id - id % 100``,
    then the own turns after the first h."""
    placed, parts = numbered_turns(chats, scratch)
    parts = scratch.write(parts, "parts")
    convs = parts.where("is_first").select(
        "conv_id", "n_own", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    bases = convs.where("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    lent = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = scratch.write(convs.join(bases, "base", "left").select(
        "conv_id", "base", "h", lent.alias("lent"),
        (lent + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns")), "convs")
    info = parts.join(convs.select("conv_id", "h", "lent", "n_turns"), "conv_id").select(
        "conv_id", "part", "shift", "h", "lent", "n_turns")
    pos = F.col("place") + F.col("shift")
    own = placed.join(info, ["conv_id", "part"]).where(pos >= F.col("h")).select(
        "conv_id", (pos - F.col("h") + F.col("lent")).alias("pos"), "turn", "chars", "n_turns")
    first = placed.where("conv_id % 100 = 0").join(parts.where("conv_id % 100 = 0"), ["conv_id", "part"]).where(pos < 5).select(
        F.col("conv_id").alias("base"), pos.alias("pos"), "turn", "chars")
    taken = convs.where("lent > 0").join(first, "base").where("pos < lent").select(
        "conv_id", "pos", "turn", "chars", "n_turns")
    return own.unionByName(taken), convs.select("conv_id", "n_turns")


# ---------------------------------------------------------------- segments

def _hashes(segment: Column, key: Column) -> tuple[Column, Column]:
    """What a segment, or its first turns, adds to the hash of a sequence."""
    own = F.concat(segment.cast("string"), F.lit(":"), key)
    return F.xxhash64(own), F.xxhash64(F.concat(F.lit("+"), own))


def _hash(segment: int, key: str) -> tuple[int, int]:
    """The same in Python."""
    own = f"{segment}:{key}".encode()
    return tuple(x - (1 << 64) if x >> 63 else x for x in (xxhash.xxh64_intdigest(own, 42), xxhash.xxh64_intdigest(b"+" + own, 42)))


def segments(turns: DataFrame) -> DataFrame:
    """(conv_id, segment, a, b, key, chars, last): the segments of all
    conversations, with the hash of all segments before them."""
    number = F.floor(F.col("pos") / SEGMENT).cast("long")
    rows = turns.groupBy("conv_id", number.alias("segment")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "turn", "chars"))).alias("t"), F.max("n_turns").alias("n_turns")).select(
        "conv_id", "segment", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("key"),
        F.transform("t", lambda x: x["chars"]).alias("chars"), "n_turns")
    last = ((F.col("segment") + 1) * SEGMENT >= F.col("n_turns")).alias("last")
    short = rows.where(F.col("n_turns") <= SEGMENT).select(
        "conv_id", "segment", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "key", "chars", last)
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    a, b = (F.coalesce(F.bit_xor(h).over(before), F.lit(0)) for h in _hashes(F.col("segment"), F.col("key")))
    long = rows.where(F.col("n_turns") > SEGMENT).select(
        "conv_id", "segment", a.alias("a"), b.alias("b"), "key", "chars", last)
    return short.unionByName(long)


# ---------------------------------------------------------------- forest of a block

def _shared(x: str, y: str) -> int:
    """Turns that two keys share from the start."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n // _CHARS
    k = 0
    while x[k:k + _CHARS] == y[k:k + _CHARS]:
        k += _CHARS
    return k // _CHARS


class _Forest:
    """Nodes over a block of sorted classes: the classes first, then those that
    edges make.  A node knows its depth, first class, last class and children."""

    def __init__(self, past: list[tuple], keys: list[str], sums: list[list[int]], least: list[int]):
        self.depth = [len(k) // _CHARS for k in keys]
        self.first, self.last = list(range(len(keys))), list(range(len(keys)))
        self.children: list[list[int]] = [[] for _ in keys]
        self.sums, self.least = sums, least
        self.up = list(range(len(keys)))  # union-find over classes
        self.top = list(range(len(keys)))  # node on top of a component
        edges = [(-_shared(keys[i - 1], keys[i]), i) for i in range(1, len(keys)) if past[i - 1] == past[i]]
        for depth, i in sorted(edges):
            self._unite(i - 1, i, -depth)

    def _find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def _unite(self, i: int, j: int, depth: int) -> None:
        i, j = self._find(i), self._find(j)
        x, y = self.top[i], self.top[j]
        if self.depth[x] == depth or self.depth[y] == depth:
            if self.depth[x] != depth:
                x, y = y, x
            self.children[x] += self.children[y] if self.depth[y] == depth else [y]
            top = x
        else:
            top = len(self.depth)
            self.depth.append(depth)
            self.first.append(self.first[x])
            self.last.append(self.last[x])
            self.children.append([x, y])
            self.sums.append(list(self.sums[x]))
            self.least.append(self.least[x])
            x = top
        self.first[x] = min(self.first[x], self.first[y])
        self.last[x] = max(self.last[x], self.last[y])
        self.sums[x] = [p + q for p, q in zip(self.sums[x], self.sums[y])]
        self.least[x] = min(self.least[x], self.least[y])
        self.up[j] = i
        self.top[i] = top

    def tops(self) -> list[int]:
        return [self.top[i] for i in range(len(self.up)) if self.up[i] == i]


def _block_rows(block: int, past: list[tuple], keys: list[str], chars: list[list[int]], sums: list[list[int]],
                least: list[int]) -> list[tuple]:
    """The rows (_ROW) of the nodes over a block; a node of several turns gives
    one row for each."""
    forest, out, end = _Forest(past, keys, sums, least), [], len(keys) - 1
    opened = lambda x: forest.first[x] == 0 or forest.last[x] == end
    below: dict[tuple, list[int]] = {}  # past -> nodes right below the top of its group
    for x in forest.tops():
        below.setdefault(past[forest.first[x]], []).extend(forest.children[x] if forest.depth[x] == 0 else [x])
    for (segment, a, b), nodes in below.items():
        final = sum(not opened(x) for x in nodes)
        out.append((block, _TOP, a, b, segment * SEGMENT, None, None, None, None, 0, 0, 0, 0, final))
        todo = [(x, 0, (a, b), None) for x in nodes]
        while todo:
            x, above, parent, parent_conv = todo.pop()
            key, own_chars, is_open = keys[forest.first[x]], chars[forest.first[x]], opened(x)
            depth, conv = forest.depth[x], forest.least[x]
            for d in range(above + 1, depth + 1):
                h = _hash(segment, key[:d * _CHARS])
                own = (a ^ h[0], b ^ h[1])
                n_children = int(not is_open) if d < depth else sum(not opened(c) for c in forest.children[x])
                state = _OPEN if is_open else _FULL if d == SEGMENT else _FINAL
                out.append((block, state, *own, segment * SEGMENT + d, *parent, conv, parent_conv, forest.sums[x][0],
                            own_chars[d - 1], *forest.sums[x][1:], n_children))
                parent, parent_conv = own, None if is_open else conv
            todo += [(c, depth, parent, parent_conv) for c in forest.children[x]]
    return out


def _forest_rows(classes: DataFrame) -> DataFrame:
    def run(batches):
        task, schema = TaskContext.get().partitionId() << 32, None
        for k, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            segment, a, b, key, chars, conv, n, gain, leaf = (c.to_pylist() for c in batch.columns)
            rows = _block_rows(task + k, list(zip(segment, a, b)), key, chars, [list(x) for x in zip(n, gain, leaf)], conv)
            types = [pa.int64()] * 14
            types[1] = pa.int32()
            names = [c.split()[0] for c in _ROW.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return classes.mapInArrow(run, _ROW)


def forest(segs: DataFrame, convs: DataFrame, parts: DataFrame | None, scratch: Scratch, name: str) -> DataFrame:
    """The nodes (a, b, depth, conv_id, parent_conv_id, n, chars, gain, leaf,
    children): ``gain`` and ``leaf`` add up what ``parts`` (conv_id, gain, leaf)
    gives to the members."""
    if parts is None:
        with_parts = lambda df: df.withColumns({"gain": F.lit(0).cast("long"), "leaf": F.lit(0).cast("long")})
    else:
        with_parts = lambda df: df.join(parts, "conv_id", "left").fillna(0, ["gain", "leaf"])
    past = ["segment", "a", "b", "key"]
    classes = with_parts(segs).groupBy(*past, "chars").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.sum("gain").alias("gain"), F.sum("leaf").alias("leaf"))
    rows = scratch.write(_forest_rows(
        classes.select(*past, "chars", "conv_id", "n", "gain", "leaf")
        .repartitionByRange(*past).sortWithinPartitions(*past)
        .select("segment", "a", "b", "key", "chars", "conv_id", "n", "gain", "leaf")), f"{name}-rows")
    none = F.lit(None).cast("long")
    root = with_parts(convs).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.sum("gain").alias("gain"),
                                 F.sum("leaf").alias("leaf")).where("n > 0")
    zero = lambda c: F.lit(0).cast("long").alias(c)
    root = root.select(F.lit(-1).cast("long").alias("block"), F.lit(_TOP).alias("state"), zero("a"), zero("b"), zero("depth"),
                       none.alias("pa"), none.alias("pb"), "conv_id", none.alias("parent_conv_id"), "n", zero("chars"),
                       "gain", "leaf", zero("children"))
    # Merging over blocks.  What is final in its block has been counted there.
    some = scratch.write(
        rows.where(F.col("state") != _FINAL).unionByName(root).groupBy("a", "b").agg(
            F.max("depth").alias("depth"), F.max("pa").alias("pa"), F.max("pb").alias("pb"),
            F.min("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"),
            *[F.sum(c).alias(c) for c in ("n", "gain", "leaf", "children")], F.max("chars").alias("chars"),
            F.bool_or(F.col("state") == _FULL).alias("counted")), f"{name}-merged")
    more = some.where("not counted and pa is not null").groupBy("pa", "pb").agg(F.count("*").alias("more")).select(
        F.col("pa").alias("a"), F.col("pb").alias("b"), "more")
    merged = some.join(more, ["a", "b"], "left").withColumn("children", F.col("children") + F.coalesce("more", F.lit(0)))
    names = some.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("found"))
    above = F.coalesce("parent_conv_id", "found").alias("parent_conv_id")
    columns = ["a", "b", "depth", "conv_id", above, "n", "chars", "gain", "leaf", "children"]
    merged = merged.join(names, ["pa", "pb"], "left").select(*columns)
    # A final node below one that is not: the parent is asked for once a block.
    final = rows.where(F.col("state") == _FINAL)
    known = final.where("parent_conv_id is not null").select(*[c if isinstance(c, str) else "parent_conv_id" for c in columns])
    asked = rows.where(F.col("state").isin(_OPEN, _FULL, _TOP)).select("block", F.col("a").alias("pa"), F.col("b").alias("pb"))
    asked = asked.distinct().join(names, ["pa", "pb"])
    below = final.where("parent_conv_id is null").join(asked, ["block", "pa", "pb"]).select(*columns)
    return known.unionByName(below).unionByName(merged)


# ---------------------------------------------------------------- digests of ends

def _pieces(ends: DataFrame) -> DataFrame:
    """Ids of sorted ends joined to pieces: a, b, first (smallest id), piece."""

    def run(batches):
        node, first, ids, size, out = None, None, [], 0, []

        def close():
            if ids:
                out.append((*node, first, ",".join(ids)))

        for batch in batches:
            for a, b, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != node or size > PIECE_BYTES:
                    close()
                    node, first, ids, size = (a, b), conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["a", "b", "first", "piece"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["a", "b", "first", "piece"])

    return ends.mapInArrow(run, "a long, b long, first long, piece string")


def _digests(pieces: DataFrame) -> DataFrame:
    """SHA-256 of each node's sorted pieces, read one by one."""

    def run(batches):
        node, sha, out = None, None, []
        for batch in batches:
            for a, b, _, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != node:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (a, b), hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["a", "b", "ends_sha256"])
                out.clear()
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, sha.hexdigest())], ["a", "b", "ends_sha256"])

    return pieces.mapInArrow(run, "a long, b long, ends_sha256 string")


def end_digests(segs: DataFrame, convs: DataFrame) -> DataFrame:
    """(a, b, ends_sha256): digest of the ids that end at a node."""
    ha, hb = _hashes(F.col("segment"), F.col("key"))
    ends = segs.where("last").select(F.col("a").bitwiseXOR(ha).alias("a"), F.col("b").bitwiseXOR(hb).alias("b"), "conv_id")
    none = convs.where("n_turns = 0").select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "conv_id")
    order = ["a", "b", "conv_id"]
    pieces = _pieces(ends.unionByName(none).repartitionByRange(*order).sortWithinPartitions(*order))
    return _digests(pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first"))


# ---------------------------------------------------------------- trie

def _gains(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("own", (F.col("n") - 1) * F.col("chars"))


def prefix_nodes(turns: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per node of the trie of turns (conv_id, pos, turn, chars, n_turns)
    of the conversations (conv_id, n_turns, a written table): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    batch_limits(turns.sparkSession)
    segs = scratch.write(segments(turns), "segments")
    scratch.drop("placed", "parts")
    nodes = _gains(forest(segs, convs, None, scratch, "first"))
    parts = scratch.write(nodes.groupBy("conv_id").agg(
        F.sum("own").alias("gain"), F.max((F.col("children") == 0).cast("long")).alias("leaf")), "parts-of-members")
    scratch.drop("first-rows", "first-merged")
    nodes = _gains(forest(segs, convs, parts, scratch, "second")).withColumn("chunk", F.floor(F.col("depth") / SEGMENT))
    # What the smallest member of a node holds above it: within a chunk of its
    # path, and in the chunks before.
    chunks = nodes.groupBy("conv_id", "chunk").agg(F.sum("own").alias("sum"))
    until = F.sum("sum").over(Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.select("conv_id", "chunk", F.coalesce(until, F.lit(0)).alias("until"))
    near = F.sum("own").over(Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    nodes = nodes.withColumn("near", F.coalesce(near, F.lit(0))).join(chunks, ["conv_id", "chunk"])
    out = nodes.join(end_digests(segs, convs), ["a", "b"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaf").alias("n_leaves"), (F.col("gain") - F.col("near") - F.col("until")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def conversation_trie(chats: DataFrame, rebuild: bool = False) -> DataFrame:
    """The nodes of the trie of ``chats`` (conv_id, turn, role, text), as they
    are or with the beginnings that ``rebuilt_turns`` gives them."""
    scratch = Scratch(chats.sparkSession, "conversation-trie")
    turns, convs = (rebuilt_turns if rebuild else plain_turns)(chats, scratch)
    return prefix_nodes(turns, convs, scratch)
