"""The prefix trie of conversations, from a global sort.

Conversations become arrays of turn digests, joined to one sortable key, and are range-sorted over all partitions, so the
members of every trie node are neighbours. A partition is read as a stream: the longest common prefix of adjacent keys
says which open nodes end, and a stack holds those that are open. Nodes on the path of a partition's first or last
conversation may go on beyond it; their partial figures, one row for each depth, are stitched by a second sweep of the
same kind over the partitions' borders. Equal conversations are sorted by id, so any number of them may be split between
partitions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import broadcast_if_small, cut, small_batches

#: Hexadecimal characters of a turn's digest: 128 bits.
WIDTH = 32
#: Ids in one string of a node's ends.
ENDS = 4096

NODE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint,"
    " saved_tokens bigint, ends_sha256 string"
)
#: Swept rows. kind: 0 a node, 1 a node below a border node (part, side, up), 2 a border node's part (its turn, its
#: length, what this partition has of it), 3 a piece of its ends, 4 the conv_id of the border node (part, side, up).
SWEPT = f"kind int, part int, side int, up bigint, place bigint, {NODE}, turn string, length bigint, ends string"
CLOSED, BELOW, BORDER, PIECE, KNOWN = range(5)
TYPES = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
FIELDS = [tuple(f.split()) for f in SWEPT.split(", ")]


def turn_keys(turns: DataFrame) -> DataFrame:
    """(conv_id, keys, lengths): a digest of each turn's role and text, and the text's code points, in order.

    Nulls in role and text are empty; ties in turn go to the smaller digest. Rows without a conv_id are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    own = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.substring(F.sha2(said, 256), 1, WIDTH).alias("key"),
        F.char_length(text).cast("bigint").alias("length")
    )
    whole = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "length"))).alias("t"))
    return whole.select("conv_id", F.col("t.key").alias("keys"), F.col("t.length").alias("lengths"))


def rebuilt(convs: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Each conversation after the first turns of its block's first one, as (conv_id, keys, lengths).

    h = crc32(id) % most turns come from conversation id - id % block (all it has if fewer, none if it is absent); its own
    turns follow after its first h.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(block))
    first = convs.where(F.pmod("conv_id", F.lit(block)) == 0).select(
        F.col("conv_id").alias("base"), F.slice("keys", 1, most).alias("base_keys"),
        F.slice("lengths", 1, most).alias("base_lengths")
    )
    both = convs.withColumns({"base": base, "h": h}).join(broadcast_if_small(cut(first), 20_000), "base", "left")

    def spliced(own: str, head: str):
        return F.concat(
            F.when(F.col(head).isNull(), F.slice(own, 1, 0)).otherwise(F.slice(head, F.lit(1), F.col("h"))),
            F.slice(F.col(own), F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0)))
        )

    return both.select("conv_id", spliced("keys", "base_keys").alias("keys"), spliced("lengths", "base_lengths").alias("lengths"))


class _Node:
    """An open node: what it has of closed children and of conversations that end in it."""

    __slots__ = ("turn", "length", "least", "n", "children", "leaves", "saved", "ends", "below")

    def __init__(self, turn: str, length: int):
        self.turn, self.length, self.least = turn, length, None
        self.n = self.children = self.leaves = self.saved = 0
        self.ends: list[int] = []
        self.below: list[list] = []

    def add(self, least: int | None, n: int, children: int, leaves: int, saved: int) -> None:
        if least is not None and (self.least is None or least < self.least):
            self.least = least
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved

    def closed(self, depth: int, digest: str) -> list:
        """Its row, but for the parent, after all below it."""
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.length
        return [self.least, depth, None, self.n, self.children, self.leaves, self.saved, digest]


def common(a: str, b: str) -> int:
    """The turns that two keys begin with in common."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    low, high = 0, n  # equal up to low, not up to high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid
    return low


class Sweep:
    """One partition's conversations in order, as swept rows in ``out``.

    ``stack`` has the open nodes, the root at 0. Those up to ``border`` are on the path of the partition's first
    conversation, so the partition before may have begun them; those open at the end may go on in the next.
    """

    def __init__(self, part: int):
        self.part, self.out = part, []
        self.stack: list[_Node] = []
        self.key, self.border = "", 0

    def add(self, conv: int, key: str, lengths: list[int]) -> None:
        n = len(key) // WIDTH
        if self.stack:
            at = common(self.key, key)
            self._pop(at)
        else:
            at, self.border = 0, n
            self.stack.append(_Node("", 0))
        for k in range(at, n):
            self.stack.append(_Node(key[k * WIDTH : (k + 1) * WIDTH], lengths[k]))
        self.key = key
        self.stack[-1].ends.append(conv)
        self.stack[-1].add(conv, 1, 0, 0, 0)

    def _row(self, kind: int, side: int | None, up: int | None, place: int | None, node: list | None, rest: list) -> None:
        self.out.append([kind, self.part, side, up, place, *(node or [None] * 8), *(rest or [None] * 3)])

    def _pop(self, depth: int) -> None:
        """Close the open nodes deeper than ``depth``."""
        while len(self.stack) - 1 > depth:
            at = len(self.stack) - 1
            if at <= self.border:
                self._keep(self.stack.pop(), 0, at)
                self.border = at - 1
                continue
            node = self.stack.pop()
            row = node.closed(at, hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest())
            for r in node.below:
                r[2] = node.least
                self._row(CLOSED, None, None, None, r, [])
            parent = self.stack[-1]
            parent.add(node.least, node.n, 1, node.leaves, node.saved)
            if at - 1 <= self.border:
                self._row(BELOW, 0, at - 1, None, row, [])
            else:
                parent.below.append(row)

    def _keep(self, node: _Node, side: int, depth: int) -> None:
        """A node of the border, as far as this partition knows it."""
        for r in node.below:
            self._row(BELOW, side, depth, None, r, [])
        known = [node.least, depth, None, node.n, node.children, node.leaves, node.saved, None]
        self._row(BORDER, side, depth, 0, known, [node.turn, node.length, None])
        for k in range(0, len(node.ends), ENDS):
            self._row(PIECE, side, depth, k, None, [None, None, ",".join(map(str, node.ends[k : k + ENDS]))])

    def end(self) -> None:
        while self.stack:
            at = len(self.stack) - 1
            self._keep(self.stack.pop(), int(at > self.border), at)


class Stitch:
    """The border nodes of all partitions, read in order, as swept rows in ``out``; its stack is one path."""

    def __init__(self):
        self.out: list[list] = []
        self.stack: list[_Node] = []
        self.digests: list = []
        self.refs: list[list[tuple]] = []

    def add(self, kind: int, part: int, side: int, depth: int, known: list, turn: str, length: int, ends: str) -> None:
        if kind == PIECE:
            text, node = ends, self.stack[depth]
            self.digests[depth].update((f",{text}" if node.ends else text).encode())
            node.ends = [1]
            return
        if side or depth >= len(self.stack) or self.stack[depth].turn != turn:
            self.pop(depth)
            self.stack.append(_Node(turn, length))
            self.digests.append(hashlib.sha256())
            self.refs.append([])
        self.stack[depth].add(*known)
        self.refs[depth].append((part, side, depth))

    def pop(self, depth: int) -> None:
        """Close the nodes at ``depth`` and deeper."""
        while len(self.stack) > depth:
            node, at = self.stack.pop(), len(self.stack)
            row = node.closed(at, self.digests.pop().hexdigest())
            for r in node.below:
                r[2] = node.least
                self.out.append([CLOSED, None, None, None, None, *r, None, None, None])
            for part, side, up in self.refs.pop():
                self.out.append([KNOWN, part, side, up, None, node.least, *[None] * 10])
            if self.stack:
                self.stack[-1].add(node.least, node.n, 1, node.leaves, node.saved)
                self.stack[-1].below.append(row)
            else:
                self.out.append([CLOSED, None, None, None, None, *row, None, None, None])


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(FIELDS)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, TYPES[kind]) for c, (_, kind) in zip(columns, FIELDS, strict=True)], [n for n, _ in FIELDS]
    )


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = Sweep(TaskContext.get().partitionId())
    for b in batches:
        for conv, key, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
            sweep.add(conv, key, lengths)
        yield _batch(sweep.out)
        sweep.out = []
    sweep.end()
    yield _batch(sweep.out)


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stitch = Stitch()
    for b in batches:
        for r in b.to_pylist():
            known = [r[k] for k in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
            stitch.add(r["kind"], r["part"], r["side"], r["up"], known, r["turn"], r["length"], r["ends"])
        yield _batch(stitch.out)
        stitch.out = []
    stitch.pop(0)
    yield _batch(stitch.out)


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie over sequences (conv_id, keys, lengths); ids are distinct, keys of ``WIDTH`` characters.

    Returns a row per node: conv_id (its smallest member), depth, parent_conv_id (the parent's; null for the root),
    n_convs, n_children, n_leaves and saved_tokens over its subtree, itself included, and ends_sha256, the digest of the
    ascending, comma-joined ids that end in it. No sequences give no nodes, not even a root.

    A partition holds its open path and the rows below it; one task reads the borders, two paths of each partition.
    """
    spark = sequences.sparkSession
    small_batches(spark, 4096)
    # One string sorts as the array does: digests have one width, and a prefix comes first.
    rows = cut(sequences.select("conv_id", F.array_join("keys", "").alias("key"), "lengths"))
    placed = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    swept = cut(placed.select("conv_id", "key", "lengths").mapInArrow(_swept, SWEPT))
    borders = swept.where(F.col("kind").isin(BORDER, PIECE)).coalesce(1).sortWithinPartitions(
        "part", "side", "up", "kind", "place"
    )
    stitched = cut(borders.mapInArrow(_stitched, SWEPT))
    names = [f.split()[0] for f in NODE.split(", ")]
    known = stitched.where(F.col("kind") == KNOWN).select("part", "side", "up", F.col("conv_id").alias("of"))
    below = swept.where(F.col("kind") == BELOW).drop("parent_conv_id").join(
        broadcast_if_small(known), ["part", "side", "up"]
    ).withColumnRenamed("of", "parent_conv_id")
    closed = swept.where(F.col("kind") == CLOSED).unionByName(stitched.where(F.col("kind") == CLOSED))
    return closed.select(*names).unionByName(below.select(*names))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The prefix trie of rebuilt conversations, given as rows (conv_id, turn, role, text): see ``trie`` for its rows.

    Turns are ordered by turn, null first, ties by the digest of role and text; null roles and texts are empty, texts of
    any length are read whole. Every conversation begins with the first h turns of conversation id - id mod 100, h being
    crc32(id) mod 6, and goes on with its own after the first h; the remainder of a negative id is not negative. Rows
    without a conv_id belong to no conversation; repeated rows are turns of their own. Other columns are ignored. Turns
    are compared by 128 bits of their digest. A conversation's digests (32 bytes a turn) have to fit in a worker's memory.
    """
    return trie(rebuilt(turn_keys(turns)))
