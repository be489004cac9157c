"""The trie of conversation prefixes, its subtree totals found by time-forward processing.

Texts are read once and never shuffled: a turn is a digest and a word count. Turns are dealt by block of conversations and stream,
sorted, through tasks that rebuild each conversation and chain its digests into node names. Nodes are then aggregated (with map-side
combining, so that a prefix which a third of all conversations share is one row a task).

Subtree totals: nodes that more than 1 / ``SHARDS`` of all conversations share, down to a fixed depth, are ``top`` nodes, whose number is
bounded by construction; every other node belongs to the subtree of the first node of its path that is not a top node. Whole subtrees are dealt to
shards. A shard sorts its nodes by reverse level order (Spark's external sort) and processes them in that order: a node takes the messages of its
children from a spilling priority queue, adds itself and sends its totals to its parent's place in the order. What subtree roots
send is summed by parent, and the top nodes are processed the same way.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bytegroups import tidy
from quire.llm.common import stored

#: Conversations are rebuilt in blocks of so many ids, the first of which gives the prefix of at most HEAD - 1 turns.
BLOCK, HEAD = 20, 4
#: A node is a top node if more than 1 / SHARDS of the conversations share it; at most SHARDS a level, TOP_NODES in all.
SHARDS, TOP_NODES = 1024, 1 << 18
#: Ids that end at one node are joined to text in groups of at most so many before they meet.
ID_GROUP = 1 << 14
#: Messages that a queue holds in memory before it spills.
QUEUE_ROWS = 200_000
ROOT = b"\x00" * 16

WORD = "[^\\x20\\x09-\\x0D]+"


class SpillingQueue:
    """A priority queue whose entries beyond ``limit`` lie in sorted runs of unnamed files, which go with the task (as Spark's
    own spills do; nothing outside the task reads them)."""

    def __init__(self, limit: int = QUEUE_ROWS):
        self.limit, self.heap, self.runs, self.spills = limit, [], [], 0

    def _spill(self) -> None:
        self.heap.sort()
        folders = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
        run = tempfile.TemporaryFile(dir=folders[0] if folders else None)
        for k in range(0, len(self.heap), 1000):
            pickle.dump(self.heap[k:k + 1000], run, protocol=pickle.HIGHEST_PROTOCOL)
        run.seek(0)
        entries = self._entries(run)
        heapq.heappush(self.runs, (next(entries), self.spills, entries))
        self.heap, self.spills = [], self.spills + 1

    @staticmethod
    def _entries(run) -> Iterator[tuple]:
        with run:
            while True:
                try:
                    yield from pickle.load(run)
                except EOFError:
                    return

    def push(self, entry: tuple) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) >= self.limit:
            self._spill()

    def peek(self) -> tuple | None:
        heads = [q[0] for q in (self.heap[:1], [r[0] for r in self.runs[:1]]) if q]
        return min(heads) if heads else None

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            entry, number, entries = self.runs[0]
            following = next(entries, None)
            if following is None:
                heapq.heappop(self.runs)
            else:
                heapq.heapreplace(self.runs, (following, number, entries))
            return entry
        return heapq.heappop(self.heap)


# ------------------------------------------------------------------ nodes

STEPS = "node binary, parent binary, depth long, conv_id long, words long, ends boolean"


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``STEPS`` of every conversation from turns sorted by block, block head first, conversation and turn."""
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = [f.split()[0] for f in STEPS.split(", ")]
    out: list[tuple] = []
    head: list[tuple] = []
    head_block, conv, seen, skip, step = None, None, 0, 0, None

    def advance(digest, words):
        nonlocal step
        out.append((*step, False))
        name = hashlib.sha256(step[0] + digest).digest()[:16]
        step = (name, step[0], step[2] + 1, conv, words)

    for batch in batches:
        for block, conv_id, digest, words in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if conv_id != conv:
                if step is not None:
                    out.append((*step, True))
                conv, seen, skip, step = conv_id, 0, 0, (ROOT, None, 0, conv_id, 0)
                if conv == block:
                    head, head_block = [], block
                else:
                    skip = zlib.crc32(str(conv).encode()) % HEAD
                    for turn in head[:skip] if head_block == block else ():
                        advance(*turn)
            if conv == block and seen < HEAD - 1:
                head.append((digest, words))
            seen += 1
            if seen > skip:
                advance(digest, words)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
            out = []
    if step is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*step, True), kinds, strict=True)], names=names)


def steps(conversations: DataFrame) -> DataFrame:
    """A row for each node on each rebuilt conversation's path, the root first: name, parent's name, depth, words of the last turn,
    and whether the conversation ends there."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.filter("conv_id is not null").select((conv - conv % BLOCK).alias("block"), conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                                              digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    dealt = turns.repartition("block").sortWithinPartitions("block", F.col("conv_id") != F.col("block"), "conv_id", F.col("turn").asc_nulls_first(), "digest")
    return dealt.select("block", "conv_id", "digest", "words").mapInArrow(tidy(_rebuild), STEPS)


EMPTY = hashlib.sha256(b"").digest()


def _ids_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, digest = None, None
    for batch in batches:
        done = []
        for name, ids in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            if name != node:
                if node is not None:
                    done.append((node, digest.digest()))
                node, digest = name, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*done, strict=True)], names=["node", "ends"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (node, digest.digest())], names=["node", "ends"])


def ending(path: DataFrame) -> DataFrame:
    """``node, ends``: SHA-256 of the ids that end at a node. Ids are sorted and joined in groups of an id range of fixed width, which
    are then hashed in order: the hash itself is sequential, but a node's ids reach its task as few rows."""
    group = F.floor(F.col("conv_id") / ID_GROUP)
    joined = path.filter("ends").groupBy("node", group.alias("group")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    return joined.repartition("node").sortWithinPartitions("node", "group").select("node", "ids").mapInArrow(tidy(_ids_hashed), "node binary, ends binary")


def nodes(path: DataFrame) -> DataFrame:
    """One row a node: name, parent, depth, smallest and number of members, words of the last turn and the ended ids' hash."""
    grouped = path.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
                                       F.count("*").alias("n_convs"), F.first("words").alias("words"))
    return grouped.join(ending(path), "node", "left").withColumn("ends", F.coalesce("ends", F.lit(EMPTY)))


# ------------------------------------------------------------------ totals

#: What a shard returns: nodes with their totals; of subtree roots parent_conv_id is filled in later, by the parent's name.
TOTALS = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary, up binary")
NAMES = [f.split()[0] for f in TOTALS.split(", ")]
KINDS = [pa.int64()] * 7 + [pa.binary()] * 2


def time_forward(rows: Iterator[tuple], limit: int = QUEUE_ROWS) -> Iterator[tuple]:
    """Tuples of ``TOTALS`` from nodes in reverse level order (deepest first, then by name): ``(depth, node, parent, conv_id, n_convs,
    words, ends, inside, children, leaves, saved)``. ``inside``: whether the parent is among the rows; the last three are sums over children that are not.

    A node's message to its parent is queued under the parent's place in the order, with all that the child's result lacks: its
    parent's smallest member. A childless node is a leaf."""
    queue = SpillingQueue(limit)
    for depth, node, parent, conv_id, n_convs, words, ends, inside, n_children, leaves, saved in rows:
        place = (-depth, node)
        while (message := queue.peek()) is not None and message[0] == place:
            _, child, *fields = queue.pop()
            n_children, leaves, saved = n_children + 1, leaves + fields[2], saved + fields[3]
            yield child, depth + 1, conv_id, *fields, None
        leaves, saved = leaves or 1, saved + (n_convs - 1) * words
        if inside:
            queue.push(((1 - depth, parent), conv_id, n_convs, n_children, leaves, saved, ends))
        else:
            yield conv_id, depth, None, n_convs, n_children, leaves, saved, ends, parent
    if queue.peek() is not None:
        raise ValueError("a node's parent is not among the rows")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    held = []
    for row in time_forward(rows()):
        held.append(row)
        if len(held) == 5000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), KINDS, strict=True)], names=NAMES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), KINDS, strict=True)], names=NAMES)


ROWS = ["depth", "node", "parent", "conv_id", "n_convs", "words", "ends", "inside", "n_children", "n_leaves", "saved_tokens"]


def subtree_totals(tree: DataFrame, path: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``TOTALS`` without ``up`` for the nodes of ``tree`` (stored), given the stored ``path`` rows."""
    total = F.broadcast(tree.filter("depth = 0").select(F.col("n_convs").alias("total")))
    levels = max(1, TOP_NODES // shards)
    top = tree.join(total, how="cross").filter((F.col("depth") < levels) & (F.col("n_convs") > F.greatest(F.lit(1), F.floor(F.col("total") / shards)))).drop("total")
    top = stored(top, "trie-top")  # at most TOP_NODES rows: less than ``shards`` at each of ``levels`` levels
    named = F.broadcast(top.select("node"))
    # a conversation's subtree is that of its path's first node that is not a top node
    roots = path.join(named, "node", "left_anti").groupBy("conv_id").agg(F.min_by("node", "depth").alias("subtree"), F.min("depth").alias("root_depth"))
    below = tree.join(named, "node", "left_anti").join(roots, "conv_id").withColumns(
        {"inside": F.col("depth") > F.col("root_depth"), **{c: F.lit(0).cast("long") for c in ("n_children", "n_leaves", "saved_tokens")}})
    dealt = below.repartition("subtree").sortWithinPartitions(F.col("depth").desc(), "node")
    light = stored(dealt.select(ROWS).mapInArrow(tidy(_totals), TOTALS), "trie-shards")

    sums = light.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    upper = top.join(sums, "node", "left").withColumn("inside", F.col("depth") > 0).na.fill(0, ["n_children", "n_leaves", "saved_tokens"])
    heavy = upper.select(ROWS).coalesce(1).sortWithinPartitions(F.col("depth").desc(), "node").mapInArrow(tidy(_totals), TOTALS)

    owners = F.broadcast(top.select(F.col("node").alias("up"), F.col("conv_id").alias("owner")))
    attached = light.join(owners, "up", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "owner"))
    return attached.select(NAMES[:-1]).unionByName(heavy.select(NAMES[:-1]))


def prefix_trie(conversations: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A row for every distinct prefix of the rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``.

    ``conversations`` has ``conv_id`` and ``turn`` (read as longs), ``role`` and ``text``. Turns are ordered by ``turn``, nulls first; turns of one
    number by the SHA-256 of role and text, repeated ones all count. A null role or text is empty. Rows with null conv_id belong to no
    conversation and have no part in the trie. A conversation without turns after rebuilding is a member of the root and ends there. Very long texts
    are read where they lie (a digest and a word count leave the scan); a very long conversation streams through one task. An empty
    table has no conversation and so no node. Other columns are ignored. The ids of a node are hashed in one stream, as SHA-256 must be."""
    path = stored(steps(conversations), "trie-path")
    tree = stored(nodes(path), "trie-nodes")
    result = subtree_totals(tree, path, shards)
    return result.select(*[c for c in NAMES[:-2]], F.lower(F.hex("ends")).alias("ends_sha256"))
