"""Structure repair of conversations as shortest paths, found by auction.

A conversation's cheapest repair is a shortest path through a lattice of (rows used up, state of the grammar
``(s?(ua)+)?``). Bertsekas's auction algorithm finds it: a path grows from an origin; its last node either raises its price to the cheapest
arc plus the price behind it, and the path contracts, or the arc is tight and the path extends. Origins are taken from the end of the
conversation, so prices behind a row have converged and a path ends at the first converged node: the steps a row are bounded. When all
prices have converged they are the distances to the end, the tight arcs are exactly those of cheapest repairs, and following the
ASCII-least tight arc gives the audit.

On Spark the rows are dealt to tasks by conversation and sorted there, without their texts: a row is one byte (its role's initial and
its fault), so that a task holds a byte a row of one conversation. Texts are shuffled once, behind their conversation's audit, and stream
through SHA-256, which is sequential by nature.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.bytegroups import tidy

#: Costs of the edits, by contract.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: States of the grammar: nothing yet, after s, after u, after a. What an inserted or re-roled row becomes, and the state behind it.
EXPECTS, BEHIND, ACCEPTS = "uuau", (2, 2, 3, 2), (True, False, False, True)
#: A row's byte: 4 * initial + fault, with initials s, u, a, other and these faults; DROPPED: the row is gone, only its conversation counts.
SOUND, BLANK, DUPLICATE, CUT_OFF, DROPPED = 0, 1, 2, 3, 255
INITIALS = "sua"

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def arcs(codes: bytes, row: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(edit, cost, row, state) of the arcs out of a node, by letter."""
    if row < len(codes):
        yield "D", DELETE, row + 1, state
    yield "I", INSERT, row, BEHIND[state]
    if row < len(codes):
        initial, fault = divmod(codes[row], 4)
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT_OFF else 0
            if initial == 0 and state == 0:
                yield "K", more, row + 1, 1
            elif initial < 3 and INITIALS[initial] == EXPECTS[state]:
                yield "K", more, row + 1, BEHIND[state]
            yield "R", REROLE + more, row + 1, BEHIND[state]


def auction(codes: bytes) -> array:
    """Converged prices of all nodes (4 * row + state): their distances to the end."""
    n = len(codes)
    price, converged = array("q", bytes(32 * (n + 1))), bytearray(4 * (n + 1))
    for row in range(n, -1, -1):
        if row < n:  # no node of this row can be nearer to the end than the nearest behind it
            opening = min(price[4 * row + 4:4 * row + 8])
            for state in range(4):
                price[4 * row + state] = opening
        out = {}
        for origin in range(4):
            path = [origin]
            while path:
                state = path[-1]
                node = 4 * row + state
                if converged[node]:
                    for s in path:
                        converged[4 * row + s] = 1
                    break
                if state not in out:
                    out[state] = [(cost, 4 * r + s) for _, cost, r, s in arcs(codes, row, state)]
                best, head = min((cost + price[to], to) for cost, to in out[state])
                if row == n and ACCEPTS[state]:
                    best, head = 0, -1  # the arc to the end, whose price is 0
                if price[node] < best:
                    price[node] = best
                    if len(path) > 1:
                        path.pop()
                elif head < 0 or head >= 4 * row + 4:  # tight, and what lies behind has converged
                    for s in path:
                        converged[4 * row + s] = 1
                    break
                else:
                    path.append(head - 4 * row)
    return price


@lru_cache(maxsize=20_000)
def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest repair, of equal ones the ASCII-least, for a conversation given as its rows' bytes."""
    price, row, state, audit = auction(codes), 0, 0, []
    while row < len(codes) or not ACCEPTS[state]:
        letter, row, state = next((letter, r, s) for letter, cost, r, s in arcs(codes, row, state) if price[4 * row + state] == cost + price[4 * r + s])
        audit.append(letter)
    return price[0], "".join(audit)


def solve(codes: bytes) -> tuple[int, str]:
    return cheapest(codes) if len(codes) <= 64 else cheapest.__wrapped__(codes)


def illegal_pairs(codes: np.ndarray) -> int:
    initial = codes // 4
    pairs = initial[:-1] * 4 + initial[1:]
    return int(len(pairs) - np.isin(pairs, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1)).sum())


# ------------------------------------------------------------------ rows


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows after the contract's damage, by crc32(``conv_id:turn``) modulo 20 with nulls as one space.
    ``copies``: 2 for a repeated row, 0 for a dropped one."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"),
                                filled("text").alias("text"), kind.alias("kind"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                       F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))


def as_is(conversations: DataFrame) -> DataFrame:
    """The rows undamaged, in the form of ``damaged``; a null role or text is one space."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(1).alias("copies"))


def _codes(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, code``, dealt by conversation and sorted by turn, role and text digest. Rows repeated at one turn follow each other."""
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    solid = F.rtrim("text", F.lit(BLANKS))
    slim = rows.select("conv_id", "turn", "role", number.alias("initial"), F.sha2("text", 256).alias("digest"), "copies", (F.length(solid) == 0).alias("blank"),
                       F.substring(solid, -1, 1).isin(".", "!", "?").alias("ended"))
    slim = slim.withColumn("copy", F.explode(F.sequence(F.lit(0), F.greatest(F.col("copies") - 1, F.lit(0)))))
    same = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("copies") == 0, F.col("turn").asc_nulls_first())
    fault = F.when(F.col("blank"), BLANK).when(F.row_number().over(same) > 1, DUPLICATE).when(~F.col("ended"), CUT_OFF).otherwise(SOUND)
    code = F.when(F.col("copies") == 0, DROPPED).otherwise(4 * F.col("initial") + fault)
    # the rows of a conversation meet first: the window by role and text then needs no shuffle of its own
    coded = slim.repartition("conv_id").select("conv_id", "turn", "role", "digest", code.cast("int").alias("code"))
    return coded.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest", F.col("code") % 4 == DUPLICATE).select(
        "conv_id", "turn", "code")


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def edges(ids: pa.Array) -> np.ndarray:
    """Where a new value (null is one) begins in a sorted column, the first row included."""
    value, known = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_valid(ids).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero((value[1:] != value[:-1]) | (known[1:] != known[:-1])) + 1))


class _Open:
    """What is kept of the conversation that the stream is in."""

    def __init__(self, conv_id):
        self.conv_id, self.codes, self.least, self.last, self.turns = conv_id, bytearray(), None, None, 0

    def add(self, codes: np.ndarray, turns: pa.Array) -> None:
        live = codes != DROPPED
        self.codes += codes[live].astype(np.uint8).tobytes()
        known = np.unique(turns.filter(pa.array(live)).drop_null().to_numpy(zero_copy_only=False))
        if len(known):
            self.turns += len(known) - (self.last is not None and known[0] == self.last)
            self.least, self.last = int(known[0]) if self.least is None else self.least, int(known[-1])

    def row(self) -> tuple:
        codes = np.array(self.codes, np.uint8)
        cost, audit = solve(bytes(self.codes))
        counts = np.bincount(codes % 4, minlength=4).tolist()
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        return self.conv_id, gaps, counts[BLANK], counts[DUPLICATE], counts[CUT_OFF], illegal_pairs(codes), cost, audit


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows):
        kinds = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in AUDITS.split(", ")])

    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, turns, codes = batch.column(0), batch.column(1), batch.column(2).to_numpy()
        starts, done = edges(ids).tolist(), []
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            conv = ids[a].as_py()
            if now is None or now.conv_id != conv:
                if now is not None:
                    done.append(now.row())
                now = _Open(conv)
            now.add(codes[a:b], turns.slice(a, b - a))
        if done:
            yield batch_of(done)
    if now is not None:
        yield batch_of([now.row()])


def audits(rows: DataFrame) -> DataFrame:
    """``AUDITS`` of each conversation of ``rows`` (form of ``damaged``)."""
    return _codes(rows).mapInArrow(tidy(_judge), AUDITS)


class _Hand:
    """Applies an audit to the rows that follow it and passes the repaired lines on."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _role(self) -> str:
        role = ROLES[EXPECTS[self.state]]
        self.state = BEHIND[self.state]
        return role

    def inserts(self) -> Iterator[str]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._role() + ":"

    def row(self, role: str, text: str) -> Iterator[str]:
        yield from self.inserts()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = 1 if role[:1] == "s" else BEHIND[self.state]
            yield f"{role}:{text}"
        elif letter == "R":
            yield f"{self._role()}:{text}"


REPAIRED = AUDITS + ", repaired_sha256 string"
NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``REPAIRED`` from heads (audit not null), each followed by its conversation's rows in order."""
    head, hand, digest, lines = None, None, None, 0

    def feed(parts):
        nonlocal lines
        for line in parts:
            digest.update(("\n" if lines else "").encode() + line.encode())
            lines += 1

    def finished() -> tuple:
        feed(hand.inserts())
        return *head, digest.hexdigest()

    def batch_of(rows):
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in REPAIRED.split(", ")])

    for batch in batches:
        done = []
        for *row, role, text, copies in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            if row[-1] is not None:
                if head is not None:
                    done.append(finished())
                head, hand, digest, lines = row, _Hand(row[-1]), hashlib.sha256(), 0
            else:
                for _ in range(copies):
                    feed(hand.row(role, text))
        if done:
            yield batch_of(done)
    if head is not None:
        yield batch_of([finished()])


def repair(rows: DataFrame) -> DataFrame:
    """``REPAIRED`` of each conversation of ``rows`` (form of ``damaged``). Each audit travels ahead of its conversation's rows, and both
    stream through one task."""
    heads = audits(rows).select("conv_id", *NUMBERS, "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("text", "string"), ("copies", "int"), ("turn", "long"), ("digest", "string"))])
    body = rows.filter("copies > 0").select("conv_id", *[F.lit(None).cast("long").alias(c) for c in NUMBERS], F.lit(None).cast("string").alias("audit"), "role", "text", "copies", "turn",
                                            F.sha2("text", 256).alias("digest"))
    dealt = heads.unionByName(body).repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "digest")
    return dealt.select("conv_id", *NUMBERS, "audit", "role", "text", "copies").mapInArrow(tidy(_hash), REPAIRED)


def repair_conversations(conversations: DataFrame, damage: bool = True) -> DataFrame:
    """Faults and cheapest repair of every conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``conversations`` has ``conv_id`` and ``turn`` (read as longs), ``role`` and ``text``; ``damage``: whether the contract's damage is done first.
    Rows are taken by turn, nulls first; rows of one turn by role, then by the SHA-256 of their text, repeated ones one after the other. A null
    role or text is one space: such a text is blank, such a role can only be re-roled or deleted. An empty role has no
    initial. Rows with null conv_id are one conversation. A conversation of which no row is left has zeros, an empty audit and the empty
    string's hash; an empty table gives an empty result. Other columns are ignored. Very long texts and conversations are one
    result row each, as the contract has it: a task keeps a byte a row of one conversation (32 while it is solved), and texts pass by."""
    return repair(damaged(conversations) if damage else as_is(conversations))
