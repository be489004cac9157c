"""Conversation repair (11) and prefix trie (12) against plain versions, on their own edge cases."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from quire.llm import prefix_trie, repair

SCHEMA = "conv_id long, turn long, role string, text string, gaps string, node string, kind string, depth double"


def table(spark, rows):
    return spark.createDataFrame([(*r, None, "x", None, None) for r in rows], SCHEMA).repartition(3)


def random_rows(seed, convs=60):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in rng.sample(range(-2, 12), rng.randrange(0, 8)):
            rows.append((c, None if t == 5 else t, rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "usr", "", None]),
                         rng.choice(["Yes.", "no", "What? ", " \t", "", None, "a. b", "Fine!\n", "x ", "Yes."])))
    return rows


EDGE = [(None, 0, "user", "no id."), (None, 1, "assistant", "none."), (100, None, None, None), (101, 3, "user", "same."), (101, 3, "user", "same."), (101, 4, "assistant", "ok."),
        (102, 0, "user", "word. " * 50_000), (102, 9_000_000_000, "assistant", "end."), (-7, 0, "user", "minus."), (-7, 1, "assistant", "seven.")]


# ------------------------------------------------------------------ repair


def brute_repair(codes):
    nxt = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @lru_cache(None)
    def f(i, q, inserted):
        best = [(0, "")] if i == len(codes) and q in (0, 3) else []
        moves = [("I", 2, r, i) for r in "ua"] if inserted < 3 else []
        if i < len(codes):
            role, fault = divmod(codes[i], 4)
            cost, audit = f(i + 1, q, 0)
            best.append((cost + 3, "D" + audit))
            if fault not in (1, 2):
                moves += [("K", fault == 3, "sua?"[role], i + 1)] + [("R", 2 + (fault == 3), r, i + 1) for r in "ua"]
        for letter, price, r, j in moves:
            if (q, r) in nxt:
                cost, audit = f(j, nxt[q, r], inserted + 1 if letter == "I" else 0)
                best.append((cost + price, letter + audit))
        return min(best, default=(10**9, ""))
    return f(0, 0, 0)


def brute_conversation(rows, damage=True):
    after = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if damage else 9
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        after += [(t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    codes, seen = [], set()
    for _, role, text in after:
        solid = text.rstrip(" \t\n\v\f\r")
        fault = 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0
        seen.add((role, text))
        codes.append(4 * ("sua".index(role[0]) if role[:1] in tuple("sua") else 3) + fault)
    cost, audit = brute_repair(bytes(codes))
    lines, at, state = [], 0, 0
    for letter in audit:
        expected = "uuau"[state]
        kept = letter == "K" and after[at][1][0] == "s"
        if letter == "K":
            lines.append(f"{after[at][1]}:{after[at][2]}")
        elif letter != "D":
            lines.append({"u": "user", "a": "assistant"}[expected] + ":" + (after[at][2] if letter == "R" else ""))
        state = state if letter == "D" else 1 if kept else {"u": 2, "a": 3}[expected]
        at += letter != "I"
    turns = {t for t, _, _ in after if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(after, after[1:], strict=False)]
    return (gaps, *(sum(c % 4 == k for c in codes) for k in (1, 2, 3)), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_auction_finds_the_least_cheapest_audit():
    rng = random.Random(4)
    for _ in range(3000):
        codes = bytes(rng.randrange(16) for _ in range(rng.randrange(9)))
        assert repair.cheapest(codes) == brute_repair(codes)


def test_auction_prices_are_feasible_and_tight_for_long_conversations():
    rng = random.Random(5)
    codes = bytes(rng.randrange(16) for _ in range(20_000))
    price = repair.auction(codes)
    for row in rng.sample(range(len(codes)), 500):
        for state in range(4):
            assert price[4 * row + state] == min(cost + price[4 * r + s] for _, cost, r, s in repair.arcs(codes, row, state))
    cost, audit = repair.solve(codes)
    assert cost == price[0] and sum(a != "I" for a in audit) == len(codes)


@pytest.mark.parametrize("damage", [True, False])
def test_repair_equals_brute_force(spark, damage):
    rows = random_rows(1) + EDGE
    got = {r[0]: tuple(r)[1:] for r in repair.repair_conversations(table(spark, rows), damage).collect()}
    assert got == {c: brute_conversation([r for r in rows if r[0] == c], damage) for c in {r[0] for r in rows}}


def test_repair_of_nothing_and_of_small_batches(spark):
    assert repair.repair_conversations(table(spark, []).filter("false")).count() == 0
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(300)] + [(2, 0, "user", "hm")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a conversation goes on from batch to batch
    try:
        got = {r[0]: tuple(r)[1:] for r in repair.repair_conversations(table(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {c: brute_conversation([r for r in rows if r[0] == c]) for c in (1, 2)}


# ------------------------------------------------------------------ trie


def brute_trie(rows):
    convs = {}
    for c, t, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((t, role or "", text or ""))
    for turns in convs.values():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()))
    built = {}
    for c, turns in convs.items():
        base = c - int(c / 20 - (c / 20) % 1 if c >= 0 else -((-c / 20) - (-c / 20) % 1)) * 20
        base = c - base
        h = zlib.crc32(str(c).encode()) % 4
        own = [r[1:] for r in turns]
        built[c] = own if base == c else [r[1:] for r in convs.get(base, [])[:h]] + own[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {n: [m for m in members if len(m) == len(n) + 1 and m[:-1] == n] for n in members}

    def total(n):
        parts = [total(m) for m in children[n]]
        own = (len(members[n]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0)
        return sum(p[0] for p in parts) or 1, own + sum(p[1] for p in parts)

    out = []
    for n, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(n))))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), *total(n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def shared_rows():
    rng, rows = random.Random(2), []
    for c in [*range(0, 130, 2), 200, 207, 341]:  # 341's first of the block is absent
        common = [("user", "Hello there."), ("assistant", "How can I help you?")] if c % 3 else []
        for t, (role, text) in enumerate(common + [("user", rng.choice(["a", "b c", "d  e\tf"])) for _ in range(rng.randrange(4))]):
            rows.append((c, t if t != 1 else None, role, text))
    return rows + [(c, t, "user", f"copy {t}") for c in range(1000, 1060) for t in range(3)]


@pytest.mark.parametrize("shards", [2, 1024])
def test_trie_equals_brute_force(spark, shards):
    rows = shared_rows() + [r for r in EDGE if r[0] is not None] + [(500, t, "user", "only") for t in range(2)] + [(511, 0, None, None), (523, 0, "user", "x"), (523, 0, "user", "x")]
    got = prefix_trie.prefix_trie(table(spark, [*rows, *[r for r in EDGE if r[0] is None]]), shards)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(table(spark, []).filter("false")).count() == 0


def test_queue_spills_and_keeps_order():
    rng = random.Random(3)
    queue, out = prefix_trie.SpillingQueue(limit=50), []
    values = [(rng.randrange(1000), k) for k in range(3000)]
    for k, v in enumerate(values):
        queue.push(v)
        if k % 3 == 2 and k < 1500:
            out.append(queue.pop())
    assert queue.spills > 10
    while queue.peek() is not None:
        assert queue.peek() <= min(queue.heap, default=queue.peek())
        out.append(queue.pop())
    assert sorted(out) == sorted(values) and out[-1000:] == sorted(out[-1000:])


def test_time_forward_is_the_same_with_spills():
    rng, rows, names = random.Random(6), [], {}
    for k in range(2000):
        parent = rng.randrange(k) if k else None
        names[k] = (0 if parent is None else names[parent][0] + 1, k.to_bytes(16, "big"))
        rows.append((names[k][0], names[k][1], None if parent is None else names[parent][1], k, rng.randrange(1, 9), rng.randrange(5), b"", parent is not None, 0, 0, 0))
    rows.sort(key=lambda r: (-r[0], r[1]))
    plain, spilled = (sorted(prefix_trie.time_forward(iter(rows), limit)) for limit in (10**6, 20))
    assert plain == spilled
    root = next(r for r in plain if r[1] == 0)
    assert root[6] == sum((r[4] - 1) * r[5] for r in rows) and root[5] == len({r[3] for r in rows} - {r[2] for r in plain})
