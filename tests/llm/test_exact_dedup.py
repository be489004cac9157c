import hashlib
import random

from pyspark.sql import functions as F

from quire.llm.exact_dedup import drop_exact_duplicates, exact_duplicates


def lower_az(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower_az(t), []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, stays = max(known, default=None), True
        for i in ids:
            kept = i == keep and stays
            stays = stays and not kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(map(str, out))


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_random_texts_against_brute_force(docs_of):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("aAbÄ ", k=rng.choice([0, 1, 7, 8, 9, 16, 40])))) for i in range(120)]
    rows += [(500 + i, rows[i][1].upper()) for i in range(0, 120, 3)] + [(900 + i, "shared text " * 5) for i in range(60)]
    df = docs_of(rows)
    assert got(exact_duplicates(df, block_bytes=8)) == brute(rows)


def test_blocks_that_share_a_key_are_told_apart(docs_of):
    rows = [(i, f"text number {i % 7} " * (1 + i % 3)) for i in range(40)]
    weak = exact_duplicates(docs_of(rows), block_bytes=8, key=lambda b: F.pmod(F.xxhash64(b), F.lit(3)))
    assert got(weak) == brute(rows)


def test_hard_rows(docs_of, hard):
    assert got(exact_duplicates(docs_of(hard))) == brute(hard)


def test_empty_table(docs_of):
    assert exact_duplicates(docs_of([])).collect() == []
    assert drop_exact_duplicates(docs_of([])).collect() == []


def test_rows_that_stay_keep_their_columns(docs_of, hard):
    df = docs_of(hard)
    kept = drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert kept.count() == sum("True" in r for r in brute(hard))


def test_plan_is_native(docs_of, capsys):
    exact_duplicates(docs_of([(1, "a"), (2, "b")])).explain()
    plan = capsys.readouterr().out
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
