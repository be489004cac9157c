"""Repeated-substring removal with suffix arrays.

Every byte covered by a 400-byte string that also starts anywhere else is removed. Comparing all text
with suffix arrays is split so that equal strings must meet, and texts that repeat nothing stay out:

1. Anchors. The smallest hash among the 100-byte strings inside a 400-byte window is the window's anchor
   (winnowing). Equal windows have equal anchors, so a window whose anchor occurs nowhere else is unique. Consecutive
   windows with one anchor form a snippet; snippets with an anchor that occurs once are left out.
2. Shards. Snippets are dealt to shards by anchor, equal snippets once with their count. A shard of bounded
   size gets a suffix array (Larsson-Sadakane refinement) and common prefixes (Kasai); windows next to each other
   in suffix order with 400 bytes in common repeat.
3. Merging. An anchor with more snippets than a shard holds is spread over several shards. Each sends its sorted distinct
   windows as digests, cut into ranges; a range is merged by binary search in the other shards' lists.
4. Removal. Intervals travel to the texts that have some, found through a fixed-size bit set; the other texts
   are not shuffled. Texts that occur twice repeat whole, without comparing.

Nothing is capped: a longer text, a more common string or a larger group only makes more shards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bytegroups import GROUP_BYTES, tidy
from quire.llm.common import among, stored
from quire.llm.near_dedup import _by_key
from quire.llm.suffix_array import repeated_prefixes
from quire.llm.wordhash import _powers, mix

SIZE = 400
GRAM = 100
SHARD_BYTES = 2_000_000
EXTRACT_BYTES = 8 << 20  # of snippets in a batch


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes that start at each position."""
    n = len(buf)
    power, inverse = _powers(n + 1)
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * inverse[:n], out=run[1:])
    m = n - gram + 1
    return mix((run[gram:] - run[:m]) * power[:m])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    have, span = x, 1
    while span * 2 <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    rest = width - span
    return np.minimum(have[:len(have) - rest], have[rest:]) if rest else have


def anchored_windows(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, gram: int):
    """Anchor hash, text number, first and last window start (in the text) of every run of windows with one anchor hash."""
    none = np.zeros(0, np.int64)
    if len(buf) < size:
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(buf, gram)
    low = np.uint64((1 << 22) - 1)
    picked = sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), size - gram + 1)
    counts = np.maximum(ends - starts - size + 1, 0)
    text = np.repeat(np.arange(len(starts)), counts)
    at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[text]
    anchor = (picked[at] & low).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))) if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    value, of = h[anchor[first]], text[first]
    tied = np.concatenate(([False], (value[1:] == value[:-1]) & (of[1:] == of[:-1])))[:len(first)]
    if tied.any():  # equal anchors one after the other (short periods): all but the first in runs of a window's length, so that the
        # runs of a text have a few times its bytes; there are still two, so the anchor does not look unique
        apart = ~tied | ~np.concatenate(([False], tied[:-1]))
        part = (first - np.maximum.accumulate(np.where(apart, first, 0))) // (size - gram + 1)
        first = first[apart | (part != np.concatenate(([0], part[:-1])))]
    last = np.append(first[1:], len(at)) - 1
    return h[anchor[first]], text[first], at[first] - starts[text[first]], at[last] - starts[text[first]]


def _anchors(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """``node, h, s1, s2``: the runs of windows of every text."""
    def run(batches):
        for batch in batches:
            nodes, bodies = batch.column(0), batch.column(1)
            sizes = pc.binary_length(bodies).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.flatnonzero(sizes >= size)
            found = []
            a = 0
            while a < len(rows):
                b = a + max(1, int(np.searchsorted(np.cumsum(sizes[rows[a:a + 100_000]]), GROUP_BYTES, side="right")))
                some = rows[a:b]
                texts = [bodies[int(i)].as_py() for i in some]
                if len(texts) == 1:  # in slices that share size - 1 bytes
                    for cut in range(0, len(texts[0]) - size + 1, GROUP_BYTES):
                        part = np.frombuffer(texts[0], np.uint8, min(GROUP_BYTES + size - 1, len(texts[0]) - cut), cut)
                        h, text, s1, s2 = anchored_windows(part, np.array([0]), np.array([len(part)]), size, gram)
                        found.append((h, some[text], s1 + cut, s2 + cut))
                else:
                    ends = np.cumsum(sizes[some])
                    h, text, s1, s2 = anchored_windows(np.frombuffer(b"".join(texts), np.uint8), ends - sizes[some], ends, size, gram)
                    found.append((h, some[text], s1, s2))
                a = b
            if found:
                h, row, s1, s2 = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [nodes.take(pa.array(row)), pa.array(h.view(np.int64)), pa.array(s1.astype(np.int32)), pa.array(s2.astype(np.int32))],
                    names=["node", "h", "s1", "s2"])

    return docs.select("node", "body").mapInArrow(tidy(run), "node binary, h long, s1 int, s2 int")


def _runs(offsets: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last of each run of consecutive ascending numbers."""
    cut = np.flatnonzero(np.diff(offsets) != 1)
    return offsets[np.append(0, cut + 1)].tolist(), offsets[np.append(cut, len(offsets) - 1)].tolist()


SHARD_FIELDS = "h long, sd long, firsts array<int>, lasts array<int>, salt int, part int, digests binary, places binary"


def _shard_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                      names=[f.split()[0] for f in SHARD_FIELDS.split(", ")])


def _compare_shards(size: int):
    """Rows of repeated offsets by snippet; for snippets of spread anchors also the sorted distinct windows, cut into ranges."""
    def run(batches):
        for t in _by_key(batches, 1):
            h, sd, n = t["h"].to_numpy(), t["sd"].to_numpy(), t["n"].to_numpy()
            salt, spread = t["salt"].to_numpy(), t["spread"].to_numpy()
            snips = t["snip"].to_pylist()
            string, offset, group = repeated_prefixes(snips, size)
            members = np.bincount(group, minlength=int(group.max()) + 1 if len(group) else 0)
            again = (members[group] > 1) | (n[string] > 1)
            again |= np.bincount(group, again, len(members))[group] > 0
            order = np.lexsort((offset, string))
            order = order[again[order]]
            s, o = string[order], offset[order]
            edge = np.concatenate(([0], np.flatnonzero(np.diff(s)) + 1, [len(s)])) if len(s) else np.zeros(1, np.int64)
            rows = [(int(h[s[a]]), int(sd[s[a]]), *_runs(o[a:b]), None, None, None, None) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            for key, k in sorted({(int(h[i]), int(salt[i])) for i in np.flatnonzero(spread > 1)}):
                mine = np.flatnonzero((h[string] == key) & (salt[string] == k))
                _, one = np.unique(group[mine], return_index=True)
                one = mine[one]
                digest = np.array([hashlib.blake2b(snips[string[i]][offset[i]:offset[i] + size], digest_size=16).digest() for i in one], "S16")
                # the digest's first bytes give the range; every other window of its group is already known to repeat
                parts = int(spread[string[one[0]]])
                raw = np.frombuffer(digest.tobytes(), np.uint64).reshape(-1, 2).byteswap()
                by = np.lexsort((raw[:, 1], raw[:, 0]))
                part = ((raw[by, 0] >> np.uint64(40)) % np.uint64(parts)).astype(np.int64)
                for p in range(parts):
                    some = by[part == p]
                    place = np.column_stack((sd[string[one[some]]], offset[one[some]].astype(np.int64)))
                    rows.append((key, 0, None, None, k, p, raw[some].tobytes(), place.astype(np.int64).tobytes()))
            if rows:
                yield _shard_batch(rows)
    return run


def _merge_shards(batches):
    """Windows that several shards of one anchor have: each list is looked up by binary search in the others' merged list."""
    for t in _by_key(batches, 2):
        lists = [np.frombuffer(d, np.uint64).reshape(-1, 2) for d in t["digests"].to_pylist()]
        # one ordered number for each two-word digest
        every = np.concatenate(lists)
        order = np.lexsort((every[:, 1], every[:, 0]))
        new = np.concatenate(([True], (every[order][1:] != every[order][:-1]).any(1))) if len(every) else np.zeros(0, bool)
        number = np.empty(len(every), np.int64)
        number[order] = np.cumsum(new)
        bounds = np.cumsum([0, *map(len, lists)])
        mine = [number[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        merged = np.sort(number)
        found = []
        for values, places in zip(mine, t["places"].to_pylist(), strict=True):
            places = np.frombuffer(places, np.int64).reshape(-1, 2)
            elsewhere = np.searchsorted(merged, values, side="right") - np.searchsorted(merged, values) > 1
            found.append(places[elsewhere])
        found = np.concatenate(found)
        if len(found):
            found = found[np.lexsort((found[:, 1], found[:, 0]))]
            edge = np.concatenate(([0], np.flatnonzero(np.diff(found[:, 0])) + 1, [len(found)]))
            h = int(t["h"][0].as_py())
            yield _shard_batch([(h, int(found[a, 0]), *_runs(found[a:b, 1]), None, None, None, None)
                                for a, b in zip(edge[:-1], edge[1:], strict=True)])


def _extract(size: int, limit: int = EXTRACT_BYTES):
    def snippets(rows):
        cols = list(zip(*rows, strict=True))
        kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["node", "h", "s1", "s2", "snip"])

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for node, body, runs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for r in runs:
                    rows.append((node, r["h"], r["s1"], r["s2"], body[r["s1"]:r["s2"] + size]))
                    held += len(rows[-1][4])
                    if held >= limit:
                        yield snippets(rows)
                        rows, held = [], 0
            if rows:
                yield snippets(rows)
    return run


def cut_spans(body: bytes, firsts: np.ndarray, lasts: np.ndarray, size: int) -> tuple[int, list[tuple[int, int]], str]:
    """Bytes removed, maximal removed spans and the digest of what is left, given runs of repeated window starts."""
    spans: list[list[int]] = []
    for a, b in sorted(zip(firsts, lasts, strict=True)):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b + size)
        else:
            spans.append([a, b + size])
    left, at = hashlib.sha256(), 0
    for a, b in spans:
        left.update(body[at:a])
        at = b
    left.update(body[at:])
    return sum(b - a for a, b in spans), [(a, b) for a, b in spans], left.hexdigest()


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of each row of ``docs`` (spans: removed byte ranges).

    Null or empty text has no bytes and loses none; texts shorter than ``size`` lose nothing; rows repeated with one text repeat
    it wholly, also under one id; ids may be null; other columns are ignored; an empty table gives an
    empty result. Strings are judged on the input, never across texts."""
    base = docs.select("doc_id", F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))
    base = base.withColumn("node", F.substring(F.unhex(F.sha2("body", 256)), 1, 16))
    long = base.filter(F.octet_length("body") >= size).select("node", "body")

    runs = stored(_anchors(long, size, gram), "op2-runs")
    place = F.xxhash64("node", "s1")
    common = runs.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a != b").select("h")
    common = stored(common, "op2-common")  # a table of its own, so that a skewed join may split the anchor with a third of the runs
    shared = stored(runs.join(common, "h").distinct(), "op2-shared")

    wanted = shared.groupBy("node").agg(F.collect_list(F.struct("h", "s1", "s2")).alias("runs"))  # within one text
    texts = among(long, shared, "node").filter("maybe").select("node", "body").dropDuplicates(["node"])
    snips = texts.join(wanted, "node").select("node", "body", "runs").mapInArrow(
        tidy(_extract(size)), "node binary, h long, s1 int, s2 int, snip binary")
    snips = stored(snips.withColumn("sd", F.xxhash64("snip")), "op2-snippets")

    sizes = snips.select("h", "sd", (F.col("s2") - F.col("s1") + size).alias("bytes")).distinct().groupBy("h").agg(F.sum("bytes").alias("bytes"))
    sizes = stored(sizes, "op2-sizes")
    shards = max(1, -(-(sizes.agg(F.sum("bytes")).first()[0] or 0) // shard_bytes))
    hot = sizes.filter(F.col("bytes") > shard_bytes // 2).select(
        "h", (F.ceil(F.col("bytes") / (shard_bytes // 2)) + 0).cast("int").alias("spread"))
    dealt = (snips.groupBy("h", "sd", "snip").agg(F.count("*").alias("n")).join(hot, "h", "left")
             .withColumn("spread", F.coalesce("spread", F.lit(1)))
             .withColumn("salt", F.pmod("sd", "spread").cast("int"))
             .withColumn("shard", F.when(F.col("spread") > 1, F.xxhash64("h", "salt")).otherwise(F.pmod(F.xxhash64("h"), F.lit(shards)))))
    dealt = dealt.select("shard", "h", "sd", "n", "salt", "spread", "snip").repartition("shard").sortWithinPartitions("shard")
    compared = stored(dealt.mapInArrow(tidy(_compare_shards(size)), SHARD_FIELDS), "op2-compared")
    across = (compared.filter("digests is not null").select("h", "part", "digests", "places")
              .repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(tidy(_merge_shards), SHARD_FIELDS))
    repeats = compared.filter("digests is null").select("h", "sd", "firsts", "lasts").unionByName(across.select("h", "sd", "firsts", "lasts"))

    windows = snips.select("node", "h", "sd", "s1").join(repeats, ["h", "sd"]).select(
        "node", F.transform("firsts", lambda x: x + F.col("s1")).alias("firsts"), F.transform("lasts", lambda x: x + F.col("s1")).alias("lasts"))
    copies = base.filter(F.octet_length("body") >= size).groupBy("node", F.octet_length("body").alias("bytes")).agg(F.count("*").alias("n")).filter("n > 1")
    windows = windows.unionByName(copies.select("node", F.array(F.lit(0)).alias("firsts"), F.array((F.col("bytes") - size).cast("int")).alias("lasts")))
    gone = stored(windows.groupBy("node").agg(F.flatten(F.collect_list("firsts")).alias("firsts"),
                                              F.flatten(F.collect_list("lasts")).alias("lasts")), "op2-gone")

    marked = among(base, gone, "node")
    whole = marked.filter("not maybe").select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                                              F.lit(0).cast("long").alias("n_spans"), F.sha2("body", 256).alias("kept_sha256"),
                                              F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
    joined = marked.filter("maybe").select("doc_id", "node", "body").join(gone, "node", "left").select("doc_id", "body", "firsts", "lasts")

    def cut(batches):
        kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        for batch in batches:
            rows = []
            for body, firsts, lasts in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                removed, spans, left = cut_spans(body, firsts or [], lasts or [], size)
                rows.append((len(body), removed, len(spans), left, [{"start": a, "end": b} for a, b in spans]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    id_type = base.schema[0].dataType.simpleString()
    return whole.unionByName(joined.mapInArrow(
        tidy(cut), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"))
