"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's words.

Items and documents are normalised alike (A-Z lower-cased, words joined by single spaces). A window is 13 consecutive words of an item, or the
whole item if it has fewer. Every window of 13 words holds one of the item's blocks of 7 words that begin at words 0, 7, 14, ..., so the blocks
are the automaton's patterns, which has about as many nodes as the benchmark has characters; whole shorter items are patterns too. A
document is scanned once; where a block occurs, the windows around it are looked up in a table of all windows, which keeps exactly the
true ones. Word numbers give offsets in the original text.
There is no shuffle: documents are judged where they are read.

The benchmark is the one side that is sent to every task, so its size is measured first: it goes out in parts of about ``PART_BYTES``, usually
one. With more parts the documents pass by once a part, written in between, and carry the places and items found so far, so that the result is the
same whatever the parts are. A part's patterns are grouped into automata of at most ``AUTOMATON_CHARS`` pattern characters, so that a
worker's memory stays bounded; usual benchmarks need one automaton.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bytegroups import small_batches, tidy
from quire.llm.common import stored
from quire.llm.wordscan import automaton, line_of, starts_in, texts_of, word_spans, words_of

WINDOW = 13
PART_BYTES = 16 << 20
AUTOMATON_CHARS = 2_000_000

RESULT = ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "items array<string>, hit_spans array<struct<start:int,end:int>>")

_CACHE: dict[str, tuple] = {}


def windows(words: list[bytes], n: int) -> list[str]:
    if not words:
        return []
    return [line_of(words[i:i + n]) for i in range(max(1, len(words) - n + 1))]


def _index(items: list[tuple[str, str]], n: int, chars: int) -> tuple[dict[str, set[str]], list]:
    """The items of every window, and automata over disjoint sets of patterns; a value is (words, whether a block, whether a whole item)."""
    owners: dict[str, set[str]] = {}
    patterns: dict[str, tuple[int, bool, bool]] = {}
    block = (n + 1) // 2
    for item_id, text in items:
        words = words_of(text)
        for w in windows(words, n):
            owners.setdefault(w, set()).add(item_id)
        if len(words) >= n:
            for i in range(0, len(words) - block + 1, block):
                key = line_of(words[i:i + block])
                patterns[key] = (block, True, patterns.get(key, (0, False, False))[2])
        elif words:
            key = line_of(words)
            patterns[key] = (len(words), patterns.get(key, (0, False, False))[1], True)
    out, part, size = [], {}, 0
    for w, value in patterns.items():
        part[w] = value
        size += len(w)
        if size >= chars:
            out.append(automaton(part))
            part, size = {}, 0
    return owners, out + [automaton(part)] if part else out


def _found(words: list[bytes], index: tuple[dict[str, set[str]], list], n: int) -> tuple[list[tuple[int, int]], set[str]]:
    """Runs of hit words (end exclusive) and the items of the windows that occur."""
    owners, automata = index
    line = line_of(words)
    places = [(end, value) for a in automata for end, value in a.iter(line)]
    if not places:
        return [], set()
    runs, items, tried = [], set(), set()
    for end, (_, (k, block, whole)) in zip(starts_in(line, [e for e, _ in places]).tolist(), places, strict=True):  # the space after a pattern opens word number ``end``
        at = end - k
        if whole:
            runs.append((at, end))
            items |= owners[line_of(words[at:end])]
        if block:
            for i in range(max(0, end - n), min(at, len(words) - n) + 1):
                if i not in tried:
                    tried.add(i)
                    mine = owners.get(line_of(words[i:i + n]))
                    if mine:
                        runs.append((i, i + n))
                        items |= mine
    return (_joined(runs, len(words)) if runs else []), items


def _joined(runs: list[tuple[int, int]], n_words: int) -> list[tuple[int, int]]:
    """Maximal runs of the words that ``runs`` cover."""
    edge = np.zeros(n_words + 1, np.int64)
    a, b = np.array(runs, np.int64).reshape(-1, 2).T
    np.add.at(edge, a, 1)
    np.add.at(edge, b, -1)
    turn = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]))))
    return list(zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True))


def _verdict(text: str, n_words: int, runs: list[tuple[int, int]], items: set[str]) -> tuple:
    n_hit, names, spans = sum(b - a for a, b in runs), sorted(items), []
    if runs:
        places = word_spans(text)
        spans = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in runs]
    return (n_words, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words, names, spans)


RUNS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, boxed: str | None = None,
                       text_col: str = "text", automaton_chars: int = AUTOMATON_CHARS, part_bytes: int = PART_BYTES) -> DataFrame:
    """``doc_id`` (or the column ``boxed``, a struct that has the text) of each row of ``docs`` with ``n_words, n_hit, n_items, items_sha256,
    contaminated, items, hit_spans`` (code point offsets of hit runs).

    A document is contaminated if a word is hit and hit words are at least 5 % of its words. Null
    or empty text has no words and is clean; a null or wordless item has no window; an item without
    id counts under the empty id; equal ids count once; repeated rows are judged each; a very long text is scanned whole; an empty table gives an
    empty result and an empty benchmark marks nothing; other columns are ignored."""
    spark = docs.sparkSession
    wanted = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    first = boxed or "doc_id"
    source = docs.select(boxed) if boxed else docs.select("doc_id", F.col(text_col).cast("string").alias("__text"))
    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields)

    def scan(shared, key: str, last: bool):
        def run(batches):
            if key not in _CACHE:
                _CACHE.clear()
                _CACHE[key] = _index(shared.value, window, automaton_chars)
            index = _CACHE[key]
            for batch in batches:
                texts = texts_of(batch.column(0).field(text_col) if boxed else batch.column(1))
                n = batch.num_rows
                carried = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__runs", "__items")] if "__runs" in batch.schema.names else [[[]] * n, [[]] * n]
                rows = []
                for text, runs, items in zip(texts, *carried, strict=True):
                    words = words_of(text)
                    more, owners = _found(words, index, window)
                    runs = _joined([(r["a"], r["b"]) for r in runs] + more, len(words)) if runs else more
                    items = owners.union(items)
                    rows.append(_verdict(text, len(words), runs, items) if last else ([{"a": a, "b": b} for a, b in runs], sorted(items)))
                if last:
                    kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
                    kept, names = [batch.column(0)], [first, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "hit_spans"]
                else:
                    kinds = [RUNS, pa.list_(pa.string())]
                    kept = batch.columns[:len(source_names)]
                    names = [*source_names, "__runs", "__items"]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
                yield from small_batches(pa.RecordBatch.from_arrays(kept + [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names))
        return tidy(run)

    source_names = source.columns
    rows = source
    for part in range(parts):
        mine = wanted if parts == 1 else wanted.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part)
        items = [(r[0], r[1]) for r in mine.collect()]
        key = hashlib.sha256(repr((sorted(items), window, automaton_chars)).encode()).hexdigest()
        last = part == parts - 1
        out = f"{first} {source.schema[0].dataType.simpleString()}, {RESULT}" if last else f"{head}, __runs array<struct<a:long,b:long>>, __items array<string>"
        rows = rows.mapInArrow(scan(spark.sparkContext.broadcast(items), key, last), out)
        if not last:
            rows = stored(rows, "contamination-part")
    return rows


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The clean rows of ``docs`` with all their columns; rows travel inside one struct, so no join."""
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    marked = mark_contamination(boxed, benchmark, window, boxed="__row")
    return marked.filter(~F.col("contaminated")).select("__row.*")
