"""Best-fit packing of tokenised documents into sequences of bounded length.

Hierarchical residual packing. A task tokenises its documents, cuts only those that are longer than
a sequence, and packs the pieces best-fit in order of falling length. Bins that are nearly full are
final. The others become items of a next round: fewer tasks merge the bins of several former tasks, again
best-fit, and so on up a tree until one task has seen what is left or a round stops closing the gap.
A round's tasks get at most ``ROWS_PER_TASK`` rows on average, so no task grows with the input; only
underfull bins travel, and they carry lengths and checksums, not tokens.

Tokenising is exact but avoids the tokenizer's per-call work: its words never reach across a blank,
so texts are split at blanks and line ends, every distinct chunk is encoded once per worker and kept in a bounded
table. New chunks are split into words all at once, and a word is encoded once, whatever the chunks around it. Chunks
outside the Latin blocks go through the tokenizer itself.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from itertools import chain, compress, count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.bytegroups import byte_groups, tidy
from quire.llm.common import stored

CAPACITY = 2048
END_OF_DOCUMENT = 0
NEARLY_FULL = 8  # tokens that a final bin may lack
ROWS_PER_TASK = 200_000
FAN_IN = 8
MAX_CHUNKS = 200_000  # distinct chunks and words a worker remembers
KEPT_CHUNKS = 30_000  # of them the most frequent, from task to task
LONG_CHUNK = 1_000_000  # longer chunks are left to the tokenizer
SLICE_CHARS = 2_000_000  # longer texts are encoded in slices cut at a blank

# How the tokenizer's pre-tokenizer splits normalised text.
WORD_PATTERN = regex.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")  # and the blanks between chunks
LATIN = regex.compile("[\x20-\x7e\xa1-\xac\xae-\u012f\u0131-\u017f]+")
BEYOND_LATIN = re.compile("[^\x00-\u012f\u0131-\u017f]")


def byte_characters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _numbered(names: list[str]) -> defaultdict:
    """The names' places; a name that is looked up for the first time gets the next number and stays."""
    return defaultdict(count(len(names)).__next__, zip(names, range(len(names)), strict=True))


class ChunkEncoder:
    """Ids of whole texts, chunk by chunk, equal to the tokenizer's.

    Chunks and the words they are made of share one index; number n has the ids ``flat[start[n]:start[n] + size[n]]``."""

    def __init__(self, path: str, max_chunks: int = MAX_CHUNKS, slice_chars: int = SLICE_CHARS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.max_chunks, self.slice_chars = max_chunks, slice_chars
        alphabet = byte_characters()
        self.spell = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(0x180)}
        self._clear()

    def _clear(self) -> None:
        self.index = _numbered(["", " "])  # without ids; the blank stands between chunks in _learn
        self.flat, self.start, self.size = np.zeros(0, "<u4"), np.zeros(2, np.int64), np.zeros(2, np.int64)
        self.uses = np.zeros(2, np.int64)

    def shrink(self, most: int) -> None:
        """Forget all but the chunks and words that were met most often, about ``most`` of them."""
        most = max(1, min(len(self.uses), most))
        limit = max(2, int(np.partition(self.uses, -most)[-most]) + 1)
        keep = self.uses >= limit
        keep[:2] = True
        self.index = _numbered(list(compress(self.index, keep.tolist())))
        kept = np.flatnonzero(keep)
        self.flat, ends = self._ids(kept)
        self.size = self.size[kept]
        self.start = ends - self.size
        self.uses = self.uses[kept] // 2

    def _ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks or words one after the other, and where each one's end."""
        size = self.size[numbers]
        ends = np.cumsum(size)
        take = np.repeat(self.start[numbers] - (ends - size), size)
        take += np.arange(len(take))
        return self.flat[take], ends

    def _store(self, numbers: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.start[numbers] = len(self.flat) + np.cumsum(sizes) - sizes
        self.size[numbers] = sizes
        self.flat = np.concatenate((self.flat, ids.astype("<u4")))

    def _room(self) -> None:
        more = np.zeros(len(self.index) - len(self.start), np.int64)
        self.start, self.size, self.uses = (np.concatenate((x, more)) for x in (self.start, self.size, self.uses))

    def _learn(self, new: list[str]) -> None:
        """Ids of the chunks that the index has just numbered: all are split into words by one expression, new words go
        through the model once, chunks of other words are put together. What is not Latin is left to the tokenizer."""
        base = len(self.start)
        numbers, plain, line = np.arange(base, base + len(new)), new, " ".join(new)
        if len(line) > LONG_CHUNK or not LATIN.fullmatch(line):
            fit = np.array([len(c) <= LONG_CHUNK and LATIN.fullmatch(c) is not None for c in new])
            found = [self.tokenizer.encode(c, add_special_tokens=False).ids for c, f in zip(new, fit, strict=True) if not f]
            self._room()
            self._store(numbers[~fit], np.array([len(f) for f in found], np.int64), np.array([x for f in found for x in f], "<u4"))
            numbers, plain = numbers[fit], [c for c, f in zip(new, fit, strict=True) if f]
            line = " ".join(plain)
        if not plain:
            return
        parts = WORD_PATTERN.findall(line.lower())
        part = np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))
        self._room()
        met = np.bincount(part, minlength=len(self.uses))
        met[:2] = 0
        self.uses += met

        names = new + _last(self.index, len(self.index) - base - len(new))
        words = np.unique(part[part >= base])
        tokenize, spell = self.model.tokenize, self.spell
        found = [tokenize(w if w.isascii() else w.translate(spell)) for w in (names[i] for i in (words - base).tolist())]
        self._store(words, np.array([len(f) for f in found], np.int64), np.array([t.id for f in found for t in f], "<u4"))

        chunk = np.cumsum(part == 1)
        own = np.isin(numbers, words)  # the chunk is one new word
        rest = ~own[chunk]
        sizes = np.bincount(chunk[rest], self.size[part[rest]], len(numbers)).astype(np.int64)
        self._store(numbers[~own], sizes[~own], self._ids(part[rest])[0])

    def _slices(self, text: str) -> list[str]:
        out, at = [], 0
        while len(text) - at > self.slice_chars:
            cut = text.find(" ", at + self.slice_chars)
            if cut < 0:
                break
            out.append(text[at:cut])
            at = cut
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        chunks, plain = [], []
        for i, t in enumerate(texts):
            if "<|" in t:  # may hold a special token
                parts = [self.tokenizer.encode(s, add_special_tokens=False).ids for s in self._slices(t)]
                out[i] = np.array([x for p in parts for x in p], "<u4")
            elif len(t) > self.slice_chars:
                out[i] = np.concatenate([self._chunked([_chunks(s)])[0] for s in self._slices(t)])
            else:
                chunks.append(_chunks(t))
                plain.append(i)
        for i, ids in zip(plain, self._chunked(chunks), strict=True):
            out[i] = ids
        return out

    def _chunked(self, texts: list[list[str]]) -> list[np.ndarray]:
        if not texts:
            return []
        if len(self.index) > self.max_chunks:
            self.shrink(self.max_chunks // 3)
        flat_chunks = list(chain.from_iterable(texts))
        before = len(self.index)
        try:
            at = np.fromiter(map(self.index.__getitem__, flat_chunks), np.int64, len(flat_chunks))
            if len(self.index) > before:
                self._learn(_last(self.index, len(self.index) - before))
        except BaseException:  # no number may stay without its ids
            self._clear()
            raise
        self.uses += np.bincount(at, minlength=len(self.uses))
        ids, ends = self._ids(at)
        text_ends = np.concatenate(([0], ends))[np.cumsum([len(t) for t in texts], dtype=np.int64)]
        return np.split(ids, text_ends[:-1])


def _last(index: dict[str, int], n: int) -> list[str]:
    """The ``n`` names numbered last, in order."""
    return list(islice(reversed(index), n))[::-1]


def _chunks(text: str) -> list[str]:
    """The text's parts between blanks and line ends; in lower case where that is safe to do first."""
    if text.isascii() or not BEYOND_LATIN.search(text):
        text = text.lower()
    return text.replace("\n", " ").split(" ")


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder_for(path: str) -> ChunkEncoder:
    """One encoder for each worker process, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin: items by falling size, each into the bin it fills best."""
    bins, offsets, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has exactly r tokens of room
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def _pieces(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    ids = np.append(ids, np.uint32(END_OF_DOCUMENT)).astype("<u4")
    return [(k, a, min(capacity, len(ids) - a), zlib.crc32(ids[a:a + capacity].tobytes()), ids[a:a + capacity])
            for k, a in enumerate(range(0, len(ids), capacity))]


def _names(round_no: int, bins: np.ndarray) -> np.ndarray:
    return (round_no << 56) + (TaskContext.get().partitionId() << 32) + bins


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, text_col: str = "text",
                   nearly_full: int = NEARLY_FULL, rows_per_task: int = ROWS_PER_TASK, with_ids: bool = False) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    A document is its token ids and a closing 0; only documents longer than ``capacity`` are cut. The
    pieces of a sequence lie without gaps from offset 0. Null or empty text is the closing 0 alone;
    repeated rows are packed each; ids may be null; ties in length go by row order; an empty table
    gives an empty result; other columns are ignored."""
    source = docs.select("doc_id", F.col(text_col).cast("string").alias("__text"))
    id_type = source.schema[0].dataType.simpleString()
    fields = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, open boolean"
    fields += ", ids array<long>" if with_ids else ""

    def tokenise(batches):
        encoder = encoder_for(tokenizer_path)
        ids_of_docs, rows, kept = [], [], []
        for batch in batches:
            for first, raw in byte_groups(batch.column(1), 1 << 20):
                texts = [t.decode("utf-8", "replace") for t in raw]
                here = []
                for n, ids in enumerate(encoder.encode(texts)):
                    for k, a, size, crc, part in _pieces(ids, capacity):
                        here.append((first + n, k, a, size, crc))
                        if with_ids:
                            kept.append(part)
                rows.append(np.array([h[1:] for h in here], np.int64).reshape(-1, 4))
                ids_of_docs.append(batch.column(0).take(pa.array([h[0] for h in here], pa.int64())))
        encoder.shrink(KEPT_CHUNKS)
        if not rows:
            return
        cols = np.concatenate(rows)
        bins, offsets, fills = best_fit(cols[:, 2], capacity)
        out = [pa.chunked_array(ids_of_docs).combine_chunks(), pa.array(cols[:, 0].astype(np.int32)), pa.array(cols[:, 1]), pa.array(cols[:, 2]),
               pa.array(cols[:, 3]), pa.array(_names(0, bins)), pa.array(offsets), pa.array(fills[bins] < capacity - nearly_full)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "open"]
        if with_ids:
            out.append(pa.array([k.astype(np.int64) for k in kept], pa.list_(pa.int64())))
            names.append("ids")
        yield from pa.table(out, names=names).to_batches(max_chunksize=50_000)

    def merge_round(round_no):
        def merge(batches):
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            t = pa.Table.from_batches(held).combine_chunks()
            _, item = np.unique(t["sequence_id"].to_numpy(), return_inverse=True)
            bins, offsets, fills = best_fit(np.bincount(item, t["length"].to_numpy()).astype(np.int64), capacity)
            row_bin = bins[item]
            for name, values in (("sequence_id", _names(round_no, row_bin)), ("offset", t["offset"].to_numpy() + offsets[item]),
                                 ("open", fills[row_bin] < capacity - nearly_full)):
                t = t.set_column(t.column_names.index(name), name, pa.array(values))
            yield from t.to_batches(max_chunksize=50_000)
        return merge

    rows = stored(source.mapInArrow(tidy(tokenise), fields), "op3-round0")
    final, round_no, tasks, before = [rows.filter("not open")], 0, None, None
    while True:
        left = rows.filter("open")
        n_rows, n_bins = left.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        tasks = -(-max(n_rows, 1) // rows_per_task) if tasks is None else max(-(-n_rows // rows_per_task), -(-tasks // FAN_IN))
        if n_bins <= 1 or (before is not None and (n_bins > 0.99 * before)) or round_no > 100:
            final.append(left)
            break
        round_no, before = round_no + 1, n_bins
        rows = stored(left.repartition(tasks, "sequence_id").mapInArrow(tidy(merge_round(round_no)), fields), f"op3-round{round_no}")
        final.append(rows.filter("not open"))
    out = final[0]
    for f in final[1:]:
        out = out.unionByName(f)
    return out.drop("open")
