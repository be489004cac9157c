"""Reading one large JSON value or quoted CSV file with many tasks.

A JSON document that is one array, or a CSV file with line breaks inside quotes, has no byte that surely ends a record, so Spark's own
readers give such a file to one task. Here a file is cut into stretches of equal size. A first pass sums up every stretch without knowing where it
begins: how many quotes it holds, and what it does to the nesting depth if it begins outside or inside a string. A prefix over the stretches of
a file (a few numbers a stretch) then tells each stretch its first state, and a second pass returns the records that begin in it, as
text; the last one is read on beyond the stretch's end. Parsing is left to Spark (``from_json``, ``from_csv``) with a declared schema.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STRETCH = 8 << 20
QUOTE, ESCAPE, NEWLINE = 34, 92, 10
OPEN, CLOSE, BRACE = (91, 123), (93, 125), 123

STRETCHES = "file string, length long, stretch long, stretches long"
SUMMARY = STRETCHES + ", quotes long, delta0 long, delta1 long, starts0 map<long,long>, starts1 map<long,long>"
STATES = "file string, stretch long, length long, inside long, depth long, before long"
RECORDS = "file string, stretch long, idx long, value string"


def _open(file: str):
    uri = re.sub("^file:/(?=[^/])", "file:///", file)
    files, path = pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)
    return files.open_input_file(path)


def _escaped(source, at: int, json: bool) -> bool:
    """Whether the byte at ``at`` follows an odd number of backslashes."""
    n, step = 0, 64
    while json and at - n > 0:
        lo = max(0, at - n - step)
        back = source.read_at(at - n - lo, lo)
        run = len(back) - len(back.rstrip(b"\\"))
        n += run
        if run < len(back):
            break
        step *= 2
    return n % 2 == 1


def _quotes(buf: np.ndarray, escaped: bool, json: bool) -> np.ndarray:
    """Which bytes are quotes that open or close a string."""
    quote = buf == QUOTE
    if json and quote.any():
        back = buf == ESCAPE
        if back.any() or escaped:
            place = np.arange(len(buf))
            last = np.maximum.accumulate(np.where(back, -1, place))  # the last byte that is no backslash
            at = np.flatnonzero(quote)
            run = at - 1 - np.where(at > 0, last[at - 1], -1)
            run = np.where(at == 0, 0, run) + np.where((at == 0) | (last[at - 1] < 0), int(escaped), 0)
            quote[at[run % 2 == 1]] = False
    return quote


def _states(buf: np.ndarray, quote: np.ndarray, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Opening brackets and closing brackets outside strings, and the depth after each byte."""
    in_string = (np.cumsum(quote) + inside) % 2 == 1
    opened = ((buf == OPEN[0]) | (buf == OPEN[1])) & ~in_string
    closed = ((buf == CLOSE[0]) | (buf == CLOSE[1])) & ~in_string
    return opened, closed, depth + np.cumsum(opened.astype(np.int32) - closed.astype(np.int32))


def _summed(source, start: int, end: int, json: bool) -> tuple:
    buf = np.frombuffer(source.read_at(end - start, start), np.uint8)
    quote = _quotes(buf, _escaped(source, start, json), json)
    out: list = [int(quote.sum())]
    deltas, starts = [], []
    for inside in (0, 1):
        if json:
            opened, _, depth = _states(buf, quote, inside, 0)
            at = depth[opened & (buf == BRACE)] - 1
        else:  # a record begins after every line break outside quotes
            depth, at = np.zeros(1, np.int64), np.zeros(int(((buf == NEWLINE) & ((np.cumsum(quote) + inside) % 2 == 0)).sum()), np.int64)
        level, n = np.unique(at, return_counts=True)
        deltas.append(int(depth[-1]) if len(depth) else 0)
        starts.append(list(zip(level.tolist(), n.tolist(), strict=True)))
    return (*out, *deltas, *starts)


def _summaries(json: bool, stretch: int):
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.int64(), pa.int64()), pa.map_(pa.int64(), pa.int64())]
    names = [f.split()[0] for f in re.split(r", (?=\w+ )", SUMMARY)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length, k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _open(file) as source:
                    row = (file, length, k, n, *_summed(source, k * stretch, min(length, (k + 1) * stretch), json))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)
    return run


def _prefix(json: bool, level: int | None):
    """First state of each stretch of one file, and how many records begin before it."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        inside, depth, before, out = 0, 0, 0 if json else 1, []
        for r in rows.sort_values("stretch").itertuples(index=False):
            out.append((r.file, r.stretch, r.length, inside, depth, before))
            starts = dict((r.starts0, r.starts1)[inside] or {})
            before += int(starts.get((level or 0) - depth, 0))
            depth += int((r.delta0, r.delta1)[inside])
            inside = (inside + int(r.quotes)) % 2
        return pd.DataFrame(out, columns=["file", "stretch", "length", "inside", "depth", "before"])
    return run


def _rest(source, at: int, length: int, json: bool, inside: int, depth: int, level: int, piece: int) -> int:
    """End of the record that goes on at ``at``."""
    while at < length:
        buf = np.frombuffer(source.read_at(min(piece, length - at), at), np.uint8)
        quote = _quotes(buf, _escaped(source, at, json), json)
        if json:
            _, closed, after = _states(buf, quote, inside, depth)
            ends = np.flatnonzero(closed & (after == level))
            depth = int(after[-1])
        else:
            ends = np.flatnonzero((buf == NEWLINE) & ((np.cumsum(quote) + inside) % 2 == 0))
        if len(ends):
            return at + int(ends[0]) + 1
        inside = (inside + int(quote.sum())) % 2
        at += len(buf)
    if json:
        raise ValueError("the JSON value ends inside a record")
    return length


def _stretch_records(source, k: int, length: int, inside: int, depth: int, json: bool, level: int, stretch: int) -> Iterator[bytes]:
    start, end = k * stretch, min(length, (k + 1) * stretch)
    data = source.read_at(end - start, start)
    buf = np.frombuffer(data, np.uint8)
    quote = _quotes(buf, _escaped(source, start, json), json)
    if json:
        opened, closed, after = _states(buf, quote, inside, depth)
        begins = np.flatnonzero(opened & (buf == BRACE) & (after == level + 1))
        ends = np.flatnonzero(closed & (after == level)) + 1
        ends = ends[np.searchsorted(ends, begins, side="right")[:len(begins)].clip(max=len(ends) - 1)] if len(ends) else np.zeros(len(begins), np.int64)
        last_depth = int(after[-1]) if len(after) else depth
    else:
        breaks = np.flatnonzero((buf == NEWLINE) & ((np.cumsum(quote) + inside) % 2 == 0)) + 1
        begins = np.concatenate(([0], breaks)) if k == 0 else breaks
        ends = np.append(breaks if k == 0 else breaks[1:], 0)[:len(begins)]
        last_depth = 0
    last_inside = (inside + int(quote.sum())) % 2
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        if b > a:
            yield data[a:b]
        elif start + a < length:
            upto = _rest(source, end, length, json, last_inside, last_depth, level, stretch)
            yield data[a:] + source.read_at(upto - end, end)


def _records(json: bool, level: int | None, stretch: int):
    def batch_of(rows):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file", "stretch", "idx", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, k, length, inside, depth, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                with _open(file) as source:
                    first = before if json or k else 0
                    for n, value in enumerate(_stretch_records(source, k, length, inside, depth, json, level or 0, stretch)):
                        rows.append((file, k, first + n, value.decode("utf-8")))
                        held += len(value)
                        if held > stretch:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)
    return run


def _read(spark: SparkSession, path, json: bool, level: int | None, stretch: int) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").filter("length > 0")
    n = F.ceil(F.col("length") / stretch)
    cut = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("stretch"), n.alias("stretches"))
    total = files.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    tasks = int(max(1, min(total, 100_000)))  # rows are small beside the stretches they stand for: the number of tasks is given, not measured
    summed = cut.repartition(tasks, "file", "stretch").mapInArrow(_summaries(json, stretch), SUMMARY)
    states = summed.groupBy("file").applyInPandas(_prefix(json, level), STATES)  # a row a stretch of one file
    return states.repartition(tasks, "file", "stretch").mapInArrow(_records(json, level, stretch), RECORDS)


def json_records(spark: SparkSession, path, depth: int = 1, stretch: int = STRETCH) -> DataFrame:
    """``file, stretch, idx, value``: the JSON objects that stand at nesting ``depth`` of the files, as text, numbered within their file.

    Depth 1: elements of a file that is one array; 0: objects that follow one another (JSON lines too); 2: elements of arrays that
    are values of a file that is one object. A file is read by a task a stretch, twice. Files must be UTF-8; a file that ends inside a
    record is an error; an empty file has no records."""
    return _read(spark, path, True, depth, stretch)


def csv_records(spark: SparkSession, path, stretch: int = STRETCH) -> DataFrame:
    """``file, stretch, idx, value``: records of CSV files whose quoted fields may hold line breaks (a quote inside a field is doubled), with the
    header, if there is one, as record 0 of each file. Blank lines are records too."""
    return _read(spark, path, False, None, stretch)
