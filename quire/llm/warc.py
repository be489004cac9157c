"""Web archives: an index is written first, then selected records are read by coalesced byte ranges.

Writing. Every task writes one archive file (``.warc.gz``, one gzip member a record) into the shared checkpoint folder and
returns one index row a record: file, offset, length, URL, payload digest. The index is stored as Parquet by Spark and is the only
thing that is read to find records. A task that is repeated after a loss writes a new file under another name; only rows of tasks that
succeeded reach the index, so what a lost task left behind is never read.

Reading. Index rows are dealt to tasks by file and stretch of the file, sorted by offset, and neighbours whose gap is small become one
byte-range read of bounded size. Each record is checked against its digest.

Identical payloads are found on digests alone: rows whose digest is surely not repeated (a bit set of fixed size tells) take part in
no shuffle, and of repeated payloads only the one that stays travels.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.bytegroups import small_batches, tidy
from quire.llm.common import among, stored
from quire.session import checkpoint_dir

#: One read takes at most so many bytes (a longer record is read alone) and skips gaps of at most so many.
READ_BYTES = 4 << 20
GAP_BYTES = 64 << 10
#: Records whose offsets lie in one stretch of a file are read by one task.
STRETCH_BYTES = 64 << 20
#: Records carry this date unless another is given: the tables have none, and equal input shall give equal archives.
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the archive format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
END = b"\r\n\r\n"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Extension fields: the page's integer id and the id of the page that a revisit refers to.
PAGE_FIELD, REFERS_FIELD = "Page-Id", "Refers-To-Page-Id"

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _field(name: str, value: str) -> bytes:
    """A header line; control characters of the value are percent-encoded, so that no value can end a line."""
    safe = re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)
    return f"{name}: {safe}\r\n".encode()


def record_id(kind: str, page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind}/{page_id}/{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None, revisit: bool, serial: str = "", date: str = DATE) -> bytes:
    """One WARC/1.1 record. A revisit carries the HTTP head only; ``serial`` keeps record ids of repeated revisits apart."""
    block = HTTP_HEAD % size + (b"" if revisit else payload or b"")
    kind = "revisit" if revisit else "response"
    head = [b"WARC/1.1\r\n", _field("WARC-Type", kind), _field("WARC-Record-ID", record_id(kind + serial, page_id, digest)), _field("WARC-Date", date)]
    if url is not None:
        head.append(_field("WARC-Target-URI", url))
    if revisit:
        head += [_field("WARC-Profile", REVISIT_PROFILE), _field("WARC-Refers-To", record_id("response", refers_to, digest))]
        if refers_to is not None:
            head.append(_field(REFERS_FIELD, str(refers_to)))
    if page_id is not None:
        head.append(_field(PAGE_FIELD, str(page_id)))
    head += [_field("WARC-Payload-Digest", "sha1:" + digest), b"Content-Type: application/http; msgtype=response\r\n", _field("Content-Length", str(len(block))), b"\r\n"]
    return b"".join([*head, block, END])


def parse_record(data: bytes) -> dict:
    """Fields of one record as a dict with ``payload`` (None for a revisit). Raises ValueError where the record is damaged."""
    cut = data.find(END)
    if not data.startswith(b"WARC/1.1\r\n") or cut < 0 or not data.endswith(END):
        raise ValueError("not a WARC/1.1 record")
    fields = dict(line.split(": ", 1) for line in data[10:cut].decode().split("\r\n"))
    block = data[cut + 4:-4]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("a record's block differs from its Content-Length")
    head = block.find(END)
    size = int(re.search(rb"Content-Length: (\d+)", block[:head])[1])
    payload, digest = block[head + 4:], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError("a payload differs from its digest")

    def number(name):
        return int(fields[name]) if name in fields else None

    return {"page_id": number(PAGE_FIELD), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"],
            "refers_to": number(REFERS_FIELD), "url": fields.get("WARC-Target-URI"), "payload": None if revisit else payload}


def _open(uri: str):
    """File system and path of a folder's URI (``file``, ``hdfs``, ``s3``, ``gs``, ...; a bare path is local)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _shared(uri: str) -> str:
    return re.sub("^file:/(?=[^/])", "file:///", uri)


def _write(folder: str, date: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, digest, size, refers_to, revisit in zip(*(batch.column(i) for i in range(7)), strict=True):
                    out = out or files.open_output_stream(f"{base}/{name}", compression=None)
                    page_id, url, refers_to = page_id.as_py(), url.as_py(), refers_to.as_py()
                    digest, revisit = base64.b32encode(digest.as_py()).decode(), revisit.as_py()
                    raw = record_bytes(page_id, url, (html.as_py() or "").encode(), digest, size.as_py(), refers_to, revisit, f"/{name}/{at}" if revisit else "", date)
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = pack.compress(raw) + pack.flush()
                    out.write(member)
                    rows.append((name, at, len(member), url, digest, page_id, "revisit" if revisit else "response"))
                    at += len(member)
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                     names=["file", "offset", "length", "url", "digest", "page_id", "record_type"])
        finally:
            if out is not None:
                out.close()
    return tidy(run)


def _records(pages: DataFrame, payload_col: str) -> DataFrame:
    """``page_id, url, html, digest, size, refers_to, revisit`` a row of ``pages``; html is null where a revisit needs none."""
    html = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
                        F.unhex(F.sha1(html.cast("binary"))).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    counted = stored(rows.groupBy("digest", "page_id").agg(F.count("*").alias("ties")), "warc-ids")
    groups = counted.groupBy("digest").agg(F.sum("ties").alias("copies"), F.max(F.struct("page_id", "ties")).alias("top")).filter("copies > 1")
    groups = stored(groups.select("digest", F.col("top.page_id").alias("top"), F.col("top.ties").alias("ties")), "warc-copies")

    # a payload travels only where it is the one that stays, or where the bit set took its digest for a repeated one
    page = F.xxhash64("digest", "page_id").alias("page")
    held = among(counted.drop("ties"), groups, "digest").filter("maybe").join(groups, "digest", "left").filter("ties is null or page_id <=> top")
    marked = among(rows, groups, "digest").withColumnRenamed("maybe", "repeated").select("*", page)
    marked = among(marked, stored(held.select(page), "warc-held"), "page")
    slim = marked.withColumn("html", F.when(F.col("maybe") | ~F.col("repeated"), F.col("html"))).drop("page", "maybe")
    alone = slim.filter("not repeated").drop("repeated").withColumns({"refers_to": F.lit(None).cast("long"), "revisit": F.lit(False)})

    met = stored(slim.filter("repeated").drop("repeated").join(groups, "digest", "left"), "warc-met")
    others = met.filter("ties is null or ties = 1 or not page_id <=> top")
    stays = F.col("ties").isNull() | F.col("page_id").eqNullSafe(F.col("top"))
    others = others.withColumns({"refers_to": F.when(~stays, F.col("top")), "revisit": ~stays})
    # rows tied at the largest id: one is the response
    tied = met.filter("page_id <=> top and ties > 1").withColumn("rank", F.row_number().over(Window.partitionBy("digest").orderBy("url")))
    tied = tied.withColumns({"refers_to": F.when(F.col("rank") > 1, F.col("top")), "revisit": F.col("rank") > 1}).withColumn(
        "html", F.when(~F.col("revisit"), F.col("html")))
    names = ["page_id", "url", "html", "digest", "size", "refers_to", "revisit"]
    return alone.select(names).unionByName(others.select(names)).unionByName(tied.select(names))


def write_archives(pages: DataFrame, folder: str | None = None, payload_col: str = "html", date: str = DATE) -> tuple[str, DataFrame]:
    """Write a record for every row of ``pages`` and return the archives' folder and the stored index (``INDEX``).

    ``pages`` has ``page_id`` (read as a long), ``url`` and ``payload_col``, whose text in UTF-8 is the payload (null: empty). Of rows
    with equal payloads, empty ones too, that with the largest page_id (nulls are least) is a ``response``, the others are ``revisit``
    records without payload that refer to it; of rows tied at that id the first by URL is the response. All other
    rows are responses. A null page_id or url leaves its field out; control characters of a URL are percent-encoded in the record
    (the index has it as it was). Very long payloads are one record each; other columns are ignored; an empty table writes no file and gives an empty index."""
    spark = pages.sparkSession
    folder = folder or f"{checkpoint_dir(spark).rstrip('/')}/quire-llm/warc-{uuid.uuid4().hex}"
    return folder, stored(_records(pages, payload_col).mapInArrow(_write(_shared(folder), date), INDEX), "warc-index")


def byte_ranges(rows: list[tuple[str, int, int]], limit: int = READ_BYTES, gap: int = GAP_BYTES) -> Iterator[list[int]]:
    """Positions of ``(file, offset, length)`` rows, sorted by file and offset, that one read takes together."""
    group: list[int] = []
    for k, (file, offset, length) in enumerate(rows):
        if group:
            first, last = rows[group[0]], rows[group[-1]]
            if file != first[0] or offset - (last[1] + last[2]) > gap or offset + length - first[1] > limit:
                yield group
                group = []
        group.append(k)
    if group:
        yield group


def _read(folder: str, payload: bool, limit: int, gap: int) -> Callable:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _open(folder)
        name, source = None, None
        try:
            for batch in batches:
                rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
                for group in byte_ranges(rows, limit, gap):
                    file, start, _ = rows[group[0]]
                    if file != name:
                        if source is not None:
                            source.close()
                        name, source = file, files.open_input_file(f"{base}/{file}")
                    block = source.read_at(rows[group[-1]][1] + rows[group[-1]][2] - start, start)
                    parsed = []
                    for k in group:
                        at = rows[k][1] - start
                        parsed.append(parse_record(zlib.decompress(block[at:at + rows[k][2]], 31)))
                        if not payload:
                            parsed[-1]["payload"] = None
                    out = pa.RecordBatch.from_arrays([pa.array([p[n] for p in parsed], k) for n, k in zip(names, kinds, strict=True)], names=names)
                    yield from small_batches(out)
        finally:
            if source is not None:
                source.close()
    return tidy(run)


def read_records(folder: str, index: DataFrame, payload: bool = True, limit: int = READ_BYTES, gap: int = GAP_BYTES) -> DataFrame:
    """The records that the rows of ``index`` (all of it or any selection, with ``file``, ``offset``, ``length``) name, as ``RECORDS``.

    Rows of one stretch of a file are sorted by offset in one task, and neighbours become one read of at most ``limit`` bytes that skips
    gaps of at most ``gap``; a longer record is read alone. A row named twice is read twice. ``payload``: whether payloads are
    returned (they are read and checked anyway). A record that is damaged or missing ends the job."""
    stretch = F.floor(F.col("offset") / STRETCH_BYTES)
    # a fixed number of tasks: an index row is small beside the record that it stands for, and would be dealt by its own size
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("file", "offset", "length", stretch.alias("stretch")).repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset")
    return dealt.drop("stretch").mapInArrow(_read(_shared(folder), payload, limit, gap), RECORDS)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives, read every record back: ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``."""
    folder, index = write_archives(pages)
    return read_records(folder, index, payload=False).drop("payload")
