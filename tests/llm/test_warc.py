"""Archives (13): exact round trip, byte ranges, repeated payloads."""

import base64
import gzip
import hashlib

import pyarrow.fs as pafs
import pytest

from quire.llm import warc

ROWS = [(1, "http://a/\r\nx", "same"), (5, "http://b", "same"), (5, "http://c", "same"), (None, None, "same"), (2, "u", None), (3, "u", ""), (None, "n", "only null"),
        (None, "n2", "only null"), (7, "ż", "zażółć\r\n\r\nWARC/1.1\r\n"), (8, "long", "payload " * 200_000), (9, "%41", "percent")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", None) for r in rows], "page_id long, url string, html string, digest int, file string, top double").repartition(4)


def expected(rows):
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    out = []
    for h, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i))
        data = h.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out += [(i, len(data), digest, "response" if k == len(ids) - 1 else "revisit", None if k == len(ids) - 1 else ids[-1]) for k, i in enumerate(ids)]
    return sorted(out, key=str)


def test_pages_come_back(spark):
    got = warc.archive_pages(pages(spark, ROWS)).drop("url").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(ROWS)


def test_payloads_index_and_files(spark):
    folder, index = warc.write_archives(pages(spark, ROWS))
    rows = index.collect()
    assert len(rows) == len(ROWS) and {r["url"] for r in rows} == {r[1] for r in ROWS}
    files, base = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    for name in {r["file"] for r in rows}:
        mine = sorted((r["offset"], r["length"]) for r in rows if r["file"] == name)
        assert mine[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:], strict=False))
        whole = files.open_input_file(f"{base}/{name}").read()
        assert sum(mine[-1]) == len(whole)
        assert gzip.decompress(whole).count(b"WARC-Record-ID") == len(mine)
    back = warc.read_records(folder, index).collect()
    assert sorted(bytes(r["payload"]) for r in back if r["payload"] is not None) == sorted({(r[2] or "").encode() for r in ROWS})
    some = warc.read_records(folder, index.filter("page_id = 8"), limit=10).collect()
    assert [(r["page_id"], r["payload_bytes"], r["url"]) for r in some] == [(8, 1_600_000, "long")]


def test_reads_are_coalesced():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 25, 10), ("a", 60, 100), ("a", 160, 10), ("b", 0, 5)]
    assert list(warc.byte_ranges(rows, limit=40, gap=5)) == [[0, 1, 2], [3], [4], [5]]
    assert list(warc.byte_ranges(rows, limit=1000, gap=100)) == [[0, 1, 2, 3, 4], [5]]
    assert list(warc.byte_ranges([])) == []


def test_hot_payload_and_false_positives_of_the_bit_set(spark, monkeypatch):
    from quire.llm import common
    monkeypatch.setattr(common, "BITS", 64)  # nearly every row is taken for a repeated one
    rows = [(i, f"u{i}", "hot" if i % 3 == 0 else f"page {i}") for i in range(300)]
    got = warc.archive_pages(pages(spark, rows)).drop("url").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)
    folder, index = warc.write_archives(pages(spark, rows))
    back = warc.read_records(folder, index).collect()
    assert {bytes(r["payload"]) for r in back if r["record_type"] == "response"} == {r[2].encode() for r in rows}


def test_no_pages(spark):
    folder, index = warc.write_archives(pages(spark, ROWS).filter("false"))
    assert index.count() == 0 and warc.read_records(folder, index).count() == 0


def test_damage_is_noticed():
    whole = warc.record_bytes(1, "u", b"text", warc.base32_sha1(b"text"), 4, None, False)
    assert warc.parse_record(whole)["payload"] == b"text"
    for bad in (whole.replace(b"text", b"tExt"), whole[:-1], whole[3:], whole.replace(b"\r\n\r\ntext", b"\r\n\r\nte")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)
