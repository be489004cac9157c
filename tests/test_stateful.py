"""De-duplicating ingest with state: restart, expiry, company and the last short batch."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quire.streaming import ingest, stateful
from sample_dirs import SF001

SCHEMA = "doc_id long, text string"


def add(spark, src, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)


def stored(spark, out):
    return sorted((r.doc_id, r.text) for r in spark.read.schema(SCHEMA).parquet(*[f"{out}/{d}" for d in os.listdir(out)]).collect())


def run(spark, tmp_path, out="out", **options):
    stream = ingest.stream_documents(spark, str(tmp_path / "in"), SCHEMA)
    stateful.ingest_first_copies(stream, str(tmp_path / out), str(tmp_path / "ck"), buckets=4, **options).awaitTermination(200)
    return stored(spark, str(tmp_path / out))


def test_restart_remembers(spark, tmp_path):
    src = str(tmp_path / "in")
    add(spark, src, [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None), (6, "")])
    want = [(1, "a"), (2, "b"), (4, None), (6, "")]
    assert sorted(run(spark, tmp_path), key=str) == sorted(want, key=str)
    add(spark, src, [(7, "b"), (8, "c"), (0, "a")])
    assert sorted(run(spark, tmp_path), key=str) == sorted([*want, (8, "c")], key=str)
    # a lost commit: the last epoch runs again from its own version of the state and overwrites its folder
    last = max((f for f in os.listdir(tmp_path / "ck/commits") if not f.startswith(".")), key=int)
    for f in (last, f".{last}.crc"):
        if os.path.exists(tmp_path / "ck/commits" / f):
            os.replace(tmp_path / "ck/commits" / f, tmp_path / f)
    assert sorted(run(spark, tmp_path), key=str) == sorted([*want, (8, "c")], key=str)


def test_digests_expire(spark, tmp_path):
    src = str(tmp_path / "in")
    add(spark, src, [(1, "a"), (2, "b")])
    assert run(spark, tmp_path, ttl=1500) == [(1, "a"), (2, "b")]
    time.sleep(2)
    add(spark, src, [(3, "a")])
    assert run(spark, tmp_path, ttl=1500) == [(1, "a"), (2, "b"), (3, "a")]


def test_short_chunks_wait_and_leave_in_time(spark, tmp_path):
    src = str(tmp_path / "in")
    add(spark, src, [(1, "a"), (2, "b")])
    stream = ingest.stream_documents(spark, src, SCHEMA)
    out = str(tmp_path / "out")
    q = stateful.ingest_first_copies(stream, out, str(tmp_path / "ck"), trigger="200 milliseconds", buckets=1, min_docs=3, max_wait="6 seconds")
    try:
        def wait_for(n, seconds):
            end = time.time() + seconds
            while time.time() < end:
                if q.exception() is not None:
                    raise q.exception()
                if os.path.isdir(out) and len(stored(spark, out)) >= n:
                    return stored(spark, out)
                time.sleep(0.3)
            return stored(spark, out)
        assert wait_for(2, 60) == [(1, "a"), (2, "b")]  # no batch with data follows: the timer hands the short chunk on
        add(spark, src, [(3, "c"), (4, "d"), (5, "e"), (6, "a")])
        assert wait_for(5, 60) == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e")]
    finally:
        q.stop()
        q.awaitTermination(60)
    chunks = spark.read.schema(SCHEMA + ", bucket int, chunk long").parquet(*[f"{out}/{d}" for d in os.listdir(out)])
    sizes = {r["chunk"]: r["count"] for r in chunks.groupBy("chunk").count().collect()}
    assert sizes == {0: 2, 1: 3}


def test_first_copies_of_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    docs.repartition(1).write.parquet(str(tmp_path / "in"))
    want = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")
    assert run(spark, tmp_path) == sorted((r.doc_id, r.text) for r in want.collect())


def test_time_spans():
    assert stateful.milliseconds("10 minutes") == 600_000 and stateful.milliseconds("1 day") == 86_400_000 and stateful.milliseconds(5) == 5
    assert stateful.milliseconds(None) is None
    with pytest.raises(ValueError):
        stateful.milliseconds("soon")
