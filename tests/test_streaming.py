"""Streaming ingest and scoring on a copy of the documents table split into several files."""

from pyspark.sql import functions as F

from quire.operators import score as S
from quire.streaming import ingest

from sample_dirs import SF001


def _split_input(spark, tmp_path):
    src = str(tmp_path / "in")
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "lang", "text")
    docs.repartition(4, "doc_id").write.parquet(src)
    return src, docs


def test_dedup_ingest_matches_batch(spark, tmp_path):
    src, docs = _split_input(spark, tmp_path)
    stream = ingest.cleaned(ingest.stream_documents(spark, src, "doc_id long, lang string, text string"))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = ingest.dedup_ingest(stream, out, ck)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    from quire.operators.corpus import clean_texts, dedup_keep_first

    want = dedup_keep_first(clean_texts(docs), ["text"], "doc_id")
    # each distinct cleaned text is stored exactly once
    assert got.count() == want.count() == got.select("text").distinct().count()


def test_score_stream(spark, tmp_path):
    src, docs = _split_input(spark, tmp_path)
    stream = ingest.stream_documents(spark, src, "doc_id long, lang string, text string")
    out, ck = str(tmp_path / "scored"), str(tmp_path / "ck2")
    q = ingest.score_stream(stream, S.length_loader, "text", "n_chars long", out, ck)
    q.awaitTermination(300)
    got = spark.read.parquet(out)
    assert got.count() == docs.count()
    assert got.filter(F.col("n_chars") != F.length("text")).count() == 0


def test_metric_registry(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (1, 1), (0, 0)], "label int, pred int")
    r = S.compute_metrics(df, ["acc", "mcc"]).first()
    assert abs(r.acc - 0.75) < 1e-9


def test_event_dedup_within_watermark(spark, tmp_path):
    from sample_dirs import SF001

    src = str(tmp_path / "ev")
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    ev.unionByName(ev).repartition(3).write.parquet(src)  # every event twice
    stream = spark.readStream.schema(ev.schema).parquet(src)
    out = ingest.dedup_events_within_watermark(stream, ["event_id"], "ts", "1 hour")
    q = out.writeStream.format("memory").queryName("ev_dedup").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = spark.sql("select * from ev_dedup")
    assert got.count() == ev.count() == got.select("event_id").distinct().count()


def _folders(spark, tmp_path, parts):
    """One file for each list of documents, in order of time."""
    import os

    src = str(tmp_path / "in")
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
        for f in os.listdir(src):
            if f.endswith(".parquet"):
                path = os.path.join(src, f)
                if os.stat(path).st_mtime > 1e9 + 1000:
                    os.utime(path, (1e9 + i, 1e9 + i))
    return src


def test_small_batches_are_carried_over(spark, tmp_path):
    src = _folders(spark, tmp_path, [[(1, "a")], [(2, "b")], [(3, "c"), (4, "a")], [(5, "d")]])
    out = str(tmp_path / "out")
    stream = ingest.stream_documents(spark, src, "doc_id long, text string")
    ingest.dedup_ingest(stream, out, str(tmp_path / "ck"), min_docs=3).awaitTermination(300)
    # the third batch reaches the minimum together with the rows of the first two; the fourth waits
    assert {(r.doc_id, r.text) for r in spark.read.parquet(out).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    waiting = spark.read.parquet(out + "_carried")
    last = waiting.agg(F.max("epoch")).first()[0]
    assert [r.doc_id for r in waiting.filter(F.col("epoch") == last).collect()] == [5]


def test_retried_epoch_and_failing_read(spark, tmp_path):
    import pytest

    src = _folders(spark, tmp_path, [[(1, "a"), (2, "b")], [(3, "a"), (4, "c")]])
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    stream = ingest.stream_documents(spark, src, "doc_id long, text string")
    ingest.dedup_ingest(stream, out, ck).awaitTermination(300)
    want = {(1, "a"), (2, "b"), (4, "c")}
    assert {(r.doc_id, r.text) for r in spark.read.parquet(out).collect()} == want
    # a lost commit: the last epoch runs again and overwrites its own folders
    import os

    last = sorted(os.listdir(ck + "/commits"), key=lambda f: (len(f), f))[-1]
    for f in (last, f".{last}.crc"):
        if os.path.exists(f"{ck}/commits/{f}"):
            os.replace(f"{ck}/commits/{f}", str(tmp_path / f))
    ingest.dedup_ingest(stream, out, ck).awaitTermination(300)
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(out).collect()) == sorted(want)
    # a digest table that cannot be read fails the batch instead of writing duplicates
    spark.createDataFrame([(9, "a")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    broken = f"{out}_digests/epoch=0"
    for d, _, files in os.walk(broken):
        for f in files:
            if f.endswith(".parquet"):
                with open(os.path.join(d, f), "wb") as h:
                    h.write(b"not parquet")
            elif f.endswith(".crc"):
                os.replace(os.path.join(d, f), str(tmp_path / ("x" + f)))
    with pytest.raises(Exception):
        ingest.dedup_ingest(stream, out, ck).awaitTermination(300)
    assert sorted((r.doc_id, r.text) for r in spark.read.parquet(out).collect()) == sorted(want)
