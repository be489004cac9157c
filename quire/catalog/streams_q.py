"""Streams over the given tables (X1, X3, X4, X5), run until they have taken what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.catalog.files_q import folder
from quire.catalog.registry import register
from quire.operators import score
from quire.streaming import ingest, stateful

DOCUMENTS = "doc_id long, text string"  # the path is a pattern, as a stream takes a plain path for a folder and a table may be one file


def finished(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@register("streamed_first_copies", "SELECT md5(text) AS text_md5, CAST(1 AS BIGINT) AS n FROM (SELECT DISTINCT text FROM documents)")
def streamed_first_copies(spark, sf_dir):
    """Documents as a stream; every text is handed on once, by the digests in the state."""
    out = folder(spark, "first-copies")
    stream = ingest.stream_documents(spark, f"{sf_dir}/document[s].parquet", DOCUMENTS, max_files=8)
    finished(stateful.ingest_first_copies(stream, out, folder(spark, "first-copies-state"), buckets=32))
    return spark.read.schema(DOCUMENTS).parquet(out).groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"))


@register("streamed_scores", "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents")
def streamed_scores(spark, sf_dir):
    """A plugged-in scorer over a stream."""
    out = folder(spark, "scores")
    stream = ingest.stream_documents(spark, f"{sf_dir}/document[s].parquet", DOCUMENTS, max_files=8)
    finished(ingest.score_stream(stream, score.length_loader, "text", "n_chars long", out, folder(spark, "scores-progress")))
    return spark.read.schema("doc_id long, n_chars long").parquet(out).select("doc_id", "n_chars")
