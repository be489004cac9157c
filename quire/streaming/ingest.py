"""Streaming ingest.

The same column functions run in batch and streaming; the stream only changes the source
(``readStream`` with ``maxFilesPerTrigger``) and the sink (``foreachBatch``).

X5 de-duplicating ingest keeps the set of seen content digests in a Delta-free way: every
micro-batch is de-duplicated inside itself (keep first by ``order``), anti-joined against the
digests stored by EARLIER epochs, and written to its own ``epoch=<id>`` folder with overwrite.
A micro-batch that is retried after a lost executor or a restart rewrites exactly its own folders,
so the sink is idempotent (exactly-once together with the checkpoint). The state is a table of digests
on the shared file system, in buckets; its size is bounded by the number of distinct documents,
not by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.corpus import content_digest


def stream_documents(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", max_files: int = 1) -> DataFrame:
    """Lazy dataset over a directory: a file stream with bounded micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def cleaned(stream: DataFrame, text: str = "text") -> DataFrame:
    """The batch T1 cleaning applied to a stream (R3 keeps non-empty rows)."""
    return stream.withColumn(text, T.preprocess_text(F.col(text))).filter(F.length(text) > 0)


BUCKETS = 64


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there; any other fault of the file system is raised."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def dedup_ingest(stream: DataFrame, out_path: str, checkpoint: str, key: str = "text", order: str = "doc_id",
                 min_docs: int = 1, trigger_once: bool = True):
    """X5 (+X4): de-duplicating append of a document stream to ``out_path`` (Parquet).

    The digests seen so far are a table of their own, ``<out_path>_digests``, partitioned by a bucket of the digest:
    a micro-batch reads two numbers a row of the buckets it touches, never the documents. The first batch is
    told by the missing folder; a read that fails for another reason fails the batch, which is then retried
    from the checkpoint. Documents and digests of an epoch go to folders of that epoch, overwritten on retry.

    ``min_docs`` (X4, for tasks that need several documents at once): the rows of a smaller micro-batch are not lost but
    carried over, in ``<out_path>_carried``, and join the next one."""
    spark = stream.sparkSession
    digests, carried = f"{out_path}_digests", f"{out_path}_carried"

    def handle(batch: DataFrame, epoch: int) -> None:
        columns = batch.columns
        if min_docs > 1 and _exists(spark, carried):
            # what epoch n carries is the whole backlog before epoch n + 1
            waiting = spark.read.parquet(carried)
            last = waiting.filter(F.col("epoch") < epoch).agg(F.max("epoch")).first()[0]
            done = _exists(spark, out_path) and last is not None and spark.read.parquet(out_path).filter(
                (F.col("epoch") > last) & (F.col("epoch") < epoch)).limit(1).count() > 0
            if last is not None and not done:
                batch = batch.unionByName(waiting.filter(F.col("epoch") == last).select(*columns))
        if min_docs > 1 and batch.limit(min_docs).count() < min_docs:
            batch.write.mode("overwrite").parquet(f"{carried}/epoch={epoch}")
            return
        dg = batch.select("*", *content_digest(key))
        first = dg.groupBy("__dg1", "__dg2").agg(F.min_by(F.struct(*columns), F.col(order)).alias("r"))
        first = first.select("__dg1", "__dg2", "r.*").withColumn("__bucket", F.pmod("__dg1", F.lit(BUCKETS)).cast("int"))
        if _exists(spark, digests):
            seen = spark.read.parquet(digests).filter(F.col("epoch") < epoch).select("__bucket", "__dg1", "__dg2")
            first = first.join(seen, ["__bucket", "__dg1", "__dg2"], "left_anti")
        first.drop("__bucket").write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
        # written last, from what was stored: digests never name a document that is not there
        kept = spark.read.parquet(f"{out_path}/epoch={epoch}").select(
            "__dg1", "__dg2", F.pmod("__dg1", F.lit(BUCKETS)).cast("int").alias("__bucket"))
        kept.write.mode("overwrite").partitionBy("__bucket").parquet(f"{digests}/epoch={epoch}")

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def score_stream(stream: DataFrame, load, text: str, out_schema: str, out_path: str, checkpoint: str, trigger_once: bool = True):
    """Streaming inference: the F2 scorer per micro-batch, appended to Parquet (``pos`` kept,
    output order not promised)."""
    from quire.operators.score import score_batches

    def handle(batch: DataFrame, epoch: int) -> None:
        # one folder per epoch, overwritten on retry: idempotent sink
        score_batches(batch, load, text, out_schema).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def dedup_events_within_watermark(stream: DataFrame, keys, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """X5 for event streams: drop repeated keys whose copies arrive within ``delay`` of each other
    (event time). State is bounded by the watermark: a key is forgotten once the watermark passes
    its first occurrence + ``delay``, which is the stated semantics (later copies are kept)."""
    return _event_time(stream, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, ts: str, group: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Event-time tumbling-window counts with a watermark (late rows beyond ``delay`` are dropped);
    used to monitor ingest volume per source."""
    return _event_time(stream, ts).withWatermark(ts, delay).groupBy(F.window(ts, window), group).agg(F.count(F.lit(1)).alias("n"))


def _event_time(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP (session time zone); TIMESTAMP_NTZ columns are cast."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))
