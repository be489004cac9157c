"""De-duplicating ingest on Spark's arbitrary state (X5, X4): what was seen lives in the state store, not in a table that is read again.

Documents are dealt to buckets of their content digest. A bucket's state is a map of the digests it has passed on, each with a time to
live, and a list of documents that wait for company: a later step that draws sentences from other documents needs several of them at
once, so a chunk is handed on when ``min_docs`` documents are there. A timer hands a shorter chunk on when its oldest document has waited
``max_wait``, so that nothing waits for a batch that never comes.

A micro-batch reads and writes the states of the buckets it touches; a batch that runs again after a loss starts from the stored version of the
state and overwrites its own folder, so every document is handed on exactly once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.streaming import StatefulProcessor

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
_UNITS = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}


def milliseconds(span: str | int | None) -> int | None:
    """``"10 minutes"`` as a number; a number is one already."""
    if span is None or isinstance(span, int):
        return span
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+?)s?\s*", span)
    if m is None or m[2] not in _UNITS:
        raise ValueError(f"not a time span: {span!r}")
    return int(m[1]) * _UNITS[m[2]]


class _FirstCopies(StatefulProcessor):
    """Per bucket: documents of digests not seen within ``ttl``, in chunks of at least ``min_docs``."""

    def __init__(self, columns: list[str], row_type: Ty.StructType, order: str, min_docs: int, max_wait: int | None, ttl: int | None):
        self.columns, self.row_type, self.order = columns, row_type, order
        self.min_docs, self.max_wait, self.ttl = min_docs, max_wait, ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "digest binary", "since long", self.ttl)
        self.waiting = handle.getListState("waiting", self.row_type)
        self.chunks = handle.getValueState("chunks", "n long")

    def _hand_on(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        number = self.chunks.get()[0] if self.chunks.exists() else 0
        self.chunks.update((number + 1,))
        out = pd.DataFrame(rows, columns=self.columns, dtype=object)
        out["bucket"], out["chunk"] = key[0], number
        yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, first = timerValues.getCurrentProcessingTimeInMs(), {}
        at = self.columns.index(self.order)
        for part in rows:
            values = part[[f"c{i}" for i in range(len(self.columns))]].astype(object)
            for digest, row in zip(part["digest"], values.where(values.notna(), None).itertuples(index=False, name=None), strict=True):
                digest = bytes(digest)
                if digest not in first or _before(row[at], first[digest][at]):
                    first[digest] = row
        new = []
        for digest, row in first.items():
            if not self.seen.containsKey((digest,)):
                self.seen.updateValue((digest,), (now,))
                new.append(tuple(v.item() if hasattr(v, "item") else v for v in row))
        if not new:
            return
        new.sort(key=lambda r: (r[at] is None, r[at]))
        held = [tuple(r) for r in self.waiting.get()] if self.min_docs > 1 and self.waiting.exists() else []
        if len(held) + len(new) >= self.min_docs:
            self.waiting.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            yield from self._hand_on(key, held + new)
        else:
            self.waiting.appendList(new)
            if not held and self.max_wait is not None:
                self.handle.registerTimer(now + self.max_wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        if held:
            self.waiting.clear()
            yield from self._hand_on(key, held)

    def close(self) -> None:
        pass


def _before(a, b) -> bool:
    return a is not None and (b is None or a < b)


def first_copies(stream: DataFrame, key: str = "text", order: str = "doc_id", min_docs: int = 1, max_wait: str | int | None = "10 minutes",
                 ttl: str | int | None = None, buckets: int = 256) -> DataFrame:
    """X5/X4 on a document stream: its rows without those whose ``key`` was seen before, with ``bucket`` and ``chunk`` (number within the bucket).

    Of copies within one micro-batch the one with the least ``order`` stays (null last). ``ttl``: a digest is forgotten so long after
    it was passed on, and a later copy passes again; None remembers for ever. ``min_docs``: least documents of a chunk; ``max_wait``: a shorter
    chunk is handed on after so long (None: it waits for company). A null ``key`` is a content of its own. Needs ``spark.sql.streaming.stateStore.providerClass``
    to be RocksDB (``use_state_store``). Memory of a task: the new documents of one bucket in one micro-batch."""
    columns, row_type = stream.columns, stream.schema
    digest = F.unhex(F.sha2(F.concat(F.when(F.col(key).isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256))
    # plain names: rows reach the processor as named tuples
    dealt = stream.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], digest.alias("digest")).withColumn(
        "of", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))
    out = Ty.StructType([*row_type.fields, Ty.StructField("bucket", Ty.IntegerType()), Ty.StructField("chunk", Ty.LongType())])
    processor = _FirstCopies(columns, row_type, order, min_docs, milliseconds(max_wait), milliseconds(ttl))
    return dealt.groupBy("of").transformWithStateInPandas(processor, out, outputMode="Append", timeMode="ProcessingTime")


def use_state_store(spark: SparkSession) -> None:
    """Set the session's state store to RocksDB, which keeps state on disk and uploads its changes to the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def ingest_first_copies(stream: DataFrame, out_path: str, checkpoint: str, trigger: str | None = None, **options):
    """Write ``first_copies`` of ``stream`` to ``out_path`` (Parquet, a folder an epoch, overwritten when the epoch runs again).

    ``trigger``: how often a batch is looked for (``"1 minute"``); timers fire in batches without data too. None takes what is there and
    stops; documents that still wait then stay in the state, and a later batch hands them on when their time is up."""
    spark = stream.sparkSession
    use_state_store(spark)

    def handle(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    w = first_copies(stream, **options).writeStream.foreachBatch(handle).outputMode("append").option("checkpointLocation", checkpoint)
    if trigger:
        return w.trigger(processingTime=trigger).start()
    # with timers Spark always has one more batch without data to run, and a query that takes what is there would not end
    before = spark.conf.get(NO_DATA)
    spark.conf.set(NO_DATA, "false")
    try:
        return w.trigger(availableNow=True).start()
    finally:
        spark.conf.set(NO_DATA, before)
