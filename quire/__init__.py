"""quire: corpus preparation and prediction analytics expressed as Spark jobs.

Sub-packages
------------
sources    readers and writers for the table and file formats (JSONL, TSV, CoNLL, token blocks, ...)
functions  column expressions: text cleaning, tokenising, label-array transforms, hashing
plans      shared plan building blocks: global ordered index / prefix sums, seeded hashes
operators  DataFrame -> DataFrame operators: de-duplication, leakage joins, splits, metrics, QA, retrieval
streaming  Structured Streaming variants of the ingest and scoring operators
"""

from quire.session import get_spark, checkpoint_dir  # noqa: F401
