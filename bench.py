"""Benchmark: run the headline queries on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and print ONE JSON line with per-query seconds.

Each query is fully executed with the ``noop`` sink (all rows produced, nothing collected to the
driver). The reported value is the sum of per-query medians over ``$BENCH_REPS`` warm runs.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.catalog import QUERIES  # noqa: E402
from quire.session import get_spark  # noqa: E402

HEADLINE = [
    "corpus_profile",
    "clean_documents",
    "dedup_documents",
    "length_histogram",
    "containment_first_doc",
    "leak_remove_first",
    "leak_remove_all",
    "split_stratified",
    "kfold",
    "nested_kfold",
    "token_vote",
    "class_report",
    "regression_metrics",
    "mrr_at_10",
    "squad_summary",
    "squad_best_thresh_f1",
    "passages",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "1"))
    # Spark's event log goes to a fresh scratch folder; shuffle bytes per query are read from it
    log_dir = tempfile.mkdtemp(prefix="quire-eventlog-")
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir})
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in QUERIES]
    # warm-up: JVM, Python workers, parquet footers
    QUERIES["class_distribution"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    out = {}
    for n in names:
        times = []
        spark.sparkContext.setJobGroup(n, n)
        for _ in range(reps):
            t0 = time.perf_counter()
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t0)
        out[n] = round(statistics.median(times), 3)
    spark.stop()
    shuffle = shuffle_bytes(log_dir)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_query_seconds", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": int(cpus),
                      "shuffle_write_bytes": {k: shuffle.get(k, 0) for k in out}}))


def _lines(path: str):
    if path.endswith(".zstd"):
        import io

        import zstandard

        with open(path, "rb") as raw:
            yield from io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(raw), encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as f:
            yield from f


def shuffle_bytes(log_dir: str) -> dict:
    """Sum of shuffle bytes written per job group (= query name) from the event log."""
    stage_group, total = {}, {}
    for path in sorted(glob.glob(os.path.join(log_dir, "**", "*"), recursive=True)):
        if not os.path.isfile(path) or os.path.basename(path).startswith("appstatus"):
            continue
        for line in _lines(path):
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    g = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for st in ev.get("Stage IDs", []):
                        stage_group[st] = g
                elif kind == "SparkListenerTaskEnd":
                    g = stage_group.get(ev.get("Stage ID"))
                    m = ((ev.get("Task Metrics") or {}).get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    if g:
                        total[g] = total.get(g, 0) + m
    return total


if __name__ == "__main__":
    main()
