"""Ordered index and prefix sums agree with a single-partition window on real data."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.plans.hashing import seeded_hash
from quire.plans.ordered import hash_bucket, ordered_index, prefix_sum, quantile_bucket

from sample_dirs import SF01


def _events(spark):
    return spark.read.parquet(f"{SF01}/events.parquet").select("event_id", "user_id", "value")


def test_ordered_index_matches_window(spark):
    ev = _events(spark)
    got = ordered_index(ev, ["value", "event_id"], name="r", total="n")
    ref = ev.withColumn("r2", F.row_number().over(Window.orderBy("value", "event_id")) - 1)
    assert got.join(ref, "event_id").filter(F.col("r") != F.col("r2")).count() == 0
    assert got.select("n").distinct().first()["n"] == ev.count()


def test_ordered_index_descending_and_hash(spark):
    ev = _events(spark)
    got = ordered_index(ev, [-F.col("value"), "event_id"], name="r")
    ref = ev.withColumn("r2", F.row_number().over(Window.orderBy(F.desc("value"), "event_id")) - 1)
    assert got.join(ref, "event_id").filter(F.col("r") != F.col("r2")).count() == 0
    h = ev.withColumn("h", seeded_hash(3, "event_id"))
    got = ordered_index(h, ["h", "event_id"], name="r", bucket=hash_bucket("h", 64))
    ref = h.withColumn("r2", F.row_number().over(Window.orderBy("h", "event_id")) - 1)
    assert got.join(ref, "event_id").filter(F.col("r") != F.col("r2")).count() == 0


def test_prefix_sum_matches_window(spark):
    ev = _events(spark)
    got = prefix_sum(ev, ["user_id", "event_id"], "value", name="c")
    ref = ev.withColumn("c2", F.sum("value").over(Window.orderBy("user_id", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    assert got.join(ref, "event_id").filter(F.abs(F.col("c") - F.col("c2")) > 1e-6).count() == 0


def test_ties_of_a_third_of_all_rows_are_cut_further(spark):
    rows = [(0.5 if i % 3 == 0 else (i * 37 % 101) / 101, f"k{i * 7919 % 3000:05d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "p double, o string")
    b = quantile_bucket(df, "p", 16, then=F.col("o"))
    per = df.select(b.alias("b")).groupBy("b").count().collect()
    assert max(r["count"] for r in per) < 3000 / 6
    got = ordered_index(df, ["p", "o"], num_buckets=16).orderBy("rank").collect()
    assert [(r.p, r.o) for r in got] == sorted(rows) and [r["rank"] for r in got] == list(range(3000))


def test_text_keys_are_ordered(spark):
    import random

    rng = random.Random(1)
    keys = sorted({"".join(rng.choices("abcé ", k=rng.randint(0, 9))) for _ in range(500)}, key=lambda k: k.encode())
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = ordered_index(df, ["k"], num_buckets=8).orderBy("rank").collect()
    assert [r.k for r in got] == keys
