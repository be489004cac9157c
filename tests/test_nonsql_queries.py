"""Registered queries without a SQL oracle, checked against brute force on the small tables."""

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from quire.catalog import QUERIES
from quire.operators import vectors

from sample_dirs import SF001


def test_pages_repeat_collapse_matches_python(spark):
    got = {r.page_id: r.clean_md5 for r in QUERIES["pages_repeat_collapse"](spark, SF001).collect()}
    pages = pd.read_parquet(f"{SF001}/pages.parquet")
    for pid, html in zip(pages.page_id, pages.html):
        want = re.sub(r"(\W)\1{3,}", r"\1", html).strip()
        assert got[pid] == hashlib.md5(want.encode()).hexdigest()


def test_pca_removal_matches_numpy(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet").select("vec_id", "embedding")
    got = {r.vec_id: np.array(r.reduced) for r in vectors.remove_top_components(e, "embedding", k=1).collect()}
    pdf = pd.read_parquet(f"{SF001}/embeddings.parquet")
    x = np.stack(pdf.embedding.to_numpy()).astype(np.float64)
    xc = x - x.mean(0)
    _, sv, ut = np.linalg.svd(xc, full_matrices=False)
    ratio = (sv[0] ** 2 - sv[1] ** 2) / sv[0] ** 2
    want = x - ratio * np.outer(x @ ut[0], ut[0])
    for vid, row in zip(pdf.vec_id, want):
        assert np.allclose(got[vid], row, atol=1e-4)


def test_kmeans_assigns_every_vector(spark):
    r = QUERIES["kmeans_clusters"](spark, SF001)
    assert r.count() == spark.read.parquet(f"{SF001}/embeddings.parquet").count()
    assert r.select("cluster").distinct().count() == 10


def test_fill_to_budget_query_invariants(spark):
    r = QUERIES["fill_to_budget"](spark, SF001)
    assert r.filter("full != (n_tokens >= 256)").count() == 0
    # every sentence is in exactly one chunk
    conv = spark.read.parquet(f"{SF001}/conversations.parquet")
    assert r.agg(F.sum(F.col("last") - F.col("first") + 1)).first()[0] == conv.count()
