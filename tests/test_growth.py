"""Work and memory of queries that grew faster than their input."""

import hashlib

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.catalog import QUERIES
from quire.functions import labels as L
from quire.functions import text as T
from quire.operators import records, score, vectors


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def docs_dir(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("growth"))
    rows = [(i, f"Alpha beta gammadelta, epsilon {i} " * (5 * i), ["en", "de", None][i % 3]) for i in range(12)] + [(12, None, "en"), (13, "", "de")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{top}/documents.parquet")
    return top


def test_scorer_gets_runs_of_bounded_size(spark):
    def load():
        return lambda texts: pd.DataFrame({"together": [int(texts.str.len().sum())] * len(texts)})

    df = spark.range(0, 60, 1, 1).select("id", F.repeat(F.lit("x"), 100_000).alias("text"))
    out = score.score_batches(df, load, "text", "together long").select("id", F.length("text").alias("n"), "together").collect()
    assert sorted(r.id for r in out) == list(range(60)) and {r.n for r in out} == {100_000}
    assert max(r.together for r in out) <= T.GROUP_BYTES


def test_text_groups():
    texts = pa.array(["a" * 10, None, "", "b" * 50, "c" * 9, "d" * 9, "é" * 5])
    assert list(T.text_groups(texts, 20)) == [(0, 3), (3, 1), (4, 2), (6, 1)]
    assert list(T.text_groups(pa.array([], pa.string()), 20)) == []


def test_vocabulary_is_counted_once(spark, docs_dir):
    assert "documents.parquet" not in QUERIES["vocabulary_vectors"](spark, docs_dir)._jdf.queryExecution().executedPlan().toString()


def test_records_cut_texts_once(spark, docs_dir):
    q = QUERIES["token_records"](spark, docs_dir)
    assert plan(q).count("regexp_extract_all(") == 1
    assert {r.doc_id for r in q.collect()} == set(range(1, 12))


def masked(toks, seed, key, most=20):
    """whole_word_mask, in plain Python."""
    groups = []
    for i, t in enumerate(toks):
        if t in records.UNMASKED:
            continue
        if not t.startswith("##") or not groups:
            groups.append([])
        groups[-1].append(i)
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    budget, n, hit = min(max(1, round(len(toks) * 0.15)), most), 0, set()
    for _, g in sorted((md5(f"{seed}:{key}:{k}"), g) for k, g in enumerate(groups, 1)):
        if n + len(g) <= budget:
            n += len(g)
            hit |= set(g)
    u = {i: int(md5(f"{seed}m:{key}:{i}")[:8], 16) % 10 for i in hit}
    new = [t if i not in hit or u[i] == 8 else "[MASK]" if u[i] < 8 else toks[(u[i] * 7919 + i) % len(toks)] for i, t in enumerate(toks)]
    return new, [t if i in hit else "" for i, t in enumerate(toks)]


def test_masks_look_at_chosen_tokens_only(spark):
    rows = [(1, ["[CLS]", "##a", "b", "##c", "[SEP]"]), (2, []), (3, ["[CLS]", "[SEP]"]), (4, ["[CLS]", *(f"w{i // 3}" if i % 3 == 0 else "##x" for i in range(900)), "[SEP]"]),
            (5, ["[CLS]", *("w" if i % 40 == 0 else "##x" for i in range(6000)), "s", "[SEP]"]), (6, [f"v{i}" for i in range(500)])]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    m = df.select("id", records.whole_word_mask("t", 5, "id").alias("m"))
    assert "exists(" not in plan(m)
    for r in m.collect():
        assert (r.m.tokens, r.m.labels) == masked(dict(rows)[r.id], 5, r.id)


def test_dropped_runs_are_not_described(spark):
    df = spark.createDataFrame([(["O", "I-A", "B-A", "I-A", "I-B", "B-A"], [0.1, 0.2, 0.3, 0.5, 0.6, 0.7])], "t array<string>, p array<double>")
    s = df.select(L.iob_to_spans("t", "p", score="mean").alias("s"))
    assert "opens" not in plan(s)
    assert [tuple(x) for x in s.first().s] == [("A", 2, 3, 0.4), ("A", 5, 5, 0.7)]


def test_folds_read_term_counts(spark):
    rows = [(i, "good fine nice" if i % 2 else "bad poor sad", i % 2) for i in range(24)]
    d = spark.createDataFrame(rows, "id long, text string, label int")
    votes = score.train_fold_ensemble(d, d.select("id", "text"), d.select("id", (F.col("id") % 3).cast("int").alias("fold")), n_folds=3, num_features=64)
    assert "quire-folds" in str(votes.inputFiles())
    assert {(r.id, r.label) for r in votes.collect()} == {(i, i % 2) for i in range(24)}


def test_sentence_embeddings_in_runs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SENTENCE_TOKENS", 2)
    model = spark.createDataFrame([("a", 0.5, 0, [1.0, 2.0, 4.0]), ("b", 0.25, 1, [3.0, 0.0, 1.0]), ("c", 1.0, 0, [0.0, 1.0, 5.0])],
                                  "token string, weight double, cluster int, vec array<float>")
    sents = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c", "a", "b"]), (3, ["z"]), (4, None)], "sid long, toks array<string>")
    e = vectors.s3e_embed(sents, "sid", "toks", model, [[0.5, 0.5, 1.0], [1.0, 0.0, 0.0]])
    assert "MapInArrow" in plan(e)
    got = {r.sid: r.embedding for r in e.collect()}
    assert got[3] is None and got[4] is None
    assert got[1][:3] == pytest.approx([0.625, 0.5, 1.125])
    r0, r1 = [0.0, 0.5, 1.0], [-0.25, 0.0, 0.25]  # residuals less their means: (-.5, 0, .5), (-.25, 0, .25)
    r0, r1 = [x - sum(r0) / 3 for x in r0], [x - sum(r1) / 3 for x in r1]
    dot = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True))
    cov = [dot(r0, r0), dot(r0, r1) * 2 ** 0.5, dot(r1, r1)]
    assert got[1][3:] == pytest.approx([x / dot(cov, cov) ** 0.5 for x in cov])


def test_lower_words_ignore_blanks(spark):
    texts = ["It's  A\tTest, (x) ", "", None, "  ", "a.b c", "É–Ü  ok\n\nNo"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    want = df.select("i", F.filter(F.flatten(F.transform(F.split(F.lower("t"), " "), T.punct_split)), lambda x: x != "").alias("w"))
    q = df.select("i", T.lower_words("t").alias("w"))
    assert "split(" not in plan(q) and q.collect() == want.collect()
