import subprocess
import sys

import __spark_entry__ as E
import corpus_pipeline as P
from quire.llm.common import documents
from tests.llm.tests_llm_brute import classes, duplicates_left, is_contaminated

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = documents(spark, SF).persist()
    by_name = dict(P.STAGES)
    assert list(by_name) == ["language_id", "exact_dedup", "minhash_near_dedup", "decontamination", "best_fit_packing"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = by_name["language_id"](spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {i for i, t in rows if any(c.isalpha() for c in t or "")}
    assert kept.columns == docs.columns
    kept = by_name["exact_dedup"](spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == duplicates_left(rows) and kept.columns == docs.columns
    kept = by_name["minhash_near_dedup"](spark, docs, SF)
    assert {r.doc_id for r in kept.collect()} == {min(c) for c in classes(rows)} and kept.columns == docs.columns
    kept = by_name["decontamination"](spark, docs, SF)
    items = [r.text for r in documents(spark, SF, "benchmark").collect()]
    assert {r.doc_id for r in kept.collect()} == {i for i, t in rows if not is_contaminated(t, items)} and kept.columns == docs.columns


def test_run_packs_what_every_stage_kept(spark):
    out = P.run(spark, SF)
    ids = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    docs = documents(spark, SF)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert ids == {r.doc_id for r in docs.select("doc_id").collect()}


def test_run_on_hard_tables(spark, docs_of, hard, tmp_path):
    """Nulls, empty and repeated rows, long texts, columns with the stages' own names; an empty table."""
    bench = [(1, "the quick brown fox jumps over the lazy dog near the old river bank today"), (2, None), (None, "")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    fox = bench[0][1]
    many = [*hard, (50, fox), (51, "Alpha beta gamma delta epsilon zeta"), (52, "ALPHA beta gamma delta epsilon zeta"), (53, " ".join(f"w{i}" for i in range(60))),
            (54, " ".join(f"w{i}" for i in range(59))), (54, " ".join(f"w{i}" for i in range(59))), (55, None), (56, "12 34")]
    docs_of(many).write.parquet(str(tmp_path / "documents.parquet"))
    ids = {r.doc_id for r in P.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    # letterless texts, the smaller of equal texts, the larger of near copies and the benchmark's text are gone
    rows = [(i, t) for i, t in many if any(c.isalpha() for c in t or "")]
    assert not {1, 2, 3, 4, 50, 51, 54, 55, 56} & ids and {None, 5, 6, 7, 8, 9, 52, 53} <= ids and len(rows) > len(ids)
    empty = tmp_path / "empty"
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(empty / "benchmark.parquet"))
    docs_of([]).write.parquet(str(empty / "documents.parquet"))
    assert P.run(spark, str(empty)).count() == 0


def test_every_operator_is_registered():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()


def test_entry_imports_without_the_subpackage(tmp_path):
    code = ("import sys; sys.modules['quire.llm'] = None\n"
            "import __spark_entry__ as E\nassert E.queries() and not any(q.startswith('op') for q in E.queries())")
    import os

    root = os.path.dirname(os.path.abspath(E.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
