"""Plan checks: no Cartesian product / nested loop on row-level joins, no Python in native
operators, filters and column pruning reach the parquet scan."""

import pytest

from quire.catalog import QUERIES

from sample_dirs import SF001

NATIVE = ["corpus_profile", "dedup_documents", "leak_matches", "leak_remove_first", "containment_first_doc",
          "split_stratified", "kfold", "metrics_binary", "mrr_at_10", "squad_summary", "regression_metrics"]


def _plan(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", NATIVE)
def test_no_cartesian_no_python(spark, name):
    plan = _plan(QUERIES[name](spark, SF001))
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "MapInPandas" not in plan


def test_containment_join_has_no_nested_loop_on_rows(spark):
    plan = _plan(QUERIES["containment_first_doc"](spark, SF001))
    # the only nested-loop join allowed is the one-row "empty item" branch
    assert plan.count("BroadcastNestedLoopJoin") <= 1


def test_column_pruning_reaches_scan(spark):
    df = QUERIES["class_distribution"](spark, SF001)
    plan = _plan(df)
    assert "ReadSchema: struct<doc_id:bigint,quality:int,toxic:int>" in plan
    df = QUERIES["split_by_language"](spark, SF001)
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in _plan(df)
