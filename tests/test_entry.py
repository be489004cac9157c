"""Driver contract: entry() runs on sf0.001, every oracle has a query, the queries without SQL are known."""

import __spark_entry__ as E
from quire.catalog import ORACLES, QUERIES

NON_SQL = {"span_temperature", "pca_top_component_removed", "kmeans_clusters", "s3e_sentence_embeddings", "fold_ensemble_votes"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["lang", "n_docs", "n_tokens", "max_tokens"]
    assert df.count() > 0


def test_registry_consistency():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) - set(ORACLES) == NON_SQL
    assert all("LIMIT" not in sql.upper() or name in {"vocabulary_top100", "worst_similarity_cases"} for name, sql in ORACLES.items())
