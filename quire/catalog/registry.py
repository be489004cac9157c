"""Query registry: a name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def load_all() -> None:
    # importing the modules fills the registry
    from quire.catalog import answers_q, corpus_q, extra_q, files_q, formats_q, leakage_q, metrics_q, qa_q, ranking_q, records2_q, records_q, sequence_q, splits_q, streams_q, vectors_q  # noqa: F401
