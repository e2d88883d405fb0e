"""The registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from unbrev.catalog import artifacts, builds, corpus, evaluation, gated, history, lexicons, ranking, retrieval, sessions, streams

_PARTS = (corpus, lexicons, retrieval, ranking, sessions, history, evaluation, streams, builds, gated, artifacts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for part in _PARTS for name, run in part.RUN.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
