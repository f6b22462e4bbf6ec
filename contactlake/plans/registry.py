"""Registered queries and, where SQL can state it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def load_all() -> None:
    from contactlake.plans import (  # noqa: F401
        q_datasets, q_deliver, q_extract, q_indexes, q_policy, q_privacy, q_sources, q_stored, q_streams,
        q_validate,
    )
