"""Queries of the subpackage and, where SQL can express them, the statements they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def load():
    """Import every query module of the subpackage."""
    from photonloom.llm import queries  # noqa: F401

    return QUERIES, ORACLES
