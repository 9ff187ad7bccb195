"""Registered queries and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusweave.plans import analysis, corpus, search, store, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
for _m in (corpus, search, analysis, store, views):
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
