"""All queries of the library but those of the language-model operators, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import checks, corpus, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**corpus.QUERIES, **search.QUERIES, **checks.QUERIES}
ORACLE_SQL: dict[str, str] = {**corpus.ORACLE_SQL, **search.ORACLE_SQL, **checks.ORACLE_SQL}
