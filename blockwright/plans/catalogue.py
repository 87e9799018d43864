"""Every query of the engine by name, and the same in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import geometry_queries, structure_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = text_queries.QUERIES | structure_queries.QUERIES | geometry_queries.QUERIES
ORACLES: dict[str, str] = text_queries.ORACLES | structure_queries.ORACLES | geometry_queries.ORACLES
