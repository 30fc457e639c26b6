"""Every registered query of the copy-detection engine, with the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.plans import catalog_queries, feature_queries, match_queries, search_queries, sequence_queries, variant_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _part in (search_queries, feature_queries, sequence_queries, catalog_queries, match_queries, variant_queries):
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)
