"""All registered queries and their SQL, by name.

A family module declares queries with ``@query``; this module only gathers them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trialmill.plans.base import FOUND

from trialmill.plans import q_agreement, q_audit, q_derive, q_ingest, q_joins, q_progress, q_ranks, q_rollup, q_selection, q_series, q_sources, q_stream, q_text  # noqa: F401, I001

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: run for name, (run, _) in FOUND.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in FOUND.items() if sql}
