"""Adapter views of the driver's tables, for both engines, and the query decorator.

The views give the tables the shape of trial records (one row per subject, scenario and
repetition), ratings of them, and their dimensions. Each column is one expression that Spark and
DuckDB read alike; measured columns are dyadic fractions, so that sums are exact in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

BRACKETS = ("0-1B", "1-2B", "2-3B", "3-4B", "4-5GB")
DIFFICULTIES = ("easy", "medium", "hard")

_TRIAL = {
    "model": "concat('u', CAST(user_id AS VARCHAR(20)))",
    "bracket_ord": "CAST(user_id % 5 AS INT)",
    "bracket": "CASE user_id % 5 WHEN 0 THEN '0-1B' WHEN 1 THEN '1-2B' WHEN 2 THEN '2-3B' WHEN 3 THEN '3-4B' ELSE '4-5GB' END",
    "scenario": "event_type",
    "class": "CASE event_type WHEN 'error' THEN 'guard' WHEN 'click' THEN 'test' WHEN 'view' THEN 'rca' WHEN 'purchase' THEN 'secure' ELSE 'ops' END",
    "difficulty": "CASE k % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END",
    "rep": "CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS INT)",
    "k": "k",
    "det_passed": "k % 5",
    "det_score": "(k % 5) / 4e0",
    "tok_s": "CAST(round(value * 100) AS BIGINT) / 128e0",
    "energy_wh": "CASE WHEN k % 19 = 4 THEN NULL ELSE (event_id % 997) / 1024e0 END",
    "wall_s": "1e0 + k",
    "dnf": "k % 10 = 0",
    "finish_reason": "CASE WHEN k % 20 = 0 THEN 'DNF:stall' WHEN k % 10 = 0 THEN 'DNF:timeout' WHEN k % 10 = 7 THEN 'length' ELSE 'stop' END",
    "grounding": "CASE WHEN k % 2 = 0 THEN 'grounded' ELSE 'closed-book' END",
    "pair_id": "CASE WHEN k % 7 = 6 THEN NULL ELSE concat('p', CAST(k % 4 AS VARCHAR(20))) END",
    "memory": "CASE WHEN event_id % 2 = 0 THEN 'none' ELSE 'ctx' END",
    "strategy": "CASE event_id % 3 WHEN 0 THEN 'single' WHEN 1 THEN 'best_of_3_detcheck' ELSE 'evaluator_optimizer_1' END",
    "in_tokens": "32 + (event_id * 7) % 500",
    "out_tokens": "CASE WHEN k % 20 = 0 THEN 0 ELSE 16 + event_id % 480 END",
    "out_chars": "4 * (16 + event_id % 480)",
    "thinking_chars": "CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE 16 + event_id % 480 END",
    "peak_swap_mb": "CASE WHEN k % 13 = 0 THEN 20 + k WHEN k % 13 = 1 THEN NULL ELSE 0 END",
    "peak_c": "60e0 + k % 35",
    "mean_watts": "CASE WHEN k % 19 = 4 THEN NULL ELSE 8 + (event_id % 64) / 8e0 END",
    "membw_mb_s": "CASE WHEN k % 17 = 3 THEN NULL ELSE 8000e0 + 128 * (event_id % 97) END",
    "ipc": "(event_id % 256) / 128e0",
    "net_kb": "(event_id % 32) / 4e0",
    "size_bytes": "(1 + user_id % 7) * 536870912",
    "params": "(1 + user_id % 7) * 536870912",
    "run_id": "concat('202406', CASE WHEN user_id % 3 = 0 THEN '10' WHEN user_id % 3 = 1 THEN '11' ELSE '12' END, '-010203')",
    "sha": "CASE WHEN event_id % 101 = 0 THEN 'sha-old' ELSE 'sha-new' END",
    "fatal": "CASE WHEN event_id % 211 = 0 THEN 'pull_failed' ELSE NULL END",
    "ts": "ts",
    "seq": "event_id",
}
_JUDGED = {
    "model": "model",
    "scenario": "scenario",
    "rep": "rep",
    "memory": "memory",
    "class": "class",
    "seq": "seq",
    "judge_model": "judge_model",
    "score": "CASE WHEN judge_model = 'A' THEN CASE WHEN k % 11 = 5 THEN NULL ELSE 1 + k % 5 END ELSE least(5, greatest(1, 1 + k % 5 + seq % 3 - 1)) END",
    "tokens_in": "seq % 1000",
    "tokens_out": "seq % 90",
    "cache_read": "CASE WHEN seq % 5 = 0 THEN NULL ELSE (seq % 1000) - (seq % 10) END",
    "cache_write": "seq % 7",
    "ai_credits": "(seq % 100) / 8e0",
    "verdict": "CASE WHEN k % 29 = 0 THEN 'empty' ELSE 'ok' END",
    "evidence": "CASE WHEN k % 23 = 1 THEN NULL ELSE 'e' END",
}


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{expr} AS {name}" for name, expr in columns.items())


#: DuckDB's form of the views, to stand before a query.
WITH = f"""
WITH ev AS (SELECT *, CAST(props::JSON->>'$.k' AS INT) AS k FROM events),
trials AS (SELECT {_list(_TRIAL)} FROM ev),
judged AS (SELECT {_list(_JUDGED)} FROM trials, (VALUES ('A'), ('B')) AS j(judge_model))
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (model, scenario, rep), from the events table."""
    events = table(spark, sf_dir, "events").selectExpr("*", "CAST(get_json_object(props, '$.k') AS INT) AS k")
    return events.selectExpr(*[f"{expr} AS {name}" for name, expr in _TRIAL.items()])


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ratings for each trial."""
    rows = trials(spark, sf_dir).selectExpr("*", "explode(array('A', 'B')) AS judge_model")
    return rows.selectExpr(*[f"{expr} AS {name}" for name, expr in _JUDGED.items()])


def query(name: str, sql: str | None = None, views: bool = True):
    """Register a query; ``sql`` follows the views unless ``views`` is off. It starts with a further CTE (", x AS (...)") or SELECT."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        if name in FOUND:
            raise ValueError(f"query {name} is there already")
        FOUND[name] = (run, None if sql is None else (WITH + sql if views else sql))
        return run

    return add
