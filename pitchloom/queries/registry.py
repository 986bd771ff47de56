"""Registration of queries and shared pieces of oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def swapped(sql: str, old: str, new: str) -> str:
    """``sql`` with one piece replaced; an error where the piece is not there once."""
    if sql.count(old) != 1:
        raise ValueError(f"found {sql.count(old)} times: {old}")
    return sql.replace(old, new)


def r6(c: Column | str) -> Column:
    """Round to six digits, and turn a negative zero into zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, DIGITS) + F.lit(0.0)


def q6(expr: str) -> str:
    return f"(round({expr}, {DIGITS}) + 0e0)"


def frames_sql(hop: float, silent_zero: bool = False) -> str:
    """Body of a ``frames`` common table expression."""
    f0 = "60e0 + value"
    if silent_zero:
        f0 = f"CASE WHEN event_type <> 'error' THEN {f0} ELSE 0e0 END"
    return f"""
      SELECT recording_id, frame_idx, frame_idx * {hop!r}::DOUBLE AS ts, {f0} AS f0_hz,
             event_type <> 'error' AS voiced,
             CAST(json_extract(props, '$.k') AS INTEGER) / 100e0 AS voiced_prob, event_type,
             120e0 + user_id % 60 AS tonic_hz, CAST(user_id % 5 AS INTEGER) AS label
      FROM (SELECT *, CAST(user_id AS VARCHAR) AS recording_id,
                   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx
            FROM events)"""


def fold_sql(x: str) -> str:
    return f"(CASE WHEN ({x}) % 1200e0 < 0 THEN ({x}) % 1200e0 + 1200e0 ELSE ({x}) % 1200e0 END)"


def pc_bin_sql(x: str, bins: int = 120) -> str:
    return f"CAST(least(floor({fold_sql(x)} / {1200 / bins!r}::DOUBLE), {bins - 1}) AS INTEGER)"
