"""Registry of named queries (Spark callables) and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def _utc(fn):
    """Queries cast TIMESTAMP_NTZ columns to session-zone timestamps (watermarks, windows,
    epoch arithmetic); results are defined for a UTC session, so pin it."""
    import functools

    @functools.wraps(fn)
    def run(spark, sf_dir):
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    return run


def register(key: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key`` with optional oracle SQL."""
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = _utc(fn)
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so its registrations run."""
    from strata.plans import (q_profile, q_relational, q_windows, q_series,  # noqa: F401
                              q_prep, q_outliers, q_learn, q_forecast, q_explain,
                              q_quality, q_streams, q_neighbors, q_balance)
