"""Query registry: every registered query reads the driver tables.

``@query(name, oracle=..., fixtures=(...))`` records a ``(spark, sf_dir) ->
DataFrame`` callable and, when the rule is SQL-expressible, the DuckDB
statement that must return the same rows (column names included).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans.oracle_fixtures import cte
from quire.sources.tables import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, fixtures: tuple[str, ...] = ()):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``."""

    def deco(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = cte(oracle, *fixtures)
        return fn

    return deco


def load_all() -> None:
    """Import every query module so its decorators run."""
    from quire.plans import catalog  # noqa: F401
