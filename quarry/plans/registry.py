"""Registered queries: one Spark plan and (where an exact twin exists) one
DuckDB SQL string per operator id of the inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a (spark, sf_dir) -> DataFrame plan and its twin."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query id {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from quarry.session import ship_package
            ship_package(spark)  # executors need the package for Arrow-batched steps
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so their registrations run."""
    from quarry.plans import (classify, vectors, stats, prep, text, linear, neighbors,  # noqa: F401
                              attention, images, ensemble, misc)
