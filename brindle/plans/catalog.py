"""All registered queries over the driver's tables, with the SQL that must give the same rows.

Every query takes (spark, sf_dir). A query without SQL has a test of its own instead.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from brindle.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def load() -> None:
    """Imports the modules that register queries."""
    import importlib
    import pkgutil

    import brindle.plans as plans

    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"brindle.plans.{module.name}")
