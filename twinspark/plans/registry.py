"""All queries of the engine by name, and the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from twinspark.sources.package import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Register a query under `name`, with the SQL that gives the same rows."""

    def wrap(f: Callable[[SparkSession, str], DataFrame]):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return wrap


from twinspark.plans import metrics, search, sequences, tables  # noqa: E402, F401  they register their queries
