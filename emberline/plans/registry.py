"""Names of queries, what runs them, and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberline.session import tune

Runner = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Runner] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Runner], Runner]:
    def register(run: Runner) -> Runner:
        if name in QUERIES:
            raise KeyError(f"query {name} is registered twice")

        def tuned(spark: SparkSession, directory: str) -> DataFrame:
            return run(tune(spark), directory)

        QUERIES[name] = tuned
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register
