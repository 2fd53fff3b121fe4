from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is left out where SQL cannot say it."""
    def keep(fn):
        if name in REGISTRY:
            raise ValueError(f"{name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        REGISTRY[name] = (run, sql)
        return fn
    return keep


def as_queries():
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def as_oracle():
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}


def over(ctes: dict[str, str], body: str) -> str:
    """SQL over named inputs."""
    heads = ", ".join(f"{name} AS ({sql})" for name, sql in ctes.items())
    return f"WITH RECURSIVE {heads} {body}"
