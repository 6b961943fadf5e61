"""Registry of named queries: a DataFrame function and the SQL that says the same."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import pinned

from .adapters import Views, ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, tuple[str, ...]] = {}


def query(name: str, covers: str, sql: str | None = None, uses: str = ""):
    """Registers f(views) under a name. covers: inventory ids; sql: the oracle's body; uses: adapters it reads."""

    def add(f: Callable[[Views], DataFrame]):
        @functools.wraps(f)
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Views(pinned(spark), sf_dir))

        QUERIES[name] = call
        COVERS[name] = tuple(covers.split())
        if sql:
            ORACLES[name] = ctes(uses.split(), sql)
        return f

    return add
