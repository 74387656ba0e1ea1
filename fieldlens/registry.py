"""All registered queries, collected from the query modules."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "schemas", "versions", "catalogs", "guides", "messages", "mappings",
    "texts", "records", "trees", "files", "documents", "apis", "synthesis", "streams", "storage",
)

Query = Callable[[SparkSession, str], DataFrame]


class Group:
    """Queries of one theme with their oracle SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def register(fn: Query) -> Query:
            self.queries[name] = fn
            if oracle is not None:
                self.oracles[name] = oracle
            return fn

        return register


def _groups() -> list[Group]:
    groups = []
    for name in MODULES:
        if importlib.util.find_spec(f"fieldlens.queries.{name}"):
            groups.append(importlib.import_module(f"fieldlens.queries.{name}").GROUP)
    return groups


def queries() -> dict[str, Query]:
    return {k: v for g in _groups() for k, v in g.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for g in _groups() for k, v in g.oracles.items()}
