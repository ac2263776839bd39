"""Named queries with the DuckDB text that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query; ``views`` is the WITH list its SQL text builds on."""

    def add(run: Query) -> Query:
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        text = sql if sql is None else (f"WITH {views.strip().rstrip(',')}\n{sql}" if views else sql)
        CATALOG[name] = Entry(run, text)
        return run

    return add
