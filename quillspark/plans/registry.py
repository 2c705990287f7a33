"""All registered queries of the corpus operators, each with its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    rows: str  # the inventory rows that it covers


_ENTRIES: dict[str, Entry] = {}


def register(name: str, rows: str, sql: str | None = None):
    """Decorator: a query (spark, sf_dir) -> DataFrame under ``name``."""

    def add(run):
        if name in _ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        _ENTRIES[name] = Entry(run, sql, rows)
        return run

    return add


def _load() -> dict[str, Entry]:
    from quillspark.plans import catalog  # noqa: F401  its modules register their queries

    return _ENTRIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: e.run for name, e in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {name: e.sql for name, e in _load().items() if e.sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _load()["link_orphan_report"].run(spark, sf_dir)
