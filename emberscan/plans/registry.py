"""Registry of runnable queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def add(fn):
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, fn, oracle)
        return fn

    return add
