"""Shared by the query modules."""

from __future__ import annotations

from pyspark.sql import functions as F


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, key: str, oracle: str | None = None):
        def add(fn):
            self.queries[key] = fn
            if oracle:
                self.oracles[key] = oracle
            return fn
        return add


def r6(c, name=None):
    col = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return col.alias(name or c)


def r3(c, name=None):
    """Times run to millions of seconds at microsecond steps: three places keep halves off the rounding edge."""
    col = F.round(F.col(c) if isinstance(c, str) else c, 3)
    return col.alias(name or c)
