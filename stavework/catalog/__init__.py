"""The registered queries, one module per area, each with its SQL oracle beside it."""

from __future__ import annotations

import importlib

AREAS = ["rhythm", "grid", "harmony", "strums", "signal", "structure", "truth", "arrange", "catalogue", "jobs", "members"]


def _modules():
    return [importlib.import_module(f"stavework.catalog.{a}") for a in AREAS]


def all_queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def all_oracles() -> dict:
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}
