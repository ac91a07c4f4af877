"""Queries over the driver tables, one module for each part of the inventory."""

from __future__ import annotations

from . import core, decoding, failures, mapping, reconciliation, stateful, streams
from .registry import ORACLES, QUERIES

__all__ = ["all_oracles", "all_queries", "core", "decoding", "failures", "mapping", "reconciliation", "stateful", "streams"]


def all_queries() -> dict:
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
