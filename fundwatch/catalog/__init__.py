"""Named queries over the given tables, each with an equivalent SQL text where one exists."""

from __future__ import annotations

from .base import ORACLES, QUERIES


def load() -> None:
    """Import the modules that register queries."""
    from . import (
        crossbank, dashboard, evidence, fusion, graph, graph_ml, ingest, ml, rules, search, streaming, temporal,
    )


__all__ = ["ORACLES", "QUERIES", "load"]
