"""Queries over the driver's tables, by name."""

from __future__ import annotations

from . import base, on_graph, on_store, on_sync, on_tables, on_vectors  # noqa: F401


def flagship(spark, sf_dir):
    """Importance of every node of the business graph: one aggregate over all edges, one join."""
    return base.QUERIES["a2_impact"](spark, sf_dir)


def queries():
    return dict(base.QUERIES)


def oracles():
    return dict(base.ORACLES)
