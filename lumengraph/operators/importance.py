"""Importance of nodes, always derived: half in-degree, the rest tier and stability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from ..runtime import spread
from . import graph


def impacts(nodes: DataFrame, edges: DataFrame, ids: DataFrame | None = None, mode: str = "formula") -> DataFrame:
    """(id, in_degree, impact). ids: only those, by a semi-join before the aggregate. mode 'lazy': 0.7 until an edge arrives."""
    if ids is not None:
        nodes, edges = nodes.join(ids, "id", "left_semi"), spread(edges.select("dst", "id"), "dst").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    joined = nodes.select("id", "labels", "props").join(graph.degrees(edges), "id", "left")
    value = scalar.impact(F.col("in_degree"), F.col("labels"), F.col("props"))
    if mode == "lazy":
        value = F.when(F.coalesce("in_degree", F.lit(0)) == 0, F.lit(scalar.DEFAULT_IMPACT)).otherwise(value)
    return joined.select("id", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), value.alias("impact"))


def refreshed(nodes: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Nodes with their impact recomputed; with ids only theirs."""
    new = impacts(nodes, edges, ids).select("id", F.col("impact").alias("new"))
    return nodes.join(new, "id", "left").withColumn("impact", F.coalesce("new", "impact")).drop("new")
