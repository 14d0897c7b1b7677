"""Selections on nodes and edges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar


def moment(t) -> Column | None:
    """A timestamp column from a column, a datetime or text in RFC 3339."""
    if t is None or isinstance(t, Column):
        return t
    if isinstance(t, dt.datetime):
        return F.lit(t).cast("timestamp")
    return F.to_timestamp(F.lit(t))


def valid(t: Column) -> Column:
    return (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to")))


def as_of(df: DataFrame, t=None, include_invalid: bool = False) -> DataFrame:
    """Rows valid at t, the end excluded. Without t: current rows, or all if include_invalid."""
    if t is not None:
        return df.where(valid(moment(t)))
    return df if include_invalid else live(df)


def live(df: DataFrame) -> DataFrame:
    return df.where(F.col("valid_to").isNull())


def unexpired(df: DataFrame, now) -> DataFrame:
    return df.where(F.col("expires_at").isNull() | ~(moment(now) > F.col("expires_at")))


def expired(df: DataFrame, now) -> DataFrame:
    return df.where(moment(now) > F.col("expires_at"))


def relations(edges: DataFrame, rel: str | None = None, rels: list[str] | None = None) -> DataFrame:
    """By type; ANY (in capitals) and no type at all mean every type."""
    wanted = [r for r in [rel, *(rels or [])] if r is not None]
    return edges if not wanted or "ANY" in wanted else edges.where(F.col("rel").isin(wanted))


def edge_query(edges: DataFrame, src: str | None = None, dst: str | None = None, rel: str | None = None, t=None, include_invalid: bool = False, limit: int | None = None) -> DataFrame:
    """Edges by either end, type and time; with a limit the first by id."""
    out = as_of(relations(edges, rel), t, include_invalid)
    out = out.where(F.col("src") == src) if src is not None else out
    out = out.where(F.col("dst") == dst) if dst is not None else out
    return out.orderBy("id").limit(limit) if limit is not None else out


def by_id(df: DataFrame, id_: str) -> DataFrame:
    return df.where(F.col("id") == id_)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge ever touched and that don't carry the label MASTER (in capitals)."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return nodes.where(~F.coalesce(F.array_contains("labels", "MASTER"), F.lit(False))).join(ends, "id", "left_anti")


class Forbidden(PermissionError):
    """403 Forbidden."""


def violations(nodes: DataFrame, system: bool = False) -> DataFrame:
    """Nodes of tier MASTER, which only the system may write."""
    return nodes.limit(0) if system else nodes.where(scalar.tier(F.col("labels")) == "MASTER")


def govern(nodes: DataFrame, system: bool = False) -> None:
    """One aggregate over all nodes to be written; raises if any breaks the rule."""
    if not system and nodes.agg(F.coalesce(F.bool_or(scalar.tier(F.col("labels")) == "MASTER"), F.lit(False))).first()[0]:
        raise Forbidden("403 Forbidden: only the system writes nodes of tier MASTER")


def govern_inputs(labels: list[list[str]], system: bool = False) -> None:
    """The same rule over labels that are still on the driver, before any row is made of them."""
    if not system and any(x.upper() == "MASTER" for own in labels for x in own or []):
        raise Forbidden("403 Forbidden: only the system writes nodes of tier MASTER")


def batches_accepted(nodes: DataFrame, batch: str, system: bool = False) -> DataFrame:
    """(batch, accepted, n): a batch is accepted as a whole or not at all. One aggregate, however many batches."""
    master = F.bool_or(scalar.tier(F.col("labels")) == "MASTER")
    return nodes.groupBy(batch).agg((F.lit(system) | ~F.coalesce(master, F.lit(False))).alias("accepted"), F.count("*").alias("n"))


def untimed_specs(nodes: DataFrame) -> DataFrame:
    """SPEC nodes without a time from which they hold."""
    return nodes.where((scalar.tier(F.col("labels")) == "SPEC") & F.col("valid_from").isNull())


def unlinked_adrs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ADR nodes that no edge ties to a SPEC node."""
    specs = nodes.where(scalar.tier(F.col("labels")) == "SPEC").select("id")
    linked = edges.join(specs, edges.dst == specs.id, "left_semi").select(F.col("src").alias("id"))
    return nodes.where(scalar.tier(F.col("labels")) == "ADR").join(linked, "id", "left_anti")


def cross_tier(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """supersedes and contradicts edges whose source is of a lower tier than their target."""
    t = nodes.select("id", scalar.tier_weight(scalar.tier(F.col("labels"))).alias("w"))
    e = edges.where(F.lower("rel").isin("supersedes", "contradicts"))
    e = e.join(t.select(F.col("id").alias("src"), F.col("w").alias("w_src")), "src").join(t.select(F.col("id").alias("dst"), F.col("w").alias("w_dst")), "dst")
    return e.where("w_src < w_dst").select("id", "src", "dst", "rel")
