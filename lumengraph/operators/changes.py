"""Writes as functions from tables to tables: history is kept, retraction and maintenance are joins."""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import scalar
from . import filters, sync


def _text(x):
    return x if x is None or isinstance(x, str) else json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def _when(x):
    """A time as text; what isn't one is refused before anything is written."""
    if isinstance(x, str):
        dt.datetime.fromisoformat(x)
    return x.isoformat() if isinstance(x, dt.datetime) else x


def node_rows(spark: SparkSession, inputs: list[dict], now, clock: int, peer_id: str) -> DataFrame:
    """Rows for node inputs (id, labels, props, embedding, lang, valid_from, caused_by, ttl), with the defaults of a new node."""
    rows = [
        (x.get("id") or f"N-{uuid.uuid4()}", list(x.get("labels") or []), _text(x.get("props") or {}), scalar.DEFAULT_IMPACT, [float(v) for v in x["embedding"]] if x.get("embedding") else None, x.get("lang") or "en", _when(x.get("valid_from")), x.get("caused_by"), x.get("ttl"), clock + i)
        for i, x in enumerate(inputs)
    ]
    df = spark.createDataFrame(rows, "id string, labels array<string>, props string, impact double, embedding array<double>, lang string, valid_from string, caused_by string, ttl bigint, time bigint")
    at = filters.moment(now)
    return df.select(
        "id", "labels", "props", "impact", "embedding", "lang", F.coalesce(F.to_timestamp("valid_from"), at).alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), "caused_by",
        F.when(F.col("ttl").isNotNull(), scalar.add_seconds(at, F.col("ttl"))).alias("expires_at"), F.struct("time", F.lit(peer_id).alias("peer_id")).alias("clock"),
    )


def edge_rows(spark: SparkSession, inputs: list[dict], now, clock: int, peer_id: str) -> DataFrame:
    """Rows for edge inputs (id, from, to, rel, props, valid_from, impact, caused_by)."""
    rows = [(x.get("id") or str(uuid.uuid4()), x["from"], x["to"], x["rel"], _text(x.get("props") or {}), _when(x.get("valid_from")), x.get("impact"), x.get("caused_by"), clock + i) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, "id string, src string, dst string, rel string, props string, valid_from string, impact double, caused_by string, time bigint")
    at, none = filters.moment(now), F.lit(None)
    return df.select(
        "id", "src", "dst", "rel", "props", F.coalesce(F.to_timestamp("valid_from"), at).alias("valid_from"), none.cast("timestamp").alias("valid_to"), at.alias("recorded_at"), none.cast("string").alias("superseded_by"),
        F.coalesce("impact", F.lit(scalar.DEFAULT_IMPACT)).alias("impact"), "caused_by", F.struct("time", F.lit(peer_id).alias("peer_id")).alias("clock"),
    )


def put(table: DataFrame, new: DataFrame) -> DataFrame:
    """New rows in place of current ones of the same id; closed versions stay. The table is read once."""
    by = new.select(F.col("id").alias("_id"))
    return table.join(by, (table["id"] == by["_id"]) & table["valid_to"].isNull(), "left_anti").unionByName(new.select(*table.columns))


def close(table: DataFrame, ids: DataFrame, at) -> DataFrame:
    """Current rows of these ids end at the time; nothing is deleted."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return table.join(hit, "id", "left").withColumn("valid_to", F.when(F.col("_hit") & F.col("valid_to").isNull(), filters.moment(at)).otherwise(F.col("valid_to"))).select(*table.columns)


def supersede(table: DataFrame, new: DataFrame, at) -> DataFrame:
    """Closes the current version of each id of new and adds new's, valid from then on."""
    return close(table, new, at).unionByName(new.withColumn("valid_from", filters.moment(at)).withColumn("valid_to", F.lit(None).cast("timestamp")).select(*table.columns))


def supersede_edges(edges: DataFrame, new: DataFrame, at) -> DataFrame:
    """Current edges of the same type between the same nodes end, and name their successor."""
    by = new.select("src", "dst", "rel", F.col("id").alias("_new")).groupBy("src", "dst", "rel").agg(F.min("_new").alias("_new"))
    j = edges.join(by, ["src", "dst", "rel"], "left")
    hit = F.col("_new").isNotNull() & F.col("valid_to").isNull() & (F.col("id") != F.col("_new"))
    j = j.withColumn("superseded_by", F.when(hit, F.col("_new")).otherwise(F.col("superseded_by"))).withColumn("valid_to", F.when(hit, filters.moment(at)).otherwise(F.col("valid_to")))
    return j.select(*edges.columns).unionByName(new.select(*edges.columns))


def versions(rows: DataFrame, *ties: str) -> DataFrame:
    """History from rows that only say since when they hold: each ends where the next of its id begins."""
    return rows.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("id").orderBy("valid_from", *ties)))


def at_times(history: DataFrame, times: DataFrame) -> DataFrame:
    """For times (id, t), the version of each id that holds at t. Versions of an id follow one another, so one sorted pass over both finds it: no version meets a time but the one before it."""
    held, asked = ([c for c in d.columns if c != "id"] for d in (history, times))
    none = lambda d, cols: F.lit(None).cast(d.select(F.struct(*cols)).schema[0].dataType)
    v = history.where("id IS NOT NULL").select("id", F.col("valid_from").alias("_t"), F.col("valid_to").alias("_end"), F.struct(*held).alias("_v"), none(times, asked).alias("_q"))
    q = times.where("id IS NOT NULL AND t IS NOT NULL").select("id", F.col("t").cast(v.schema["_t"].dataType), F.lit(None).cast(v.schema["_end"].dataType), none(history, held), F.struct(*asked))
    w = Window.partitionBy("id").orderBy("_t", F.col("_q").isNotNull(), F.col("_end").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    found = v.union(q).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_q IS NOT NULL AND _v IS NOT NULL")
    return found.select("id", "_q.*", "_v.*").where(F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to")))


def retract_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the nodes and every edge that touches them; unknown ids change nothing."""
    gone = ids.select("id").distinct()
    kept = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "id", "left_anti"), kept.select(*edges.columns)


def to_prune(nodes: DataFrame, edges: DataFrame, now) -> DataFrame:
    """(id) of nodes that expired, whatever their tier, and of orphans."""
    return filters.expired(nodes, now).select("id").union(filters.orphans(nodes, edges).select("id")).distinct()


def compact(nodes: DataFrame, edges: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Only current rows, and of nodes those that haven't expired."""
    return filters.live(filters.unexpired(nodes, now)), filters.live(edges)


def compact_vectors(vectors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Vectors of nodes that exist, one a node."""
    return vectors.join(nodes.select(F.col("id").alias("node_id")).distinct(), "node_id", "left_semi")


def clock_of(nodes: DataFrame, edges: DataFrame) -> int:
    return max(sync.logical_clock(nodes), sync.logical_clock(edges))


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], schema.NODE), spark.createDataFrame([], schema.EDGE)
