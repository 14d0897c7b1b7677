"""Cluster summaries: members, centroids, edges between clusters, drift, gaps."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import vector
from ..runtime import BROADCAST_ROWS
from . import packed

#: Members of a part that edges are packed for.
PART_MEMBERS = 200_000


def centroids(vectors: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(key, centroid): element-wise mean. Partial means by position are combined on the map side."""
    parts = vectors.where("embedding IS NOT NULL").select(key, F.posexplode("embedding").alias("p", "x"))
    means = parts.groupBy(key, "p").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "m"))), lambda z: z["m"]).alias("centroid"))


def summaries(members: DataFrame, vectors: DataFrame, snapshot_id: int = 0, timestamp=None) -> DataFrame:
    """(snapshot_id, cluster_id, theme, member_count, impact, centroid, timestamp) of members (id, cluster_id, impact); clusters without a vector are left out."""
    base = members.groupBy("cluster_id").agg(F.count("*").alias("member_count"), F.avg("impact").alias("impact"))
    own = vectors.select(F.col("node_id").alias("id"), "embedding").join(members.select("id", "cluster_id"), "id")
    return base.join(centroids(own), "cluster_id").select(
        F.lit(snapshot_id).cast("bigint").alias("snapshot_id"), "cluster_id", F.concat(F.lit("Theme-"), F.col("cluster_id").cast("string")).alias("theme"), "member_count", "impact", "centroid", F.lit(timestamp).cast("timestamp").alias("timestamp"),
    )


def themes(members: DataFrame) -> DataFrame:
    """(cluster_id, theme): the most frequent label of the members, ties by name."""
    return members.select("cluster_id", F.explode("labels").alias("label")).groupBy("cluster_id").agg(F.mode("label", True).alias("theme"))


def meta_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(from_cluster, to_cluster, weight): edges that cross clusters, by ordered pair.

    Few members go to the edges. Else the edges go to the members of one end and then of the other, packed and counted on the way.
    """
    c = members.select("id", "cluster_id")
    n = c.count()
    if n > BROADCAST_ROWS:
        return packed_meta_edges(edges, c, -(-n // PART_MEMBERS))
    c = F.broadcast(c)
    e = edges.join(c.select(F.col("id").alias("src"), F.col("cluster_id").alias("from_cluster")), "src").join(c.select(F.col("id").alias("dst"), F.col("cluster_id").alias("to_cluster")), "dst")
    return e.where("from_cluster <> to_cluster").groupBy("from_cluster", "to_cluster").agg(F.count("*").alias("weight"))


def packed_meta_edges(edges: DataFrame, members: DataFrame, parts: int) -> DataFrame:
    """meta_edges() by about so many ranges of the members' ids (id, cluster_id). The edges of a part are opened some at a time; those with an end before all members or after them stay where they are."""
    kind = members.schema["cluster_id"].dataType
    counted = pa.schema([("from_cluster", to_arrow_type(kind)), ("to_cluster", to_arrow_type(kind)), ("n", pa.int64())])
    members = members.where("id IS NOT NULL")
    least, greatest, n = members.agg(F.min("id"), F.max("id"), F.count("*")).first()
    at = packed.bounds(members, "id", parts, n)

    def first(e: pa.Table) -> pa.Table:
        e = e.rename_columns({"cluster_id": "from_cluster"}).group_by(["from_cluster", "dst"], use_threads=False).aggregate([([], "count_all")])
        return packed.pack(e.rename_columns({"count_all": "n"}), "dst", at)

    def second(e: pa.Table) -> pa.Table:
        e = e.rename_columns({"cluster_id": "to_cluster"})
        e = e.filter(pc.not_equal(e["from_cluster"], e["to_cluster"])).group_by(["from_cluster", "to_cluster"], use_threads=False).aggregate([("n", "sum")])
        return e.rename_columns({"n_sum": "n"})

    of = packed.packed(members, "id", at)
    among = F.col("src").between(F.lit(least), F.lit(greatest)) & F.col("dst").between(F.lit(least), F.lit(greatest))
    met = packed.meet(packed.packed(edges.select("src", "dst").where(among), "src", at), "src", of, first)
    pairs = packed.meet(met, "dst", of, second, counted, f"from_cluster {kind.simpleString()}, to_cluster {kind.simpleString()}, n bigint")
    return pairs.groupBy("from_cluster", "to_cluster").agg(F.sum("n").alias("weight"))


def drift(history: DataFrame) -> DataFrame:
    """The history of summaries with drift: 1 - cosine to the centroid of the same cluster in its snapshot before; null in its first."""
    w = Window.partitionBy("cluster_id").orderBy("snapshot_id")
    before = F.lag("centroid").over(w)
    return history.withColumn("drift", F.when(before.isNotNull(), 1 - vector.cosine(F.col("centroid"), before)))


def history_of(history: DataFrame, cluster_id: int) -> DataFrame:
    return history.where(F.col("cluster_id") == cluster_id).orderBy("snapshot_id")


def gaps(super_nodes: DataFrame, meta: DataFrame | None = None, min_impact: float = 0.5, min_similarity: float = 0.75, require_disconnected: bool = False, squared: bool = False) -> DataFrame:
    """(cluster_a, cluster_b, similarity, reason): pairs of weighty clusters whose centroids lie near each other.

    The impact gate comes before the pairing, so only weighty clusters are paired.
    """
    s = super_nodes.where(F.col("impact") >= min_impact).select("cluster_id", "centroid")
    a, b = s.select(F.col("cluster_id").alias("cluster_a"), F.col("centroid").alias("ca")), s.select(F.col("cluster_id").alias("cluster_b"), F.col("centroid").alias("cb"))
    out = a.join(b, F.col("cluster_a") < F.col("cluster_b")).withColumn("similarity", 1 / (1 + vector.l2(F.col("ca"), F.col("cb"), squared))).where(F.col("similarity") > min_similarity)
    if require_disconnected and meta is not None:
        tied = meta.select(F.least("from_cluster", "to_cluster").alias("cluster_a"), F.greatest("from_cluster", "to_cluster").alias("cluster_b")).distinct()
        out = out.join(tied, ["cluster_a", "cluster_b"], "left_anti")
    return out.select("cluster_a", "cluster_b", "similarity", F.lit("High semantic similarity between weighty clusters").alias("reason"))
