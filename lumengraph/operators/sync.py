"""Replication by last writer wins, votes, digests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ed25519
from ..runtime import checkpointed
from . import graph


def latest(rows: DataFrame, key: str = "id", clock: str = "clock") -> DataFrame:
    """The row of the greatest clock by key; of equal clocks the greatest row by its other columns. One shuffle, combined on the map side."""
    rest = [c for c in rows.columns if c not in (key, clock)]
    best = rows.groupBy(key).agg(F.max(F.struct(F.col(clock).alias("c"), *rest)).alias("m"))
    return best.select(*(F.col(key) if c == key else F.col("m.c").alias(clock) if c == clock else F.col(f"m.{c}").alias(c) for c in rows.columns))


def trusted(events: DataFrame, peers: DataFrame, local_peer: str, verify: Callable[[Column, Column, Column], Column] | None = ed25519.verified) -> DataFrame:
    """Events (signer, payload, signature, ...) of the local peer, and of known peers whose signature verify(key, payload, signature) accepts. Without a verifier no remote event is trusted."""
    own = events.where(F.col("signer") == local_peer)
    if verify is None:
        return own
    known = peers.select(F.col("peer_id").alias("signer"), "public_key")
    remote = events.where(F.col("signer") != local_peer).join(known, "signer")
    return own.unionByName(remote.where(verify(F.col("public_key"), F.col("payload"), F.col("signature"))).select(*events.columns))


def peer_of(public_key: bytes) -> str:
    """The id of a peer: the first 16 hex digits of its key's SHA-256."""
    return hashlib.sha256(public_key).hexdigest()[:16]


def refused(events: DataFrame, peers: DataFrame, local_peer: str) -> DataFrame:
    """Events of signers that nobody knows."""
    return events.where(F.col("signer") != local_peer).join(peers.select(F.col("peer_id").alias("signer")), "signer", "left_anti")


def merge(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local and remote versions by id, and by valid_from where the tables have histories; a remote one of an equal clock applies. The order of arrival doesn't matter.

    Of several versions of an id without an end the one of the greatest clock stays. Aggregates only, combined on the map side.
    """
    both = local.withColumn("_side", F.lit(0)).unionByName(remote.select(*local.columns).withColumn("_side", F.lit(1)))
    versioned = {"valid_from", "valid_to"} <= set(local.columns)
    key = ["id", "valid_from"] if versioned else ["id"]
    rest = [c for c in local.columns if c not in (*key, "clock")]
    best = both.groupBy(*key).agg(F.max(F.struct("clock", "_side", *rest)).alias("m")).select(*key, "m.*")
    if versioned:
        mark = F.struct("clock", "_side", "valid_from")
        live = best.where("valid_to IS NULL").groupBy("id").agg(F.max(mark).alias("_last"))
        best = best.join(live, "id", "left").where(F.col("valid_to").isNotNull() | mark.eqNullSafe(F.col("_last")))
    return best.select(*local.columns)


def logical_clock(rows: DataFrame) -> int:
    """The greatest time seen; 0 before the first event."""
    return rows.agg(F.coalesce(F.max("clock.time"), F.lit(0))).first()[0]


def clocks(rows: DataFrame, *by: str) -> DataFrame:
    """(by, clock, next): the greatest time seen in each group, and the one that the next event gets."""
    return rows.groupBy(*by).agg(F.coalesce(F.max("clock.time"), F.lit(0)).alias("clock")).withColumn("next", F.col("clock") + 1)


def next_clock(rows: DataFrame, remote: int = 0) -> int:
    return max(logical_clock(rows), remote) + 1


def tally(votes: DataFrame, n_peers: int) -> DataFrame:
    """(proposal_id, approvals, accepted): a peer's last vote counts; more than half of the peers (rounded down) must approve."""
    last = votes.groupBy("proposal_id", "peer_id").agg(F.max_by("approve", "position").alias("approve"))
    return last.groupBy("proposal_id").agg(F.count_if("approve").alias("approvals")).withColumn("accepted", F.col("approvals") > n_peers // 2)


def promote(nodes: DataFrame, accepted: DataFrame) -> DataFrame:
    """Nodes with MASTER among their labels where accepted (id) names them."""
    hit = accepted.select("id").distinct().withColumn("_yes", F.lit(True))
    return nodes.join(hit, "id", "left").withColumn("labels", F.when(F.col("_yes"), F.array_union(F.coalesce("labels", F.array().cast("array<string>")), F.array(F.lit("MASTER")))).otherwise(F.col("labels"))).select(*nodes.columns)


def ordered(position):
    """A position for comparing: a number, or the values of a struct, nulls first."""
    return [(x is not None, x) for x in (position.values() if isinstance(position, dict) else [position])]


def digest(lines: DataFrame) -> DataFrame:
    """(digest): SHA-256 of all lines (position, line) in order without separators; 64 zeros for none. They are sorted in ranges by all tasks; then one task reads range after range, and holds a batch of lines. digests() hashes in parallel too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, last = hashlib.sha256(), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            first, end = (b.column(0)[i].as_py() for i in (0, b.num_rows - 1))
            if last is not None and ordered(first) < ordered(last):
                raise RuntimeError("ranges of lines out of order")
            last, n = end, n + b.num_rows
            for x in b.column(1):
                h.update((x.as_py() or "").encode())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], names=["digest"])

    # Sorted in the stage before: the task that hashes has nothing to sort.
    one = checkpointed(lines.select("position", "line").orderBy("position")).coalesce(1).mapInArrow(run, "digest string")
    return one.agg(F.coalesce(F.max("digest"), F.lit("0" * 64)).alias("digest"))


def digests(lines: DataFrame, block: int = 10_000) -> DataFrame:
    """(block, digest) of every so many lines; two logs differ exactly in the blocks whose digests differ."""
    b = lines.withColumn("block", F.floor(F.col("position") / block))
    whole = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]))
    return b.groupBy("block").agg(F.sha2(whole, 256).alias("digest"))


def cyclic_supersedes(links: DataFrame) -> DataFrame:
    """(seed, id): pairs that supersede each other, over links (src, dst) of supersedes edges."""
    return graph.pairs_within(graph.classes(links))


def contradictory_implications(edges: DataFrame) -> DataFrame:
    """implies edges A to C where A contradicts some B that implies C."""
    kind = lambda r: edges.where(F.lower("rel") == r)
    banned = kind("contradicts").select("src", F.col("dst").alias("b")).join(kind("implies").select(F.col("src").alias("b"), "dst"), "b").select("src", "dst").distinct()
    return kind("implies").join(banned, ["src", "dst"], "left_semi").select("id", "src", "dst")
