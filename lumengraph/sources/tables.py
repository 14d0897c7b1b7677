"""Readers and writers: snapshots, event logs, CSV, notes; and the graph that the driver's tables form."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime, schema
from ..functions import ed25519


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Snapshots


def save_snapshot(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_snapshot(spark: SparkSession, path: str, names=("nodes", "edges")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


# Event logs: a JSON object a line, signed ({"event": ..., "signature": ..., "signer_peer_id": ...}) or bare

NEST = 4


def read_log(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """(position, line): position orders lines by file name, then by their place in the file, whatever the files' sizes.

    Of a log in numbered folders, as append_log() writes it, only those numbered above after.
    """
    parts = runtime.numbers(spark, path)
    paths = [runtime.numbered(path, n) for n in parts if n > after] if parts else [path]
    if not paths:
        return spark.createDataFrame([], "position struct<file: string, block: bigint, line: bigint>, line string")
    # A block of a file is read by one task, in order.
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(paths).select(at.alias("position"), F.col("value").alias("line"))


def events(lines: DataFrame) -> DataFrame:
    """(position, sub, kind, id, payload, time, peer_id, signer, signature): an event a row, batches unfolded; lines that don't parse are skipped.

    A batch is a list of events, batches among them to a depth of NEST; {"nodes": [...], "edges": [...]} is read too. A Delete event
    {"Delete": {"id": ..., "kind": "Node" or "Edge"}} is a tombstone; without a kind it is a node's.
    """
    v = lines.select("position", F.try_parse_json("line").alias("v")).where("v IS NOT NULL")
    get = lambda c, path: F.try_variant_get(c, path, "string")
    part = lambda c, path: F.try_variant_get(c, path, "variant")
    listed = lambda c, path: F.try_variant_get(c, path, "array<variant>")
    none = F.array().cast("array<variant>")
    inner = F.coalesce(part(F.col("v"), "$.event"), F.col("v"))
    v = v.select("position", inner.alias("e"), get(F.col("v"), "$.signer_peer_id").alias("signer"), get(F.col("v"), "$.signature").alias("signature"))
    single = part(F.col("e"), "$.Batch").isNull()
    items = F.array("e")
    for _ in range(NEST):
        items = F.flatten(F.transform(items, lambda x: F.coalesce(listed(x, "$.Batch"), F.array(x))))
    # Most events are no batch.
    items = F.when(single, F.array("e")).otherwise(items)
    tag = lambda kind, p: F.struct(F.lit(kind).alias("kind"), p.alias("p"))
    of = lambda x: F.array(*(tag(k, part(x, f"$.{k}")) for k in ("Node", "Edge", "Delete")))
    plain = F.filter(F.flatten(F.transform(items, of)), lambda x: x["p"].isNotNull())
    several = lambda x, name, kind: F.transform(F.coalesce(listed(x, f"$.Batch.{name}"), none), lambda y: tag(kind, y))
    grouped = F.when(~single, F.flatten(F.transform(items, lambda x: F.concat(several(x, "nodes", "Node"), several(x, "edges", "Edge")))))
    grouped = F.coalesce(grouped, F.filter(plain, lambda x: F.lit(False)))
    out = v.select("position", "signer", "signature", F.posexplode(F.concat(plain, grouped)).alias("sub", "x"))
    p = F.col("x.p")
    return out.select(
        "position", "sub", F.col("x.kind").alias("kind"), get(p, "$.id").alias("id"), F.to_json(p).alias("payload"), F.coalesce(F.try_variant_get(p, "$.clock.time", "bigint"), F.lit(0)).alias("time"),
        F.coalesce(get(p, "$.clock.peer_id"), F.lit("")).alias("peer_id"), "signer", "signature",
    )


def replay(lines: DataFrame) -> DataFrame:
    """(kind, id, payload, time, peer_id): the versions of nodes and edges that the log leaves.

    A version is known by its kind, id and valid_from; the last line of each counts. Of several versions without an end the last one
    replaced the others. A tombstone ends all that stands before it: a node's also the edges that touch the node.
    """
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    # The lines are parsed once.
    e = runtime.checkpointed(events(lines).withColumn("at", F.struct("position", "sub")).select("kind", "id", field("valid_from").alias("since"), "at", "payload", "time", "peer_id"))
    rows = e.where("kind <> 'Delete'").groupBy("kind", "id", "since").agg(F.max(F.struct("at", "payload", "time", "peer_id")).alias("m")).select("kind", "id", "since", "m.*")
    open_ = field("valid_to").isNull()
    last = rows.where(open_).groupBy("kind", "id").agg(F.max("at").alias("last"))
    rows = rows.join(last, ["kind", "id"], "left").where(~open_ | (F.col("at") == F.col("last"))).drop("last")
    gone = e.where("kind = 'Delete'").groupBy(F.coalesce(field("kind"), F.lit("Node")).alias("of"), F.col("id").alias("gone")).agg(F.max("at").alias("until"))
    known = lambda of, id_: F.struct(F.lit(of).alias("of"), id_.alias("gone"))
    touched = F.when(F.col("kind") == "Edge", F.array(known("Edge", F.col("id")), known("Node", field("from")), known("Node", field("to")))).otherwise(F.array(known("Node", F.col("id"))))
    hit = rows.select("kind", "id", F.coalesce("since", F.lit("")).alias("since"), "at", F.inline(touched)).join(gone, ["of", "gone"]).where("at < until").select("kind", "id", "since").distinct()
    kept = rows.withColumn("since", F.coalesce("since", F.lit(""))).join(hit, ["kind", "id", "since"], "left_anti")
    return kept.select("kind", "id", "payload", "time", "peer_id")


def nodes_of(replayed: DataFrame) -> DataFrame:
    """Node rows of replayed payloads; fields that older logs lack are null."""
    n = replayed.where("kind = 'Node'").select(F.from_json("payload", schema.NODE.replace("props string", "props variant")).alias("n")).select("n.*")
    return n.withColumn("props", F.to_json("props"))


def edges_of(replayed: DataFrame) -> DataFrame:
    """Edge rows of replayed payloads; the log names the ends from and to."""
    e = replayed.where("kind = 'Edge'").select(F.from_json("payload", schema.EDGE.replace("src string", "`from` string").replace("dst string", "`to` string").replace("props string", "props variant")).alias("e")).select("e.*")
    return e.withColumnRenamed("from", "src").withColumnRenamed("to", "dst").withColumn("props", F.to_json("props"))


def event_json(rows: DataFrame, kind: str) -> DataFrame:
    """(event): the JSON of an event a row, {kind: {...}}. rows: nodes, edges, or (id) of what is deleted, then with kind DeleteNode or DeleteEdge."""
    if kind.startswith("Delete"):
        return rows.select(F.to_json(F.struct(F.struct("id", F.lit(kind[6:]).alias("kind")).alias("Delete"))).alias("event"))
    cols = [F.try_parse_json("props").alias("props") if c == "props" else F.col(c).alias({"src": "from", "dst": "to"}.get(c, c) if kind == "Edge" else c) for c in rows.columns]
    return rows.select(F.to_json(F.struct(F.struct(*cols).alias(kind))).alias("event"))


def as_lines(events_: DataFrame, *more: str, peer_id: str = "", key: bytes | None = None) -> DataFrame:
    """(more, line): events as lines of a log; with a secret key signed in the name of peer_id."""
    if key is None:
        return events_.select(*more, F.concat(F.lit('{"event":'), "event", F.lit("}")).alias("line"))
    return events_.select(*more, F.concat(F.lit('{"event":'), "event", F.lit(',"signature":'), ed25519.signer(key)("event"), F.lit(f',"signer_peer_id":"{peer_id}"}}')).alias("line"))


def log_lines(nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """(line): an event a row, as the log holds it."""
    out = [as_lines(event_json(df, kind)) for df, kind in ((nodes, "Node"), (edges, "Edge")) if df is not None]
    return out[0] if len(out) == 1 else out[0].union(out[1])


def append_log(lines: DataFrame, path: str, *order: str) -> int:
    """Writes the lines as the log's next numbered folder, in the order of the named columns; the folder's number. One writer at a time."""
    n = max(runtime.numbers(lines.sparkSession, path), default=-1) + 1
    (lines.orderBy(*order) if order else lines).select("line").write.mode("overwrite").text(runtime.numbered(path, n))
    return n


# CSV of a social network, and Markdown notes


def read_social(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, labels, props) and edges (id, src, dst, rel) of person.csv, post.csv and knows.csv."""
    csv = lambda name, s: spark.read.csv(f"{folder}/{name}.csv", header=True, schema=s)
    p, q, k = csv("person", "id string, name string, gender string"), csv("post", "id string, content string"), csv("knows", "source_id string, target_id string")
    nodes = p.select("id", F.array(F.lit("Person")).alias("labels"), F.to_json(F.struct("name", "gender")).alias("props")).union(q.select("id", F.array(F.lit("Post")).alias("labels"), F.to_json(F.struct("content")).alias("props")))
    return nodes, k.select(F.concat_ws("-", F.lit("knows"), "source_id", "target_id").alias("id"), F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.lit("knows").alias("rel"))


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """(id, labels, props): a node a Markdown file, its front matter's single-line fields as JSON."""
    t = spark.read.text(f"{folder}/*.md", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("id"), F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---", 1).alias("head"))
    fields = F.filter(F.split("head", "\n"), lambda x: x.rlike(r"^[^:#\s][^:]*:"))
    as_map = F.map_from_entries(F.transform(fields, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]*):(.*)$", 1)), F.trim(F.regexp_extract(x, r"^([^:]*):(.*)$", 2)))))
    return t.select("id", F.array(F.lit("Note")).alias("labels"), F.to_json(as_map).alias("props"))


# The graph of the driver's tables


def business_nodes(spark: SparkSession, sf_dir: str, only: str | None = None, key: int | None = None) -> DataFrame:
    """(id, labels, props, valid_from, valid_to, expires_at, impact). only: of the table with this prefix; key: only that row of it."""
    t = lambda n: table(spark, sf_dir, n)
    none, start = F.lit(None).cast("timestamp"), F.lit("1992-01-01 00:00:00").cast("timestamp")

    def rows(prefix, label, name, stability, since=start):
        source, column = KEYS[prefix]
        df = t(source) if key is None else t(source).where(F.col(column) == key)
        return df.select(
            F.concat(F.lit(f"{prefix}-"), F.col(column).cast("string")).alias("id"), F.array(F.lit(label)).alias("labels"),
            F.concat(F.lit('{"name":"'), name, F.lit('","stability":"'), stability, F.lit('"}')).alias("props"), since.cast("timestamp").alias("valid_from"),
        )

    status = F.when(F.col("o_orderstatus") == "F", "stable").when(F.col("o_orderstatus") == "O", "active").otherwise("draft")
    kinds = {
        "R": ("Master", F.col("r_name"), F.lit("stable")), "N": ("Spec", F.col("n_name"), F.lit("stable")), "S": ("Adr", F.col("s_name"), F.lit("active")), "C": ("Customer", F.col("c_name"), F.lit("active")),
        "P": ("Part", F.col("p_name"), F.lit("deprecated")), "O": ("Order", F.col("o_orderpriority"), status, F.col("o_orderdate")),
    }
    out = reduce(DataFrame.union, (rows(p, *x) for p, x in kinds.items() if only in (None, p)))
    return out.select("id", "labels", "props", "valid_from", none.alias("valid_to"), none.alias("expires_at"), F.lit(0.7).alias("impact"))


#: By prefix of the id: table and key.
KEYS = {"R": ("region", "r_regionkey"), "N": ("nation", "n_nationkey"), "S": ("supplier", "s_suppkey"), "C": ("customer", "c_custkey"), "P": ("part", "p_partkey"), "O": ("orders", "o_orderkey")}


def business_node(spark: SparkSession, sf_dir: str, id_: str) -> DataFrame:
    """The node of an id: its prefix names the one table that is read, and the key reaches the scan."""
    prefix, _, key = id_.partition("-")
    known = prefix in KEYS and re.fullmatch(r"0|-?[1-9]\d{0,17}", key)
    return business_nodes(spark, sf_dir, prefix, int(key)) if known else business_nodes(spark, sf_dir).limit(0)


def business_edges(spark: SparkSession, sf_dir: str, distinct: Callable[[DataFrame], DataFrame] = DataFrame.distinct) -> DataFrame:
    """(id, src, dst, rel, valid_from, valid_to): LOCATED_IN, PART_OF, PLACED_BY, CONTAINS (for a year from shipping), SUPPLIED_BY. distinct: how pairs of part and supplier are made distinct."""
    t = lambda n: table(spark, sf_dir, n)
    none, start = F.lit(None).cast("timestamp"), F.lit("1992-01-01 00:00:00").cast("timestamp")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))

    def rows(df, id_, src, dst, rel, since=start, until=none):
        return df.select(id_.alias("id"), src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), since.cast("timestamp").alias("valid_from"), until.cast("timestamp").alias("valid_to"))

    return (
        rows(t("customer"), key("EC-", "c_custkey"), key("C-", "c_custkey"), key("N-", "c_nationkey"), "LOCATED_IN")
        .union(rows(t("supplier"), key("ES-", "s_suppkey"), key("S-", "s_suppkey"), key("N-", "s_nationkey"), "LOCATED_IN"))
        .union(rows(t("nation"), key("EN-", "n_nationkey"), key("N-", "n_nationkey"), key("R-", "n_regionkey"), "PART_OF"))
        .union(rows(t("orders"), key("EO-", "o_orderkey"), key("O-", "o_orderkey"), key("C-", "o_custkey"), "PLACED_BY", F.col("o_orderdate")))
        .union(rows(t("lineitem"), F.concat(key("EL-", "l_orderkey"), key("-", "l_linenumber")), key("O-", "l_orderkey"), key("P-", "l_partkey"), "CONTAINS", F.col("l_shipdate"), F.col("l_shipdate") + F.expr("INTERVAL 365 DAYS")))
        .union(rows(distinct(t("lineitem").select("l_partkey", "l_suppkey")), F.concat(key("EP-", "l_partkey"), key("-", "l_suppkey")), key("P-", "l_partkey"), key("S-", "l_suppkey"), "SUPPLIED_BY"))
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, embedding, cluster_id); the ids are the table's numbers."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding", F.col("label").alias("cluster_id"))


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of users: (id, event_id, event_type, value, valid_from, peer)."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("valid_from"), F.pmod("user_id", F.lit(4)).alias("peer"))
