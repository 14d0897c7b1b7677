"""What operators share about running on a cluster."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a checked side of a join is broadcast; beyond it the join shuffles. What operators broadcast has less than 200 bytes a row.
BROADCAST_ROWS = 250_000
#: Rows of a task that sorts or groups them, where operators choose the number of tasks: its memory then doesn't grow with the table.
TASK_ROWS = 400_000
#: Bytes up to which blocks of rows are broadcast.
BROADCAST_BYTES = 64 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A temporary one only where none is set and all tasks run on this machine, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
        if not named and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lumengraph-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with files that every executor can read, so a lost executor costs nothing that was done."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def at_most(df: DataFrame, n: int) -> bool:
    return df.limit(n + 1).count() <= n


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """broadcast(df) if it has at most so many rows, else df itself, which then joins by shuffle."""
    return F.broadcast(df) if at_most(df, rows) else df


def spread(df: DataFrame, *by: str, rows: int | None = None) -> DataFrame:
    """df by hash in as many partitions as let a task hold about TASK_ROWS of its rows, or of so many rows as told; no fewer than the session has. What joins or groups it by these columns keeps the partitions."""
    n = -(-(df.count() if rows is None else rows) // TASK_ROWS)
    return df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *by) if n > 1 else df


def in_blocks(df: DataFrame, size: int, *by: str, most_tasks: int = 10_000) -> DataFrame:
    """(by, rows): df's rows, gathered by a hash into blocks of about so many within each value of by, each an array of structs of the other columns."""
    rest = [c for c in df.columns if c not in by]
    if by:
        n = df.groupBy(*by).agg(F.ceil(F.count("*") / size).alias("_blocks"))
        df = df.join(n, [*by])
    else:
        df = df.withColumn("_blocks", F.lit(max(1, -(-df.count() // size))).cast("bigint"))
    df = df.withColumn("_block", F.pmod(F.xxhash64(*rest), "_blocks"))
    if not by:
        df = df.repartition(min(max(1, -(-df.count() // size)), most_tasks), "_block")
    return df.groupBy(*by, "_block").agg(F.collect_list(F.struct(*rest)).alias("rows")).select(*by, "rows")


def block_pairs(left: DataFrame, right: DataFrame, row_bytes: int) -> DataFrame:
    """(left, right): every block of the one beside every block of the other. Blocks of few bytes are broadcast; more meet as a Cartesian product of tasks."""
    r = right.select(F.col("rows").alias("right"))
    small = (r.agg(F.coalesce(F.sum(F.size("right")), F.lit(0))).first()[0] * row_bytes) <= BROADCAST_BYTES
    return left.select(F.col("rows").alias("left")).crossJoin(F.broadcast(r) if small else r)


# Folders of numbered parts, on whatever file system the path is


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbered folders under a path that were written to their end, in order."""
    fs, p = _files(spark, path)
    if not fs.exists(p):
        return []
    found = [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory() and x.getPath().getName().isdigit()]
    return sorted(int(n) for n in found if fs.exists(_files(spark, f"{path}/{n}/_SUCCESS")[1]))


def numbered(path: str, n: int) -> str:
    return f"{path}/{n:010d}"


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _files(spark, path)
    fs.delete(p, True)


def finish(spark: SparkSession, path: str) -> None:
    """Marks a folder as written to its end, as Spark marks those that it writes itself."""
    fs, p = _files(spark, f"{path}/_SUCCESS")
    fs.create(p, True).close()
