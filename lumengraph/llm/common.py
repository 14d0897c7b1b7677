"""Helpers that every operator of this folder shares."""

from __future__ import annotations

import sys
import tempfile
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that Python takes up at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Rows up to which a checked side of a join is broadcast; beyond it the join shuffles. What operators broadcast has less than 200 bytes a row.
BROADCAST_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def position(df: DataFrame, name: str) -> int | None:
    """The place of a column: the exact name first, else the first that differs by case only, else None."""
    if name in df.columns:
        return df.columns.index(name)
    return next((i for i, c in enumerate(df.columns) if c.lower() == name.lower()), None)


def numbered(df: DataFrame) -> DataFrame:
    """The same columns named __0, __1, ...: no extra column can clash with what an operator adds."""
    return df.toDF(*(f"__{i}" for i in range(len(df.columns))))


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, cast to the given types; a missing one is null, any other is left in the file."""
    own = numbered(df)
    at = {c: position(df, c) for c in wanted}
    return own.select(*((F.col(f"__{at[c]}") if at[c] is not None else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()))


def slices(batch: pa.RecordBatch, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows, and of about so many bytes at most: Python's copies of long texts stay small, whatever the session's batches are."""
    step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes)))
    for a in range(0, batch.num_rows, step):
        yield batch.slice(a, step)


def map_batches(df: DataFrame, fn: Callable[[dict[str, list], pa.RecordBatch], dict], schema: str, types_: dict[str, pa.DataType]) -> DataFrame:
    """mapInArrow over slices of batches; fn takes the columns as lists and returns lists or arrays by column."""
    kinds = list(types_.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                out = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}, b)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, (_, t) in ((out[n], (n, t)) for n, t in kinds)], names=[n for n, _ in kinds])

    return df.mapInArrow(run, schema)


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks: for caches that don't change results."""
    name = "_lumengraph_worker_store"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A temporary one only where none is set and all tasks run on this machine, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lumengraph-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder: lineage is cut, and a lost executor costs nothing that was done."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """broadcast(df) if it has at most limit rows, else df itself. df should be cheap to count: checkpointed."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def one_of_repeats(own: DataFrame, id_: F.Column, key: F.Column, known: F.Column) -> DataFrame:
    """own without the rows that repeat id and key where known holds: of those the one whose columns as JSON are least stays. An aggregate that combines on the map side, over repeated rows alone."""
    d = own.withColumn("_i", F.when(known, id_)).withColumn("_k", F.when(known, key))
    again = checkpointed(d.where("_k IS NOT NULL").groupBy("_i", "_k").count().where("count > 1").select("_i", "_k"))
    if not again.limit(1).count():
        return own
    match = F.col("_i").eqNullSafe(F.col("i")) & (F.col("_k") == F.col("k"))
    small, row = checked_broadcast(again.toDF("i", "k")), F.struct(*own.columns)
    first = d.join(small, match, "left_semi").groupBy("_i", "_k").agg(F.min_by(row, F.to_json(row)).alias("r")).select("r.*")
    return d.join(small, match, "left_anti").select(*own.columns).union(first)


def words(text) -> F.Column:
    """Number of whitespace-separated words; 0 for null and blank."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")
