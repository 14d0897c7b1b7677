"""Event logs as streams: the latest version of each id, kept up by micro-batches or by streaming state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime
from ..operators import filters, sync
from ..sources import tables


def read(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of (position, line), of files in the folder or in folders under it."""
    s = spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).text(path)
    return s.select(F.lit(0).cast("bigint").alias("position"), F.col("value").alias("line"))


# A table of states as a base and a few deltas: a batch writes what it brings, and the base is written anew only when the deltas have grown to its half


def _manifest(spark: SparkSession, path: str, n: int) -> dict:
    return json.loads(spark.read.text(runtime.numbered(f"{path}/manifest", n)).first()[0])


def state(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """(key, kind, id, payload, clock): the state after the last batch, or after that of the number."""
    done = [n for n in runtime.numbers(spark, f"{path}/manifest") if number is None or n <= number]
    if not done:
        return spark.createDataFrame([], "key string, kind string, id string, payload string, clock struct<time: bigint, peer_id: string, batch: bigint, line: bigint, sub: int>")
    return sync.latest(spark.read.parquet(*_manifest(spark, path, done[-1])["parts"]), key="key")


def apply_batch(path: str, ratio: float = 0.5):
    """For foreachBatch: adds a batch's events to the state under path, the greatest clock first and of equal ones the later; replaying a batch changes nothing."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        lines = batch.withColumn("position", F.monotonically_increasing_id())
        clock = F.struct("time", "peer_id", F.lit(number).cast("bigint").alias("batch"), F.col("position").alias("line"), "sub").alias("clock")
        new = tables.events(lines).select(F.concat_ws(":", "kind", "id").alias("key"), "kind", "id", "payload", clock)
        delta = runtime.numbered(f"{path}/delta", number)
        sync.latest(new, key="key").write.mode("overwrite").parquet(delta)
        before = [n for n in runtime.numbers(spark, f"{path}/manifest") if n < number]
        old = _manifest(spark, path, before[-1]) if before else {"parts": [], "base": 0, "rows": 0}
        m = {"parts": [*old["parts"], delta], "base": old["base"], "rows": old["rows"] + spark.read.parquet(delta).count()}
        if old["parts"] and m["rows"] > ratio * m["base"]:
            base = runtime.numbered(f"{path}/base", number)
            sync.latest(spark.read.parquet(*m["parts"]), key="key").write.mode("overwrite").parquet(base)
            m = {"parts": [base], "base": spark.read.parquet(base).count(), "rows": 0}
        spark.createDataFrame([(json.dumps(m),)], "value string").coalesce(1).write.mode("overwrite").text(runtime.numbered(f"{path}/manifest", number))
        # What the last two states don't hold may go: a reader of the state before may still be at work.
        if len(before) > 1:
            held = {*m["parts"], *old["parts"]}
            for n in before[:-1]:
                for part in {*_manifest(spark, path, n)["parts"]} - held:
                    runtime.delete(spark, part)
                runtime.delete(spark, runtime.numbered(f"{path}/manifest", n))

    return run


def to_table(lines: DataFrame, path: str, checkpoint: str):
    """Starts a query that takes what is there and stops; state() reads the result."""
    return lines.writeStream.foreachBatch(apply_batch(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(events: DataFrame) -> DataFrame:
    """Streaming aggregate (update mode): the payload of the greatest clock by id. Older clocks that come late change nothing."""
    return events.groupBy("kind", "id").agg(F.max_by("payload", F.struct("time", "peer_id")).alias("payload"), F.max(F.struct("time", "peer_id")).alias("clock"))


def expiring(events: DataFrame, seconds: int) -> DataFrame:
    """Streaming state with a lifetime (append mode): of events (id, at, payload), a row (id, payload, at, expired_at) when nothing came for an id for so many seconds of event time; its state goes.

    The watermark is the events' own, so late events only count while their id is still held.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], own) -> Iterator[pd.DataFrame]:
        if own.hasTimedOut:
            at, payload = own.get
            own.remove()
            t = pd.Timestamp(at, unit="us")
            yield pd.DataFrame({"id": [key[0]], "payload": [payload], "at": [t], "expired_at": [t + pd.Timedelta(seconds=seconds)]})
            return
        best = own.get if own.exists else None
        for f in frames:
            for at, payload in zip(f["at"].astype("datetime64[us]").astype("int64"), f["payload"]):
                if best is None or (at, payload) > tuple(best):
                    best = (int(at), payload)
        if best is not None:
            own.update(tuple(best))
            own.setTimeoutTimestamp(max(best[0] // 1000 + seconds * 1000, own.getCurrentWatermarkMs() + 1))

    s = events.select("id", F.col("at").cast("timestamp_ntz").cast("timestamp").alias("at"), "payload").withWatermark("at", "0 seconds")
    return s.groupBy("id").applyInPandasWithState(run, "id string, payload string, at timestamp, expired_at timestamp", "at long, payload string", "append", "EventTimeTimeout")


def ephemeral(state_: DataFrame, now) -> DataFrame:
    """What of the state hasn't expired at the given time."""
    return filters.unexpired(state_, now)


def maintain(store, path: str, seconds: int = 3600, ticks=None):
    """A clock that runs the store's maintenance and saves a snapshot at every tick. ticks: another stream in the clock's place."""
    if ticks is None:
        ticks = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        trigger = {"processingTime": f"{seconds} seconds"}
    else:
        trigger = {"availableNow": True}
    return ticks.writeStream.foreachBatch(lambda _, n: (store.optimize(), store.save(path))).trigger(**trigger).start()
