"""Stateful upkeep as Structured Streaming: debounce, last use, and regeneration of stale text.

Each stream has a batch twin among the read operations with the same result on the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from taleweave.plans.shared import exists

#: A regeneration of an entity within this time of the one before is dropped.
DEBOUNCE_US = 2_000_000
#: Ids of a micro-batch that are sent to all tasks.
FEW_IDS = 100_000


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)


def debounce(events: DataFrame, key: str, at: str, row_id: str, gap_us: int = DEBOUNCE_US, idle: str = "1 hour") -> DataFrame:
    """Events (key, row_id) whose key had no event within ``gap_us`` before. State is one long per key
    and goes when a key is idle; rows later than the watermark are dropped by Spark. Rows with a null
    key or time are left out."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["at_us", "row_id"])
        last = state.get[0] if state.exists else None
        kept = []
        for t, r in zip(rows["at_us"], rows["row_id"]):
            if last is None or t - last >= gap_us:
                kept.append(r)
            last = t if last is None else max(last, t)
        state.update((int(last),))
        state.setTimeoutTimestamp(max(int(last) // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"key": [str(k[0])] * len(kept), "row_id": pd.Series(kept, dtype="int64")})

    keyed = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"), F.col(row_id).cast("long").alias("row_id"), F.col(at).cast("timestamp").alias("ts")
    )
    return keyed.withWatermark("ts", idle).groupBy("key").applyInPandasWithState(
        step, "key string, row_id long", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


def last_use(events: DataFrame, key: str, at: str) -> DataFrame:
    """Latest use per key as a stateful aggregate (complete mode); the batch twin cuts it to the newest."""
    return events.groupBy(F.col(key).cast("string").alias("key")).agg(F.max(at).alias("last_used"))


def regenerate(changes: DataFrame, embed, out: str, checkpoint: str):
    """Text changes (id, composite_text, at) in, snapshots out: per micro-batch the newest text per id is
    compared by hash with the newest snapshot, and only what differs is embedded and appended with
    delta = 1 - cosine to the vector before. ``embed`` is a pandas UDF from text to array<float>."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        new = rows.groupBy("id").agg(F.max_by("composite_text", "at").alias("text"), F.max("at").alias("at")).withColumn("hash", F.xxhash64("text"))
        if exists(out, spark):
            # Only the snapshots of what changed now are gone through; a batch's ids are few beside all there are.
            ids = F.broadcast(new.select("id")) if new.count() <= FEW_IDS else new.select("id")
            old = spark.read.parquet(out).join(ids, "id", "left_semi").groupBy("id").agg(F.max_by(F.struct("hash", "embedding"), "at").alias("o"))
        else:
            old = spark.createDataFrame([], "id string, o struct<hash: long, embedding: array<float>>")
        due = new.join(old, "id", "left").where("o is null or o.hash <> hash")
        made = due.withColumn("embedding", embed("text"))
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
        e, o = F.col("embedding"), F.col("o.embedding")
        made = made.withColumn("delta", F.when(F.col("o").isNotNull(), 1 - dot(e, o) / (F.sqrt(dot(e, e)) * F.sqrt(dot(o, o)))))
        made.select("id", "at", "hash", "embedding", "delta").write.mode("append").parquet(out)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
