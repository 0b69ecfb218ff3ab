"""State over time: debounced drift, mark expiry, waves, idle slots; the same functions on batches and streams.

Event time drives everything, so a replay gives what the stream gave.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def debounced(events: DataFrame, quiet: str) -> DataFrame:
    """Bursts of a key that end once it has held still for ``quiet``: (key, start, stop, changes). Works on streams with a watermark."""
    held = events.groupBy("key", F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("changes"))
    return held.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "changes")


def expired(marks: DataFrame, now, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """Marks (key, at) still valid and those older than the limit."""
    limit = F.lit(now) - F.expr(f"INTERVAL {days} DAYS")
    return marks.where(F.col("at") >= limit), marks.where(F.col("at") < limit)


def waves(snapshots: DataFrame) -> DataFrame:
    """Snapshots (key, ts, content) numbered as waves; one that changed nothing records nothing."""
    by = Window.partitionBy("key").orderBy("ts", "content")
    changed = snapshots.withColumn("before", F.lag("content").over(by)).where(~F.col("content").eqNullSafe(F.col("before")))
    return changed.select("key", "ts", "content", F.row_number().over(by).cast("long").alias("wave"))


def upsert(state: DataFrame, updates: DataFrame, key: list[str], at: str) -> DataFrame:
    """The newest row of each key of state and updates; ties go to updates."""
    both = state.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    return both.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(at), F.desc("_new")))).where("_i = 1").drop("_i", "_new")


def drift(key, batches, state):
    """Stateful counts of changes since a key was last seen still: emits on a timeout."""
    if state.hasTimedOut:
        (n,) = state.get
        state.remove()
        yield pd.DataFrame({"key": [key[0]], "changes": [n]})
        return
    n = (state.get[0] if state.exists else 0) + sum(len(b) for b in batches)
    state.update((n,))
    state.setTimeoutDuration(1500)


def drift_stream(events: DataFrame) -> DataFrame:
    """A stream of (key, changes), each once a key has held still for 1.5 s of processing time."""
    return events.groupBy("key").applyInPandasWithState(drift, "key string, changes long", "n long", "update", "ProcessingTimeTimeout")


def replay(spark: SparkSession, path: str, schema: str, transform, out: str, checkpoint: str) -> DataFrame:
    """Runs a streaming transformation over what lies in a folder, to its end, into the files of another folder."""
    stream = transform(spark.readStream.schema(schema).parquet(path))
    query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)
