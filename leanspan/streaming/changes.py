"""The change feed as a stream: debouncing, coalescing and incremental application."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GAP = "500 milliseconds"
PATHS_MOST = 4096


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names; a temporary one only where none is set, as in local tests."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return tempfile.mkdtemp(prefix="leanspan")


def normalised(changes: DataFrame) -> DataFrame:
    """path, repository, kind, ts; equal deliveries are all kept."""
    return changes.filter("path is not null and ts is not null").select("path", F.split("path", "/")[0].alias("repository"), F.lower(F.trim("kind")).alias("kind"), "ts")


def bursts(changes: DataFrame, gap: str = GAP, most: int = PATHS_MOST, once: bool = False) -> DataFrame:
    """repository, started, ended, events, action: sessions of changes without a quiet gap.

    An action is ``full`` when more than ``most`` different paths are in a burst, else
    ``paths``.  ``once`` counts equal deliveries (path, kind, ts) as one event.  Works on
    a batch and on a stream alike: a stream takes no distinct count, so sets are sized.
    """
    events = F.size(F.collect_set(F.struct("path", F.coalesce("kind", F.lit("")), "ts"))).cast("long") if once else F.count("*")
    s = normalised(changes).groupBy("repository", F.session_window("ts", gap).alias("w")).agg(events.alias("events"), F.size(F.collect_set("path")).alias("different"), F.min("ts").alias("started"), F.max("ts").alias("ended"))
    return s.select("repository", "started", "ended", "events", F.when(F.col("different") > most, "full").otherwise("paths").alias("action"))


def stream_bursts(spark: SparkSession, directory: str, gap: str = GAP) -> DataFrame:
    """The bursts of a directory of change files, by a stream that takes what is there and stops."""
    schema = spark.read.parquet(f"{directory}/changes.parquet").schema
    # a stream reads a folder; the glob keeps other tables out of it
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(posixpath.join(directory, "changes.parquet*"))
    # equal deliveries are counted as the batch twin counts them
    out = f"{shared_folder(spark)}/bursts-{uuid.uuid4().hex}"
    query = (
        bursts(feed, gap).writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{out}/checkpoint")
        .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows")).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def coalesce_states(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Stateful twin of ``bursts`` for applyInPandasWithState: pending paths of a repository, sticky full, flushed by a timeout."""
    if state.hasTimedOut:
        paths, full = state.get
        state.remove()
        yield pd.DataFrame([(key[0], len(paths), "full" if full else "paths", sorted(paths))], columns=["repository", "paths", "action", "changed"])
        return
    paths, full = state.get if state.exists else ([], False)
    pending = set(paths)
    for b in batches:
        pending |= set(b["path"])
    full = full or len(pending) > PATHS_MOST
    state.update(([] if full else sorted(pending), full))
    state.setTimeoutDuration(500)


def apply_batch(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Incremental state of paths: the current rows (path, kind, ts) with a batch of changes merged by time."""
    both = current.select("path", "kind", "ts").unionByName(normalised(batch).select("path", "kind", "ts"))
    return both.groupBy("path").agg(F.max_by(F.struct("kind", "ts"), F.struct("ts", "kind")).alias("r")).select("path", "r.kind", "r.ts")


def event_windows(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """event_type, window_start, n, value: tumbling windows over event time (an extension)."""
    g = events.withWatermark("ts", "1 hour").groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return g.select("event_type", F.col("w.start").alias("window_start"), "n", "value")
