"""Streams: resumable file ingest, windowed counts with late data, sessions, and stateful hash chains."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files: int = 1000) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one of spark.checkpoint.dir, which all machines share."""
    import uuid

    from attestor.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def ingest(stream: DataFrame, target: str, checkpoint: str, *keys: str):
    """Appends each new key once (null is a key too); the target gains a partition `batch` and is never read.

    The keys seen are state of the stream, beside the cursor in the checkpoint; a batch that is run again replaces its own
    partition. `availableNow` ends after what is there.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.dropDuplicates(list(keys)).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, at: str, key: str, late: str = "1 hour", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, end, key, n): counts by event time; rows later than the watermark are dropped."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    g = events.withWatermark(at, late).groupBy(w, key).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    g = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count("*").alias("n"))
    return g.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), key, "n")


def chained(events: DataFrame, key: str, order: str, body: str) -> DataFrame:
    """(key, order, link): each link hashes the one before it, over the whole life of the stream; the head is the state.

    Within a trigger rows are chained in order; the stream must bring a key's rows in order.
    """
    import hashlib

    def step(k, frames, state):
        head = state.get[0] if state.exists else ""
        rows = pd.concat(list(frames)).sort_values(order)
        links = []
        for b in rows[body]:
            head = hashlib.sha256((head + (b or "")).encode()).hexdigest()
            links.append(head)
        state.update((head,))
        yield pd.DataFrame({key: rows[key].to_numpy(), order: rows[order].to_numpy(), "link": links})

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, link string", "head string", "append", "NoTimeout")
