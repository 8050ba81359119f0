"""The refresh loop as a file stream: each micro-batch of landed rows goes through the same diff and merge as a batch refresh."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.operators.jobs import ACTIVE
from folioscan.sources.index_store import IndexStore


def is_stale(modified: float | None, now: float, interval_hours: float) -> bool:
    """Whether an index needs a refresh at start: it is missing or older than the interval."""
    return modified is None or now - modified > interval_hours * 3600


def refresh_stream(spark: SparkSession, stream: DataFrame, store: IndexStore, make: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "arxiv_id", interval: str | None = None):
    """Start the stream into a versioned index. With an interval it polls for ever, otherwise it takes what is there and ends.

    A batch replaces rows of its keys and adds the others, so one that is run again after a failure leaves the same rows;
    the index store has this stream as its only writer.
    """

    def batch(rows: DataFrame, _: int) -> None:
        new = make(rows.dropDuplicates([key]))
        old = store.load()
        store.save(new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new))
        store.drop_old()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def job_state_stream(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Counts of job events by state and hour of event time (`at`, a timestamp), with a watermark."""
    timed = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", lateness)
    return timed.groupBy(F.window("at", "1 hour").alias("hour"), "state").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("state").isin(*ACTIVE)).alias("n_active"))
