"""Jobs as an append-only log of events; a job's state is its last event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE, TERMINAL = ("pending", "running"), ("done", "failed", "orphaned")
RETENTION_DAYS = 7


def latest(events: DataFrame) -> DataFrame:
    """(job_id, state, kind, started_at, finished_at, n_events) from (job_id, seq, kind, state, at). Events after a terminal state count by their order too."""
    last = F.max_by(F.struct("state", "kind", "at"), "seq")
    out = events.groupBy("job_id").agg(last.alias("last"), F.min("at").alias("started_at"), F.count(F.lit(1)).alias("n_events"))
    done = F.when(F.col("last.state").isin(*TERMINAL), F.col("last.at"))
    return out.select("job_id", F.col("last.state").alias("state"), F.col("last.kind").alias("kind"), "started_at", done.alias("finished_at"), "n_events")


def recover(jobs: DataFrame) -> DataFrame:
    """After a restart nothing runs: jobs that were active are orphaned."""
    return jobs.withColumn("state", F.when(F.col("state").isin(*ACTIVE), "orphaned").otherwise(F.col("state")))


def retain(jobs: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Without jobs that ended more than some days ago."""
    return jobs.where(F.col("finished_at").isNull() | (F.col("finished_at") >= now - F.expr(f"interval {days} days")))


def job_list(jobs: DataFrame, limit: int = 50) -> DataFrame:
    return jobs.orderBy(F.desc("started_at"), "job_id").limit(max(1, min(500, int(limit))))


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total).otherwise(F.lit(0.0))
