"""Upkeep of indexes: what is new, changed, deleted or unchanged, and the next version of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A file counts as changed if it is newer than its indexing by more than this.
SLACK_SECONDS = 1.0


def diff_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """(arxiv_id, change) of ids that were added or deleted."""
    a = new.select("arxiv_id").distinct().join(old.select("arxiv_id"), "arxiv_id", "left_anti").withColumn("change", F.lit("added"))
    d = old.select("arxiv_id").distinct().join(new.select("arxiv_id"), "arxiv_id", "left_anti").withColumn("change", F.lit("deleted"))
    return a.unionByName(d)


def classify(sources: DataFrame, indexed: DataFrame) -> DataFrame:
    """(arxiv_id, status) over source files (arxiv_id, mtime timestamp) and the index's papers (arxiv_id, indexed_at timestamp)."""
    s = sources.groupBy("arxiv_id").agg(F.max("mtime").alias("mtime")).withColumn("here", F.lit(True))
    i = indexed.groupBy("arxiv_id").agg(F.min("indexed_at").alias("indexed_at")).withColumn("known", F.lit(True))
    late = F.unix_micros("mtime") > F.unix_micros("indexed_at") + int(SLACK_SECONDS * 1_000_000)
    status = F.when(F.col("known").isNull(), "new").when(F.col("here").isNull(), "deleted").when(F.col("indexed_at").isNull() | late, "changed").otherwise("unchanged")
    return s.join(i, "arxiv_id", "full").select("arxiv_id", status.alias("status"))


def strategy(statuses: DataFrame, *, incremental: bool = True, same_model: bool = True, has_index: bool = True) -> str:
    """full, noop, append or mixed. One row of counts comes to the driver."""
    if not (incremental and same_model and has_index):
        return "full"
    n = statuses.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("new", "changed", "deleted"))).first()
    if n.changed or n.deleted:
        return "mixed"
    return "append" if n.new else "noop"


def merge_index(index: DataFrame, statuses: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index without papers that changed or went, and the rows that were made anew; unchanged rows are as they were."""
    gone = statuses.where(F.col("status").isin("changed", "deleted")).select("arxiv_id")
    return index.join(gone, "arxiv_id", "left_anti").unionByName(fresh)


def refresh_strategy(diff: DataFrame, *, full: bool, has_index: bool) -> tuple[str, int, int]:
    """(strategy, added, deleted): full if asked for, if anything was deleted or if there is no index; noop if nothing was added."""
    n = diff.agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "deleted").alias("deleted")).first()
    kind = "full" if full or n.deleted or not has_index else "incremental" if n.added else "noop"
    return kind, int(n.added), int(n.deleted)


def refresh(old: DataFrame, new: DataFrame, index: DataFrame | None, encode, full: bool = False) -> tuple[DataFrame | None, dict]:
    """The next vector index (arxiv_id, embedding) and a summary. An edited abstract keeps its vector unless everything is encoded; then rows are sorted by id."""
    diff = diff_ids(old, new)
    kind, added, deleted = refresh_strategy(diff, full=full, has_index=index is not None)
    if kind == "noop":
        out = index
    elif kind == "full":
        out = encode(new).repartitionByRange("arxiv_id").sortWithinPartitions("arxiv_id")
    else:
        out = index.unionByName(encode(new.join(diff.where("change = 'added'").select("arxiv_id"), "arxiv_id", "left_semi")))
    return out, {"strategy": kind, "added": added, "deleted": deleted}
