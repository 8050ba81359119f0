"""Exact dedup by a Golomb-coded fingerprint exchange.

Every input partition (a sender) cuts its sorted distinct 64-bit fingerprints at the owners' ranges and sends each owner
one Golomb-Rice coded list. An owner decodes the lists, finds the fingerprints that more than one sender has, and answers
each sender with one bitmap over that sender's own list. Only rows whose fingerprint repeats are suspects; only their texts
are shuffled, and grouping by the text itself compares their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import checkpoint, fresh, lean, load, may_have, text_of, written

#: Fingerprints that an owner holds on average.
OWNER_ROWS = 1_000_000


def golomb_encode(values: np.ndarray, spread: int) -> bytes:
    """Sorted distinct uint64 below `spread` apart from a base: Rice codes, the unary and the binary parts apart."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, min(63, int(np.log2(max(1.0, spread / n * 0.69)))))
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.zeros(int(quotient.sum()) + n, np.uint8)
    unary[np.cumsum(quotient + 1) - 1] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if k else np.zeros((n, 0), np.uint8)
    head = np.array([n, k, len(unary)], "<u8").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def golomb_decode(code: bytes) -> np.ndarray:
    if not code:
        return np.zeros(0, np.uint64)
    n, k, m = (int(x) for x in np.frombuffer(code[:24], "<u8"))
    cut = 24 + (m + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code[24:cut], np.uint8), count=m))
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        low = np.unpackbits(np.frombuffer(code[cut:], np.uint8), count=n * k).reshape(n, k)
        gaps += (low.astype(np.uint64) << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)


def _slices(fps: np.ndarray, owners: int) -> list[np.ndarray]:
    """Sorted fingerprints cut into the owners' equal ranges."""
    width = -(-(1 << 64) // owners)
    return np.split(fps, np.searchsorted(fps, np.array([i * width for i in range(1, owners)], np.uint64)))


def suspects(fingerprints: DataFrame) -> DataFrame:
    """Rows of (sender int, fp long, ...) whose fp occurs more than once, found by the exchange.

    Returns all columns of those rows. A sender's rows are one input partition, so its group is bounded by a partition.
    """
    owners = max(8, -(-fingerprints.count() // OWNER_ROWS))
    width = -(-(1 << 64) // owners)

    def send(batches):
        own: dict[int, list[np.ndarray]] = {}
        for b in batches:
            who = b.column(0).to_numpy(zero_copy_only=False)
            fps = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for s in np.unique(who):
                own.setdefault(int(s), []).append(fps[who == s])
        for s, parts in own.items():
            cut = _slices(np.unique(np.concatenate(parts)), owners)
            some = [i for i, x in enumerate(cut) if len(x)]  # an owner that gets nothing has nothing to answer
            codes = [golomb_encode(cut[i] - np.uint64(i * width), width) for i in some]
            yield pa.RecordBatch.from_pydict({"owner": pa.array(some, pa.int32()), "sender": pa.array([s] * len(some), pa.int32()), "code": pa.array(codes, pa.binary())})

    def own(table: pa.Table) -> pa.Table:
        lists = [golomb_decode(c) for c in table.column("code").to_pylist()]
        values, times = np.unique(np.concatenate(lists), return_counts=True)
        again = values[times > 1]
        maps = [np.packbits(np.isin(x, again, assume_unique=True)).tobytes() for x in lists]
        return pa.table({"sender": table.column("sender"), "owner": table.column("owner"), "bits": pa.array(maps, pa.binary())})

    answers = fingerprints.select("sender", "fp").mapInArrow(lean(send), "owner int, sender int, code binary").groupBy("owner").applyInArrow(own, "sender int, owner int, bits binary")

    def receive(rows: pa.Table, maps: pa.Table) -> pa.Table:
        fps = rows.column("fp").to_numpy().view(np.uint64)
        values, inverse, times = np.unique(fps, return_inverse=True, return_counts=True)
        hit = times > 1
        at = 0
        bits = dict(zip(maps.column("owner").to_pylist(), maps.column("bits").to_pylist(), strict=True))
        for i, x in enumerate(_slices(values, owners)):
            if len(x):
                hit[at : at + len(x)] |= np.unpackbits(np.frombuffer(bits[i], np.uint8), count=len(x)).astype(bool)
            at += len(x)
        return rows.filter(pa.array(hit[inverse]))

    return fingerprints.groupBy("sender").cogroup(answers.groupBy("sender")).applyInArrow(receive, fingerprints.schema)


def normal(text_col: str) -> Column:
    """The text with each run of white space as one space, null as empty."""
    return F.regexp_replace(text_of(text_col), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of texts that are equal once each run of white space is one space.

    Returns one row for each input row: doc_id, keep_id, group_size, kept, text_sha256. The row that stays has the
    smallest id of its group (null ids last; of repeated rows with that id, one stays). Null texts count as empty, empty
    texts are equal to each other, an empty table gives no rows, other columns are ignored.
    """
    norm = normal(text_col)
    base = checkpoint(
        docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm"))
        .select("doc_id", F.xxhash64("norm").alias("fp"), F.unhex(F.sha2("norm", 256)).alias("sha"), F.spark_partition_id().alias("sender"), F.monotonically_increasing_id().alias("row"))
    )
    doubtful = checkpoint(suspects(base.select("sender", "fp", "doc_id", "row", "sha")))
    may_repeat = may_have(doubtful.select("fp").distinct(), "fp")

    # The suspects' bytes: the aggregate's key is the text itself, so equal means equal byte by byte.
    texts = docs.select(norm.alias("norm")).withColumn("fp", F.xxhash64("norm")).where(may_repeat("fp")).groupBy("fp", "norm").agg(F.count(F.lit(1)).alias("n"))
    verified = (
        texts.where("n > 1").select(F.unhex(F.sha2("norm", 256)).alias("sha"), "n").groupBy("sha").agg(F.count(F.lit(1)).alias("texts"), F.first("n").alias("n"))
        .select("sha", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256")).cast("long")).otherwise(F.col("n")).alias("group_size"))
    )
    first = doubtful.groupBy("sha").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first"))
    # Written first, so that handing it out to the rows is a join whose skewed keys Spark can split.
    groups = checkpoint(verified.join(first, "sha").select("sha", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"))
    grouped = doubtful.select("row", "sha").join(groups, "sha").select("row", "keep_id", "keep_row", "group_size")
    return base.join(grouped, "row", "left").select(
        "doc_id",
        F.when(F.col("keep_row").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts (exact_groups says which), with all its columns; other rows are not shuffled."""
    sha, keep = fresh(docs, "sha"), fresh(docs, "keep")
    first = exact_groups(docs, id_col, text_col).where("group_size > 1 and kept").select(F.unhex("text_sha256").alias(sha), F.struct(F.col("doc_id").alias("id")).alias(keep))
    first = checkpoint(first)
    repeats = may_have(first.select(F.xxhash64(sha).alias("h")), "h")(F.xxhash64(sha))
    tagged = docs.withColumn(sha, F.unhex(F.sha2(normal(text_col), 256)))
    # Written before repeated rows are merged, so that a group of many copies is joined in tasks that Spark can split.
    doubtful = written(tagged.where(repeats).join(first, sha, "left").where(F.col(keep).isNull() | F.col(id_col).eqNullSafe(F.col(f"{keep}.id"))).drop(keep)).dropDuplicates([sha])
    return tagged.where(~repeats).select(*docs.columns).union(doubtful.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(load(spark, sf_dir, "documents"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
"""
