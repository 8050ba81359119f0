"""What the operators of this package share: loading, lineage cuts and bounded sets."""

from __future__ import annotations

import logging
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger(__name__)
M64 = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bits of the largest set that may_have broadcasts, as a power of two (64 MiB).
MAX_LOG2 = 29


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session: what spark.checkpoint.dir names, which all machines share.

    Only a session that runs on this machine alone (tests, a laptop) gets a folder of its own where it names none.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="folioscan-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The rows as compressed Parquet in the shared folder, for tables too large to checkpoint plainly."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def may_have(members: DataFrame, column: str) -> Callable[[Column], Column]:
    """A condition on a column of longs: false only for values that are not members. Broadcasts a bit set of bounded size.

    A set with more than a member for every three bits (1.8e8 at the default size, where a quarter of all others would
    pass) gives the condition true: its callers then move every row, without a test that tells little.
    """
    n = members.count()
    if n > (1 << MAX_LOG2) // 3:
        LOG.warning("%d members are too many for a bit set of %d MiB: all rows are moved", n, (1 << MAX_LOG2) >> 23)
        return lambda x: x.isNotNull() | F.lit(True)
    bloom = members.sparkSession.sparkContext.broadcast(bloom_of(members, column, MAX_LOG2))

    @F.pandas_udf("boolean")
    def test(x: pd.Series) -> pd.Series:
        return pd.Series(bloom.value.test(x.to_numpy().view(np.uint64)))

    return test


def lean(run):
    """A function over Arrow batches that gives its memory back when its task ends; workers live on and share an executor."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library keeps its own counsel
                pass

    return tidy


def slices(batches, rows: int = 500):
    """Batches in smaller ones, so that only a few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def text_of(column: str) -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser on 64-bit words, vectorised."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Bloom:
    """A bit set of fixed size over 64-bit words. False positives only, so it may go before an exact step.

    The bit count is a power of two between 2**16 and 2**max_log2 (64 MiB at the default 29), whatever the number
    of members: a larger set costs more false positives, never a lost member and never a larger broadcast.
    """

    PROBES = 4

    def __init__(self, members: int, max_log2: int = 29):
        self.log2 = min(max_log2, max(16, int(np.ceil(np.log2(16 * max(1, members))))))
        self.bits = np.zeros(1 << (self.log2 - 3), np.uint8)

    def places(self, x: np.ndarray):
        """For each probe the bits that the words go to."""
        for k in range(self.PROBES):
            yield mix64(x, k) >> np.uint64(64 - self.log2)

    def _bytes(self, x: np.ndarray):
        for p in self.places(x):
            yield (p >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))

    def add(self, x: np.ndarray) -> None:
        for at, bit in self._bytes(x):
            np.bitwise_or.at(self.bits, at, bit)

    def test(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for at, bit in self._bytes(x):
            hit &= (self.bits[at] & bit) != 0
        return hit


def bloom_of(words: DataFrame, column: str, max_log2: int = 29) -> Bloom:
    """Built in executors: places are dealt by block to tasks that set them; the driver receives their at most 1,024 blocks."""
    made = Bloom(words.count(), max_log2)
    log2 = made.log2
    width = max(6, log2 - 10)  # bits of a block, as a power of two

    def places(batches):
        import pyarrow as pa

        part = Bloom.__new__(Bloom)
        part.log2 = log2
        for b in batches:
            if b.num_rows:
                p = np.unique(np.concatenate(list(part.places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))))
                yield pa.RecordBatch.from_pydict({"block": pa.array((p >> np.uint64(width)).astype(np.int32)), "at": pa.array((p & np.uint64((1 << width) - 1)).astype(np.int32))})

    def bits(batches):
        import pyarrow as pa

        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            own, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            by = np.argsort(own, kind="stable")
            edges = np.flatnonzero(np.diff(own[by], prepend=-1))
            for i, run in zip(own[by][edges].tolist(), np.split(at[by], edges[1:]), strict=True):
                flags = blocks.setdefault(i, np.zeros(1 << (width - 3), np.uint8))
                np.bitwise_or.at(flags, run >> 3, np.uint8(1) << (run & 7).astype(np.uint8))
        for i, flags in blocks.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "bits": pa.array([flags.tobytes()], pa.binary())})

    dealt = words.select(F.col(column).cast("long")).mapInArrow(places, "block int, at int").repartition("block")
    for row in dealt.mapInArrow(bits, "block int, bits binary").collect():  # together as large as the bit set
        made.bits[row.block << (width - 3) : (row.block + 1) << (width - 3)] = np.frombuffer(row.bits, np.uint8)
    return made
