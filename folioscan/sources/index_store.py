"""Versioned tables: each version is a folder of its own, and a pointer file that is renamed into place names the current one."""

from __future__ import annotations

import json
import time

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: A lock whose holder has not renewed it for so long belongs to nobody.
LOCK_SECONDS = 120.0


class IndexStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        at = self._path(f"{self.root}/{name}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool = True) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}"), overwrite)
        out.write(text.encode())
        out.close()

    def version(self) -> int | None:
        """The current version; None before the first."""
        current = self._read("_CURRENT")
        return None if current is None else int(current)

    def load(self) -> DataFrame | None:
        n = self.version()
        return None if n is None else self.spark.read.parquet(f"{self.root}/v={n}")

    def meta(self) -> dict:
        """What the current version was saved with."""
        n = self.version()
        return {} if n is None else json.loads(self._read(f"v={n}/_meta.json") or "{}")

    def save(self, rows: DataFrame, meta: dict | None = None) -> int:
        """Write the next version, then switch to it. A reader sees the old or the new one whole; a failed write changes nothing.

        A version's number is claimed by a file that only one writer can make, so no folder is written twice; a writer that
        finds another version current than the one it started from fails.
        """
        base = self.version()
        n = (base or 0) + 1
        while not self._fs.createNewFile(self._path(f"{self.root}/_claim-{n}")):
            n += 1
        rows.write.mode("errorifexists").parquet(f"{self.root}/v={n}")
        self._write(f"v={n}/_meta.json", json.dumps(meta or {}))
        if self.version() != base:
            raise RuntimeError(f"{self.root} has another version than {base} since this one was begun")
        self._write(f"_CURRENT.{n}", str(n))
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._jvm.org.apache.hadoop.fs.Options
        array = self.spark.sparkContext._gateway.new_array(options.Rename, 1)
        array[0] = options.Rename.OVERWRITE
        context.rename(self._path(f"{self.root}/_CURRENT.{n}"), self._path(f"{self.root}/_CURRENT"), array)
        return n

    def append(self, rows: DataFrame) -> None:
        """Add rows to the current version as new files."""
        n = self.version()
        if n is None:
            self.save(rows)
        else:
            rows.write.mode("append").parquet(f"{self.root}/v={n}")

    def lock(self, owner: str = "") -> bool:
        """Take the store for one writer; false if another has it. What its holder has not renewed in time is taken over."""
        if self.locked() is None:
            self._fs.delete(self._path(f"{self.root}/_LOCK"), False)
        try:
            self._write("_LOCK", json.dumps([owner, time.time()]), overwrite=False)
        except Py4JJavaError:  # it is there
            return False
        return True

    def locked(self) -> str | None:
        """Who holds the store; None if nobody does."""
        held = self._read("_LOCK")
        if held is None:
            return None
        try:
            owner, at = json.loads(held)
        except ValueError:  # being written
            return ""
        return owner if time.time() - at < LOCK_SECONDS else None

    def renew(self, owner: str) -> None:
        if self.locked() == owner:
            self._write("_LOCK", json.dumps([owner, time.time()]))

    def unlock(self, owner: str = "") -> None:
        """Let go of the store; another's lock stays."""
        if self.locked() in (None, owner):
            self._fs.delete(self._path(f"{self.root}/_LOCK"), False)

    def drop_old(self, keep: int = 2) -> None:
        """Remove all but the last versions."""
        n = self.version() or 0
        for status in self._fs.listStatus(self._path(self.root)):
            name = status.getPath().getName()
            number = name.removeprefix("v=").removeprefix("_claim-")
            if number != name and int(number) <= n - keep:
                self._fs.delete(status.getPath(), True)
