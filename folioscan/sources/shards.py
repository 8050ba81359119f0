"""Abstract shards: JSON files of {id: record}, one per month, from several feeds."""

from __future__ import annotations

import json
import logging
import shutil
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan import schema
from folioscan.functions.text import strip

LOG = logging.getLogger(__name__)
#: The JSON parser gives up on strings of over 20 million characters, and with them on the whole shard.
ANY_LENGTH = {"maxStringLen": str(2**31 - 1)}


@dataclass(frozen=True)
class Feed:
    """Where a domain's shards are. type: local (a checkout with data/) or github (a landing folder of downloaded shards)."""

    name: str
    type: str = "local"
    path: str | None = None
    repo: str | None = None
    branch: str = "main"


def is_shard(name: str) -> bool:
    return name.startswith("papers-") and name.endswith(".json")


def _glob_exists(spark: SparkSession, pattern: str) -> bool:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def scan(spark: SparkSession, folder: str, domain: str, feed: int = 0, names: str = "papers-*.json", written: tuple[str, ...] = ()) -> DataFrame:
    """Papers of one folder of shards with (feed, shard, pos), their order of appearance.

    A shard's keys are data, so a file is read whole and parsed as a map. A malformed shard gives no rows; a folder
    without shards gives none either. The fields of `written` come along as they stand in the records, too, as
    `written_<field>`: null if absent, not stripped.
    """
    pattern = f"{folder.rstrip('/')}/{names}"
    if not _glob_exists(spark, pattern):
        LOG.warning("no shards in %s", folder)
        return spark.createDataFrame([], ", ".join([schema.PAPER, *(f"written_{n} {t}" for n, t in _fields() if n in written), "feed int, shard string, pos int"]))
    raw = spark.read.text(pattern, wholetext=True).select("value", F.col("_metadata.file_name").alias("shard"))
    record = ",".join(f"{n}:{t}" for n, t in _fields())
    entries = raw.select("shard", F.posexplode(F.map_entries(F.from_json("value", f"map<string,struct<{record}>>", ANY_LENGTH))).alias("pos", "e"))
    same = [F.col(f"e.value.{n}").alias(f"written_{n}") for n, _ in _fields() if n in written]
    return entries.select(*to_paper("e.key", "e.value", domain), *same, F.lit(feed).alias("feed"), "shard", "pos")


def _fields() -> list[tuple[str, str]]:
    return [tuple(x.strip().split(" ", 1)) for x in schema.RECORD.split(", ")]


def to_paper(id_: str, record: str, domain: str) -> list:
    """The paper's columns from a record: absent strings are empty, absent lists too."""
    text = lambda n: F.coalesce(F.col(f"{record}.{n}"), F.lit("")).alias(n)
    many = lambda n: F.coalesce(F.col(f"{record}.{n}"), F.array().cast("array<string>")).alias(n)
    return [
        F.col(id_).alias("arxiv_id"), strip(text("title")).alias("title"), text("first_author"), many("authors"), text("abstract"), text("primary_category"), many("categories"),
        text("published"), text("updated"), text("pdf_url"), many("topics"), many("tags"), F.lit(domain).alias("domain"),
    ]


def load_feed(spark: SparkSession, feed: Feed, order: int = 0, landing: str | None = None) -> DataFrame:
    if feed.type == "local":
        if not feed.path:
            raise ValueError(f"source {feed.name} has no path")
        return scan(spark, f"{feed.path.rstrip('/')}/data", feed.name, order)
    if feed.type == "github":
        folder = Path(landing or ".") / feed.name
        prepare_landing(folder, repo=feed.repo or "", branch=feed.branch)
        return scan(spark, str(folder), feed.name, order)
    raise ValueError(f"source {feed.name} has the unknown type {feed.type}")


def prepare_landing(folder: Path, *, repo: str, branch: str) -> None:
    """Empty a landing folder that holds another repository's or branch's shards, and mark whose it is."""
    marker, own = folder / ".source.json", {"repo": repo, "branch": branch}
    if folder.exists():
        try:
            known = json.loads(marker.read_text())
        except (OSError, ValueError):
            known = None
        if known != own:
            shutil.rmtree(folder)
    folder.mkdir(parents=True, exist_ok=True)
    marker.write_text(json.dumps(own))


def merge(rows: DataFrame, dedup_domains: bool = False) -> DataFrame:
    """One row for each id: the record that came last, and the domains of all its records in order, comma-joined.

    `rows` carries (feed, shard, pos). A paper keeps the place where it first came (`first`), to break ties by.
    """
    at = F.struct("feed", "shard", "pos")
    names = [n.strip().split(" ")[0] for n in schema.PAPER.split(", ")]
    kept = [n for n in names if n not in ("arxiv_id", "domain")]
    domains = F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), "domain"))), lambda x: x["domain"])
    out = rows.groupBy("arxiv_id").agg(F.max_by(F.struct(*kept), at).alias("last"), domains.alias("domains"), F.min(at).alias("first"))
    joined = F.array_join(F.array_distinct("domains") if dedup_domains else F.col("domains"), ",")
    return out.select("arxiv_id", *(F.col(f"last.{n}").alias(n) for n in kept), joined.alias("domain"), "first").select(*names, "first")


def load_all(spark: SparkSession, feeds: list[Feed], landing: str | None = None, dedup_domains: bool = False) -> DataFrame:
    parts = [load_feed(spark, f, i, landing) for i, f in enumerate(feeds)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return merge(rows, dedup_domains)
