"""WARC records and a Merkle fixity audit between replicas.

Records lie in volumes of at most VOLUME_RECORDS, each with its offset there. A leaf hashes a record's bytes together with
its offset range; a node hashes its children's hashes and the range they span, FANOUT to a node, up to the volume's root;
the volumes' roots go on into one corpus tree. An audit compares the roots of two replicas and goes down below nodes that
differ only: a level's nodes pass a semi-join with their differing parents before any hashes are compared. A level is a flat
table, so the rows of intact branches are still scanned for that test, at 100 bytes or so each; records are not. All of it is DataFrame operations; no group has more than VOLUME_RECORDS rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from folioscan.llm.common import checkpoint, load

VOLUME_RECORDS, FANOUT = 1024, 16


def record_bytes(url: Column, body: Column, record_id: Column) -> Column:
    """A WARC/1.1 resource record: header, empty line, block, two line ends."""
    block = F.coalesce(body.cast("string"), F.lit(""))
    uri = F.regexp_replace(F.coalesce(url.cast("string"), F.lit("")), r"[\r\n]", "")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), F.coalesce(record_id.cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Block-Digest: sha256:"), F.sha2(block.cast("binary"), 256),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.encode(F.concat(head, block, F.lit("\r\n\r\n")), "UTF-8")


def parse_record(record: Column) -> Column:
    """record_id, url, digest and body of a record's bytes, the inverse of record_bytes."""
    text = F.decode(record, "UTF-8")
    head = F.substring_index(text, "\r\n\r\n", 1)
    size = F.regexp_extract(head, r"Content-Length: (\d+)", 1).cast("long")
    start = F.octet_length(head) + 4
    return F.struct(
        F.regexp_extract(head, r"<urn:record:([^>]*)>", 1).alias("record_id"), F.regexp_extract(head, r"WARC-Target-URI: ([^\r]*)", 1).alias("url"),
        F.regexp_extract(head, r"sha256:([0-9a-f]{64})", 1).alias("digest"), F.decode(F.substring(record, start + 1, size), "UTF-8").alias("body"),
    )


def index_records(records: DataFrame, record_col: str = "record", id_col: str = "record_id") -> DataFrame:
    """volume, n, record_id, start, stop and leaf hash of each record of (volume long, n long, record_id, record binary)."""
    leaf = records.select("volume", "n", F.col(id_col).alias("record_id"), F.octet_length(record_col).cast("long").alias("size"), F.sha2(record_col, 256).alias("sha"))
    within = W.partitionBy("volume").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    return leaf.withColumn("stop", F.sum("size").over(within)).select("volume", "n", "record_id", (F.col("stop") - F.col("size")).alias("start"), "stop", "sha").withColumn(
        "hash", F.sha2(F.concat_ws("|", F.lit("leaf"), "start", "stop", "sha"), 256)
    )


def _parents(nodes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One level up: FANOUT neighbours under each parent."""
    kids = F.array_sort(F.collect_list(F.struct(at, "start", "stop", "hash")))
    return nodes.groupBy(*keys, F.floor(F.col(at) / FANOUT).cast("long").alias("up")).agg(kids.alias("kids")).select(
        *keys, F.col("up").alias(at), F.col("kids")[0]["start"].alias("start"), F.element_at("kids", -1)["stop"].alias("stop"),
        F.sha2(F.concat_ws("|", F.lit("node"), F.transform("kids", lambda k: F.concat_ws(":", k["start"].cast("string"), k["stop"].cast("string"), k["hash"]))), 256).alias("hash"),
    )


def build_tree(index: DataFrame) -> list[DataFrame]:
    """Levels (volume, n, start, stop, hash) from the leaves to one corpus root, each written to the checkpoint folder.

    Inside a volume `n` counts nodes of the level; above the volumes `volume` counts nodes and n is 0. An empty table has
    no level.
    """
    level = checkpoint(index.select("volume", "n", "start", "stop", "hash"))
    levels, width = [level], VOLUME_RECORDS
    while width > 1:
        width = -(-width // FANOUT)
        levels.append(_parents(levels[-1], ["volume"], "n").select("volume", "n", "start", "stop", "hash"))
    levels[-1] = checkpoint(levels[-1])
    count = levels[-1].count()
    if not count:
        return []
    while count > 1:
        up = _parents(levels[-1].drop("n").withColumn("start", F.lit(0).cast("long")), [], "volume").select("volume", F.lit(0).cast("long").alias("n"), "start", "stop", "hash")
        levels.append(checkpoint(up))
        count = levels[-1].count()
    return levels


def audit(left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """Leaves (volume, n, left_hash, right_hash) that differ or are on one side only, found from the roots down."""
    if not left and not right:
        raise ValueError("both trees are empty")
    if not left or not right:
        side = left or right
        return side[0].select("volume", "n", *(F.when(F.lit(bool(x)), F.col("hash")).alias(k) for x, k in ((left, "left_hash"), (right, "right_hash"))))
    inner = 1
    width = VOLUME_RECORDS
    while width > 1:
        width, inner = -(-width // FANOUT), inner + 1
    top = max(len(left), len(right))
    at = [(x + [None] * (top - len(x))) for x in (left, right)]
    found = None
    for k in range(top - 1, -1, -1):
        if at[0][k] is None or at[1][k] is None:
            continue
        sides = []
        for levels in at:
            nodes = levels[k]
            if found is not None:
                if k >= inner - 1:  # children of corpus nodes: the volumes below
                    nodes = nodes.withColumn("pv", F.floor(F.col("volume") / FANOUT).cast("long")).join(found.select(F.col("volume").alias("pv")), "pv", "left_semi").drop("pv")
                else:
                    nodes = nodes.withColumn("pn", F.floor(F.col("n") / FANOUT).cast("long")).join(found.select("volume", F.col("n").alias("pn")), ["volume", "pn"], "left_semi").drop("pn")
            sides.append(nodes)
        a, b = sides[0].select("volume", "n", F.col("hash").alias("left_hash")), sides[1].select("volume", "n", F.col("hash").alias("right_hash"))
        found = a.join(b, ["volume", "n"], "full").where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
        if k:
            found = checkpoint(found)
    return found


def archive(pages: DataFrame) -> DataFrame:
    """(volume, n, record_id, record) of every page: VOLUME_RECORDS consecutive rows of an input partition are a volume.

    Null urls and bodies count as empty, a null page_id is the record `none`; repeated rows are records of their own.
    """
    at = F.monotonically_increasing_id()
    rows = pages.select("page_id", "url", "html", at.alias("at"))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    volume = F.floor(row / VOLUME_RECORDS).cast("long") * F.lit(max(1, pages.rdd.getNumPartitions())) + part
    return rows.select(volume.alias("volume"), (row % VOLUME_RECORDS).alias("n"), F.col("page_id").alias("record_id"), record_bytes(F.col("url"), F.col("html"), F.col("page_id")).alias("record"))


def damaged(records: DataFrame) -> DataFrame:
    """A replica with known faults: of the records whose id leaves 7 when divided by 500, one byte in the middle is changed."""
    hit = F.pmod(F.col("record_id").cast("long"), F.lit(500)) == 7
    half = F.floor(F.octet_length("record") / 2).cast("int")
    byte = F.substring("record", half + 1, F.lit(1))
    other = F.when(byte == F.lit(b"x"), F.lit(b"y")).otherwise(F.lit(b"x"))
    broken = F.concat(F.substring("record", F.lit(1), half), other, F.substring("record", half + 2, F.octet_length("record")))
    return records.withColumn("record", F.when(hit, broken).otherwise(F.col("record")))


def audit_pages(pages: DataFrame) -> DataFrame:
    """Archive the pages, damage a replica, and audit it: a row for each page with its range, hashes and verdict."""
    records = archive(pages)
    primary = checkpoint(index_records(records))
    replica = checkpoint(index_records(damaged(records)))
    trees = build_tree(primary), build_tree(replica)
    out = primary.select("volume", "n", F.col("record_id").alias("page_id"), (F.col("stop") - F.col("start")).alias("n_bytes"), F.col("sha").alias("record_sha256"))
    if not trees[0]:
        return out.select("page_id", "n_bytes", "record_sha256", F.lit(False).alias("corrupt"))
    bad = audit(*trees).select("volume", "n", F.lit(True).alias("corrupt"))
    return out.join(bad, ["volume", "n"], "left").select("page_id", "n_bytes", "record_sha256", F.coalesce("corrupt", F.lit(False)).alias("corrupt"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_pages(load(spark, sf_dir, "pages"))


SQL = r"""
WITH r AS (
  SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:'
    || coalesce(CAST(page_id AS VARCHAR), 'none') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\r\n]', '', 'g')
    || chr(13) || chr(10) || 'WARC-Block-Digest: sha256:' || sha256(coalesce(html, '')) || chr(13) || chr(10) || 'Content-Type: text/html'
    || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM pages)
SELECT page_id, strlen(rec) AS n_bytes, sha256(rec) AS record_sha256, coalesce(((page_id % 500) + 500) % 500 = 7, false) AS corrupt FROM r
"""
