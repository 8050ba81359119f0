"""SimHash near-duplicates, compared bit-sliced.

`near_groups` links fingerprints. Two 64-bit fingerprints within RADIUS bits agree on two of six blocks at least, so they meet under one of fifteen pairs of
blocks. Inside such a group the fingerprints' bits lie in vertical planes; a pair's distance is counted plane by plane in
carry-save counters, 64 pairs to a word, and a word is abandoned once all its pairs exceed the radius. A group hands on
a spanning forest of its links, never its pairs; groups beyond GROUP fingerprints are compared in blocks of that size.

`similar_groups` links documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Sets that
similar share one of their smallest fifth of shingle hashes, under which they meet; 128-bit fingerprints compared
bit-sliced with a wide radius leave clusters of likely links, and inside a cluster the sets themselves decide.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import bloom_of, checkpoint, fresh, lean, load, may_have, mix64, slices, text_of, written
from folioscan.llm.graph import components, settle

RADIUS, SHINGLE, GROUP = 4, 4, 4096
#: First bit and width of the blocks; radius + 2 of them.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Similarity of sets of NEAR_SHINGLE words that links them, and the radius of their 128-bit fingerprints: at similarity 0.8
#: 19 bits differ on average, with a deviation of 4, so one pair in 10,000 differs in more than 35; of two unrelated texts 64 do.
SIMILARITY, NEAR_SHINGLE, NEAR_RADIUS = 0.8, 5, 35
#: Shingles and sets of a block in which a cluster's sets are compared.
NEAR_ITEMS, NEAR_ROWS = 2_000_000, 1024


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Majority bits of the XXH64 (seed 42) of word shingles, repeats included; A-Z are lower-cased."""
    from xxhash import xxh64_intdigest as h

    words = text.encode().lower().split()
    n = len(words) - size + 1
    if not words:
        return 0
    if n < 1:
        return h(b" ".join(words), 42)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = words[at : at + (1 << 16) + size - 1]
        hashes = np.array([h(b" ".join(w), 42) for w in zip(*(part[i:] for i in range(size)), strict=False)], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def shingle_set(text: str, size: int = NEAR_SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of the word shingles; A-Z are lower-cased, fewer words are one shingle, no words the number 0."""
    from xxhash import xxh64_intdigest as h

    words = text.encode().lower().split()
    if len(words) < size:
        return np.array([h(b" ".join(words), 42) if words else 0], np.uint64)
    found = [np.unique(np.array([h(b" ".join(w), 42) for w in zip(*(words[at + i : at + i + (1 << 16)] for i in range(size)), strict=False)], "<u8")) for at in range(0, len(words) - size + 1, 1 << 16)]
    return np.unique(np.concatenate(found))


def wide_fingerprint(items: np.ndarray) -> np.ndarray:
    """128 majority bits of a set of 64-bit hashes: of the hashes, and of what they mix to."""
    votes = [np.zeros(64, np.int64), np.zeros(64, np.int64)]
    for at in range(0, len(items), 1 << 16):
        part = items[at : at + (1 << 16)]
        for k, x in enumerate((part, mix64(part))):
            votes[k] += np.unpackbits(x.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * np.concatenate(votes) > len(items), bitorder="little").view("<u8")


def planes(words: np.ndarray) -> np.ndarray:
    """A row of bit planes for each bit of the fingerprints (of one or more words each); bit j of a row's words is that bit of fingerprint j."""
    words = words.reshape(len(words), -1)
    padded = np.concatenate([words, np.zeros(((-len(words)) % 64, words.shape[1]), np.uint64)])
    bits = np.unpackbits(np.ascontiguousarray(padded).astype("<u8").view(np.uint8), bitorder="little").reshape(len(padded), 64 * words.shape[1])
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def within(plane, valid: np.ndarray, radius: int = RADIUS, bits: int = 64) -> np.ndarray:
    """Which of the valid bits belong to pairs within the radius. plane(p, at): XOR of plane p in the words `at`."""
    at = np.flatnonzero(valid)
    size = max(1, radius.bit_length())
    counters, over = [np.zeros(len(at), np.uint64) for _ in range(size)], np.zeros(len(at), np.uint64)
    gone = dead = ~valid[at]
    for p in range(bits):
        carry = plane(p, at)
        for k in range(size):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if p % 8 == 7:
            more, same = over, _ALL
            for k in range(size - 1, -1, -1):
                if radius >> k & 1:
                    same = same & counters[k]
                else:
                    more, same = more | (same & counters[k]), same & ~counters[k]
            gone = more | dead
            live = gone != _ALL
            if not live.all():
                counters = [x[live] for x in counters]
                at, over, dead, gone = at[live], over[live], dead[live], gone[live]
            if not len(at):
                break
    out = np.zeros(len(valid), np.uint64)
    if len(at):
        out[at] = ~gone
    return out


def _bits(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.astype("<u8").view(np.uint8), bitorder="little"))


def _pack(flags: np.ndarray) -> np.ndarray:
    pad = (-len(flags)) % 64
    return np.packbits(np.concatenate([flags, np.zeros(pad, bool)]), bitorder="little").view("<u8")


def _hits(own: np.ndarray, radius: int):
    """Pairs of places (x, y) within the radius, once each and some with themselves, for 64 rows x at a time."""
    table = planes(own)
    n, width = len(own), table.shape[1]
    for q in range(0, n, 64):
        k, first = min(64, n - q), q // 64
        cols = width - first
        masks = np.where(np.unpackbits(np.ascontiguousarray(table[:, first : first + 1]).view(np.uint8), axis=1, bitorder="little")[:, :k] > 0, _ALL, np.uint64(0))
        valid = np.tile(_pack(np.arange(first * 64, width * 64) < n), k)
        hit = _bits(within(lambda p, at, m=masks, c=cols, f=first: table[p][f + at % c] ^ m[p][at // c], valid, radius, len(table)))
        yield q + hit // (cols * 64), first * 64 + hit % (cols * 64)


def link_groups(words: np.ndarray, edges: np.ndarray, radius: int = RADIUS, fits=None) -> np.ndarray:
    """For each place of groups laid end to end, the smallest place of its group that links reach; fits(x, y): which pairs within the radius are links at all."""
    labels = np.arange(len(words))
    sizes = np.diff(edges)
    small = sizes <= 64
    group = np.repeat(np.arange(len(sizes)), sizes)
    mine = np.flatnonzero(small[group])

    def link(x, y):
        if fits is not None:
            ok = fits(x, y)
            x, y = x[ok], y[ok]
        settle(labels, x, y)

    if len(mine):
        table, own = planes(words[mine]), group[mine]
        width = table.shape[1]
        for shift in range(1, int(sizes[small].max())):
            same = np.zeros(len(mine), bool)
            same[:-shift] = own[:-shift] == own[shift:]
            if not same.any():
                break

            def plane(p, at, shift=shift):
                row = table[p]
                next_ = row[np.minimum(at + 1, width - 1)]
                return row[at] ^ ((row[at] >> np.uint64(shift)) | (next_ << np.uint64(64 - shift)))

            hit = _bits(within(plane, _pack(same), radius, len(table)))
            link(mine[hit], mine[hit + shift])
    for g in np.flatnonzero(~small):
        lo = int(edges[g])
        for x, y in _hits(words[lo : int(edges[g + 1])], radius):
            link(lo + x, lo + y)
    return labels


def links(fingerprints: DataFrame, radius: int = RADIUS, group: int = GROUP) -> DataFrame:
    """Edges (a long, b long) of distinct fingerprints (fp long) whose components are those of all links within the radius."""
    if radius > 4:
        raise ValueError("six blocks find pairs within four bits")
    field = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << n) - 1)) for lo, n in BLOCKS]
    keys = [F.struct(F.lit(t).alias("t"), F.shiftleft(field[i], 11).bitwiseOR(field[j]).alias("k")) for t, (i, j) in enumerate(combinations(range(6), 2))]
    rows = fingerprints.select("fp", F.explode(F.array(*keys)).alias("x")).select("fp", "x.t", "x.k")
    half = group // 2
    hot = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select("t", "k", F.ceil(F.col("n") / half).cast("int").alias("blocks"))
    hot = checkpoint(hot)
    dealt = rows.join(hot, ["t", "k"], "left").withColumn("mine", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    groups = dealt.groupBy("t", "k", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")).agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches):
        for b in batches:
            at = 0
            lists = b.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            while at < len(lists):  # slices of bounded work
                end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 200_000)))
                part = lists.slice(at, end - at)
                values = part.flatten().to_numpy(zero_copy_only=False)
                labels = link_groups(values.view(np.uint64), np.concatenate([[0], np.cumsum(sizes[at:end])]), radius)
                own = np.flatnonzero(labels != np.arange(len(labels)))
                if len(own):
                    yield pa.RecordBatch.from_pydict({"a": pa.array(values[own]), "b": pa.array(values[labels[own]])})
                at = end

    return groups.select("fps").mapInArrow(lean(run), "a long, b long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "fp": pa.array(np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], np.uint64).view(np.int64))})

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {id_type}, fp long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id that links reach) of every row.

    Null and empty texts have fingerprint zero and link like any other. Null ids count as larger than all others; repeated
    rows share a component; an empty table gives no rows; other columns are ignored.
    """
    prints = checkpoint(fingerprints(docs, id_col, text_col, size))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct, radius))
    joined = checkpoint(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    # Both sides of the join that hands the minima out are written first, so that Spark can split a skewed root.
    lowest = checkpoint(joined.groupBy("root").agg(F.min("first").alias("component_id")))
    of = checkpoint(joined.join(lowest, "root").select("fp", "component_id"))
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _dealt(rows: DataFrame, keys: list[str], by: str, blocks: DataFrame) -> DataFrame:
    """The rows with i and j: where `blocks` (keys, blocks) splits a group, each row for every pair of blocks that its own is in."""
    joined = rows.join(blocks, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))
    joined = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return joined.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("blocks", "other")


def _clusters(base: DataFrame, similarity: float, radius: int, group: int) -> DataFrame:
    """(node, root) of rows (row, f1, f2, n, keys) that may be linked: under a shared key, within the radius, of like size."""
    repeated = checkpoint(base.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    bloom = base.sparkSession.sparkContext.broadcast(bloom_of(repeated, "key"))

    def spread(batches):
        for b in slices(batches, 5000):
            keys = b.column(4)
            of = np.repeat(np.arange(len(keys)), np.diff(keys.offsets.to_numpy()))
            flat = keys.flatten()
            hit = np.flatnonzero(bloom.value.test(flat.to_numpy().view(np.uint64))) if len(flat) else np.zeros(0, np.int64)
            part = pa.RecordBatch.from_arrays(b.columns[:4], names=["row", "f1", "f2", "n"]).take(pa.array(of[hit]))
            yield pa.RecordBatch.from_arrays([*part.columns, flat.take(pa.array(hit))], names=["row", "f1", "f2", "n", "key"])

    rows = base.select("row", "f1", "f2", "n", "keys").mapInArrow(lean(spread), "row long, f1 long, f2 long, n int, key long")
    blocks = checkpoint(repeated.where(F.col("n") > group).select("key", F.ceil(F.col("n") / (group // 2)).cast("int").alias("blocks")))
    met = _dealt(rows, ["key"], "row", blocks).groupBy("key", "i", "j").agg(F.collect_list(F.struct("row", "f1", "f2", "n")).alias("x")).where(F.size("x") > 1)

    def run(batches):
        for b in slices(batches, 2000):
            lists = b.column(0)
            edges = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            x = lists.flatten()
            row, f1, f2, n = (x.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            like = lambda p, q: np.minimum(n[p], n[q]) >= similarity * np.maximum(n[p], n[q]) - 1e-9  # noqa: B023, E731
            labels = link_groups(np.stack([f1, f2], 1).view(np.uint64), edges, radius, like)
            own = np.flatnonzero(labels != np.arange(len(labels)))
            if len(own):
                yield pa.RecordBatch.from_pydict({"a": pa.array(row[own]), "b": pa.array(row[labels[own]])})

    return components(met.select("x").mapInArrow(lean(run), "a long, b long"))


def verified(rows: np.ndarray, side: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], similarity: float, radius: int) -> np.ndarray:
    """Labels of rows whose sets are as similar as that, by their comparison; with two sides, only pairs across them. Pairs that links join already are not compared."""
    labels = np.arange(len(rows))
    sizes = np.array([len(s) for s in sets])
    across = len(np.unique(side)) > 1
    for x, y in _hits(prints, radius):
        keep = (x != y) & (np.minimum(sizes[x], sizes[y]) >= similarity * np.maximum(sizes[x], sizes[y]) - 1e-9)
        if across:
            keep &= side[x] != side[y]
        x, y = x[keep], y[keep]
        for at in range(0, len(x), 256):
            u, v = x[at : at + 256], y[at : at + 256]
            apart = labels[u] != labels[v]
            u, v = u[apart], v[apart]
            same = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(u.tolist(), v.tolist(), strict=True)], np.int64)
            linked = same >= similarity * (sizes[u] + sizes[v] - same) - 1e-9
            settle(labels, u[linked], v[linked])
    return labels


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = NEAR_SHINGLE, similarity: float = SIMILARITY, radius: int = NEAR_RADIUS, group: int = GROUP) -> DataFrame:
    """doc_id and component_id (smallest doc_id that links reach) of every row that has a link or a repeat; other rows are left out.

    Two texts link if their sets of shingles of `size` words have at least this Jaccard similarity. Null and empty texts
    have one shingle in common, so they link with each other. Null ids count as larger than all others, an empty table
    gives no rows, other columns are ignored.
    """
    id_type = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("text_sha", F.unhex(F.sha2("text", 256)))
    sketch = f"doc_id {id_type.simpleString()}, text_sha binary, sha binary, f1 long, f2 long, n int, keys array<long>"

    def summarise(batches):
        for b in slices(batches):
            sets = [shingle_set(t, size) for t in b.column(1).to_pylist()]
            prints = np.array([wide_fingerprint(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            keys = [s[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(0), "text_sha": b.column(2), "sha": pa.array([hashlib.sha256(s.tobytes()).digest() for s in sets], pa.binary()), "f1": pa.array(prints[:, 0]), "f2": pa.array(prints[:, 1]),
                "n": pa.array([len(s) for s in sets], pa.int32()), "keys": pa.array(keys, pa.list_(pa.int64())),
            })

    base = written(texts.mapInArrow(lean(summarise), sketch).withColumn("row", F.monotonically_increasing_id()))
    # Equal sets are one node, which weighs nothing more: its smallest row stands for it.
    nodes = checkpoint(base.groupBy("sha").agg(F.min("row").alias("node"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")))
    alone = written(base.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select("row", "text_sha", "f1", "f2", "n", "keys"))
    clusters = checkpoint(_clusters(alone, similarity, radius, group))
    members = checkpoint(alone.join(clusters.withColumnRenamed("node", "row"), "row").select("row", "text_sha", "root", "f1", "f2", "n"))
    many = members.groupBy("root").agg(F.sum(F.col("n").cast("long")).alias("items"), F.count(F.lit(1)).alias("rows"))
    blocks = checkpoint(many.select("root", F.greatest(F.ceil(F.col("items") / NEAR_ITEMS), F.ceil(F.col("rows") / NEAR_ROWS)).cast("int").alias("blocks")).where("blocks > 1"))
    may_link = may_have(members.select(F.xxhash64("text_sha").alias("h")), "h")
    wanted = texts.where(may_link(F.xxhash64("text_sha"))).select("text_sha", "text").dropDuplicates(["text_sha"]).join(members, "text_sha")

    def take_sets(batches):
        for b in slices(batches):
            sets = [shingle_set(t, size).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:5], pa.array(sets, pa.list_(pa.int64()))], names=["row", "root", "f1", "f2", "items"])

    sets = wanted.select("row", "text", "root", "f1", "f2").mapInArrow(lean(take_sets), "row long, root long, f1 long, f2 long, items array<long>")

    def decide(table: pa.Table) -> pa.Table:
        row, side = table.column("row").to_numpy(), table.column("mine").to_numpy()
        prints = np.stack([table.column("f1").to_numpy(), table.column("f2").to_numpy()], 1).view(np.uint64)
        items = table.column("items").combine_chunks()
        values, edges = items.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(np.diff(items.offsets.to_numpy()))])
        labels = verified(row, side, prints, [values[a:z] for a, z in zip(edges[:-1], edges[1:], strict=True)], similarity, radius)
        linked = np.flatnonzero(labels != np.arange(len(labels)))
        return pa.table({"a": pa.array(row[linked]), "b": pa.array(row[labels[linked]])})

    found = checkpoint(_dealt(sets, ["root"], "row", blocks).groupBy("root", "i", "j").applyInArrow(decide, "a long, b long"))
    roots = components(found).withColumnRenamed("root", "of")
    joined = checkpoint(nodes.join(roots, "node", "left").where("copies > 1 or of is not null").select("sha", "first", F.coalesce("of", "node").alias("of")))
    lowest = checkpoint(joined.groupBy("of").agg(F.min("first").alias("component_id")))
    of = checkpoint(joined.join(lowest, "of").select("sha", "component_id"))
    return base.select("doc_id", "sha").join(of, "sha").select("doc_id", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = NEAR_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near-duplicates (similar_groups), the one with the smallest id (null last, then by the text's hash), with all its columns.

    Rows with one text and id count as one. Only rows that may have to go are shuffled.
    """
    sha = fresh(docs, "sha")
    tagged = docs.withColumn(sha, F.unhex(F.sha2(text_of(text_col), 256)))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(sha).alias("sha"))
    groups = similar_groups(tagged.select(key.alias("doc_id"), F.col(text_col).alias("text")), size=size, similarity=similarity)
    gone = checkpoint(groups.where("doc_id <> component_id").select(F.col("doc_id.id").alias("gone_id"), F.col("doc_id.sha").alias("gone_sha")).distinct())
    doubt = may_have(gone.select(F.xxhash64("gone_sha").alias("h")), "h")(F.xxhash64(sha))
    left = tagged.where(doubt).join(gone, (F.col(sha) == F.col("gone_sha")) & F.col(id_col).eqNullSafe(F.col("gone_id")), "left_anti")
    return tagged.where(~doubt).select(*docs.columns).union(left.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(load(spark, sf_dir, "documents"))
