"""Removal of repeated byte strings with difference-cover suffix arrays.

Every string of LENGTH bytes chooses an anchor by its bytes alone, so equal strings choose equal anchors at equal places. A
first pass counts the anchors of all texts; a second one cuts out, for each anchor that repeats, the bytes of the strings
that chose it (their context). Contexts are merged by their bytes; one that occurs twice is repeated as a whole, as its
suffixes are neighbours in any order. The distinct contexts of an anchor meet in one task, which sorts their suffixes by the difference-cover algorithm modulo three: name the sampled triples in sorted order, recurse
on the names until they differ, merge the suffixes that were not sampled, and compare the prefixes of neighbours; strings of
LENGTH bytes are repeated exactly where a neighbour shares them. So the sort is dealt out by anchor and only ever holds
what may repeat, while no repeated string is lost. One array over all bytes would have its triples and names shuffled at
every level of the recursion, which is dozens of times the input.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import bloom_of, checkpoint, fresh, lean, load, may_have, slices, text_of, written
from folioscan.llm.winnow import anchors

LENGTH = 200
#: Bytes of text that a pass holds at a time, characters of one suffix array, and contexts of an anchor beyond which it is split.
SLICE_BYTES, SORT_CHARS, BUCKET = 1_000_000, 400_000, 1024
#: Distinct contexts of a sorting task, about, and bytes of contexts that a task remembers having sent.
TASK_CONTEXTS, SENT_BYTES = 20_000, 16_000_000
#: Bits of a context's hash in the first and any further attempt; a new seed is taken where contexts that differ share one.
KEY_BITS = (64, 64, 64)
#: Rows of split anchors that are broadcast at most (20 bytes each); more of them are joined.
HOT_ROWS = 100_000


def _names(keys: np.ndarray, bits: int) -> np.ndarray:
    """Ranks from 1 of the keys among their distinct values."""
    if bits <= 24:
        there = np.zeros(1 << bits, np.int32)
        there[keys] = 1
        return np.cumsum(there)[keys]
    order = np.argsort(keys)
    new = np.ones(len(keys), np.int64)
    ranked = keys[order]
    new[1:] = ranked[1:] != ranked[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out


def suffix_array(s: np.ndarray, bits: int = 9) -> np.ndarray:
    """Places of all suffixes in sorted order; symbols are from 1 to 2**bits - 1."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    ones = np.arange(1, n + (n % 3 == 1), 3)  # with an empty suffix at n where the last place is a multiple of three
    twos = np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    if 3 * bits <= 63:
        names = _names(t[sample] << 2 * bits | t[sample + 1] << bits | t[sample + 2], 3 * bits)
    else:
        pair = _names(t[sample] << bits | t[sample + 1], 2 * bits)
        names = _names(pair << bits | t[sample + 2], 63)
    rank = np.zeros(n + 4, np.int64)
    top = int(names.max())
    if top == len(sample):
        order = np.empty(len(sample), np.int64)
        order[names - 1] = np.arange(len(sample))
    else:
        order = suffix_array(names, max(2, int(top + 1).bit_length()))
    sampled = sample[order]
    rank[sampled] = np.arange(1, len(sampled) + 1)
    sampled = sampled[sampled < n]
    zeros = np.arange(0, n, 3)
    width = int(rank.max() + 1).bit_length()
    zeros = zeros[np.argsort(t[zeros] << width | rank[zeros + 1])]
    # Where the others go among the sampled ones: by one symbol and a rank against places 1, by two symbols against places 2.
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(t[one] << width | rank[one + 1], t[zeros] << width | rank[zeros + 1])
    if 2 * bits + width <= 63:
        key = lambda i: t[i] << (bits + width) | t[i + 1] << width | rank[i + 2]
        before = before + np.searchsorted(key(two), key(zeros))
    else:
        both = np.concatenate([two, zeros])
        key = _names(_names(t[both] << bits | t[both + 1], 2 * bits) << width | rank[both + 2], 63)
        before = before + np.searchsorted(key[: len(two)], key[len(two) :])
    out = np.empty(n, np.int64)
    place = before + np.arange(len(zeros))
    out[place] = zeros
    rest = np.ones(n, bool)
    rest[place] = False
    out[rest] = sampled
    return out


def repeated_windows(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each of these distinct strings, which of its substrings of `length` bytes (by start) occur again among them."""
    ends = np.cumsum([len(c) + 1 for c in contexts])
    data = np.frombuffer(b"\x00".join(contexts) + b"\x00" * 9, np.uint8)  # the strings' own zeros are kept apart below
    symbols = data[: ends[-1]].astype(np.int64) + 2
    symbols[ends - 1] = 1
    starts = ends - np.array([len(c) + 1 for c in contexts])
    windows = np.zeros(ends[-1] + 1, np.int32)
    count = np.array([len(c) for c in contexts]) - length + 1
    some = count > 0
    np.add.at(windows, starts[some], 1)
    np.add.at(windows, (starts + count)[some], -1)
    order = suffix_array(symbols)
    order = order[np.cumsum(windows[:-1])[order] > 0]
    words = np.lib.stride_tricks.as_strided(data[: len(data) - 7].view(np.uint8), (len(data) - 7, 8), (1, 1))
    left, right = order[:-1], order[1:]
    alive = np.arange(len(left))
    for at in [*range(0, length - 7, 8), *([max(0, length - 8)] if length % 8 else [])]:
        alive = alive[(words[left[alive] + at] == words[right[alive] + at])[:, :length].all(axis=1)]
    hit = np.zeros(len(data), bool)
    hit[left[alive]] = hit[right[alive]] = True
    return [hit[a : a + max(0, n)] for a, n in zip(starts.tolist(), count.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> list[int]:
    """Start and stop of each run of true flags, flat."""
    return np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))).tolist()


def _slices(batches, length: int, size: int):
    """Texts of (text binary) batches in slices of bounded size: lists of (number, text, offset, piece).

    A longer text is cut into pieces that overlap by all but one byte of `length`, so every string lies in just one.
    """
    part, held, number = [], 0, 0
    for b in batches:
        for t in b.column(0):
            text = memoryview(t.as_buffer())
            number += 1
            for at in range(0, max(1, len(text) - length + 1), size):
                part.append((number, text, at, text[at : at + size + length - 1]))
                held += len(part[-1][3])
                if held >= size:
                    yield part
                    part, held = [], 0
        if part:  # the texts are views of the batch
            yield part
            part, held = [], 0


def spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(sha binary of 16 bytes, spans array<long>): byte ranges (start, stop, flat, maybe overlapping) to remove from each distinct text of (text binary) rows; texts without any are left out. Equal rows repeat each other."""
    gram, size, most_sent = 1 << int(np.log2(length * 2 // 3)), SLICE_BYTES, SENT_BYTES
    spark = texts.sparkSession

    def count(batches):
        for part in _slices(batches, length, size):
            h, n = np.unique(anchors([x for _, _, _, x in part], length, gram)[0], return_counts=True)
            yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64)), "n": pa.array(n.astype(np.int32))})

    repeated = checkpoint(texts.mapInArrow(lean(count), "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    bloom = spark.sparkContext.broadcast(bloom_of(repeated, "h"))

    def cut(seed: int, bits: int):
        """A row for each string group of each text: its anchor and context hash and, where the task has not sent them yet, the context and the place."""

        def run(batches):
            from xxhash import xxh3_64_intdigest

            mask = (1 << bits) - 1
            sent: dict[tuple[int, int], bytes] = {}
            sent_bytes = 0
            known: dict[bytes, int] = {}
            for part in _slices(batches, length, size):
                h, first, last, data, starts = anchors([x for _, _, _, x in part], length, gram)
                maybe = np.flatnonzero(bloom.value.test(h)) if len(h) else np.zeros(0, np.int64)
                if not len(maybe):
                    continue
                raw = data.tobytes()
                of = np.searchsorted(starts, first[maybe], "right") - 1
                place = {}
                shas: dict[int, bytes] = {}
                for i in np.unique(of).tolist():  # equal texts have their places sent once
                    number, text = part[i][:2]
                    if number not in shas:
                        shas[number] = hashlib.sha256(text).digest()[:16]
                    place[i] = struct.unpack(">qq", shas[number]) if known.setdefault(shas[number], number) == number else None
                keys, contexts = [], []
                for x, a, z in zip(h[maybe].tolist(), first[maybe].tolist(), last[maybe].tolist(), strict=True):
                    c = raw[a : z + length]
                    k = xxh3_64_intdigest(c, seed) & mask
                    keys.append(k)
                    if sent.get((x, k)) == c:  # byte by byte; a context that differs under one hash is sent too
                        contexts.append(None)
                    else:
                        contexts.append(c)
                        sent[(x, k)] = c
                        sent_bytes += len(c) + 200
                if sent_bytes > most_sent:
                    sent.clear()
                    sent_bytes = 0
                if len(known) > 200_000:
                    known = {x: n for x, n in known.items() if n == part[-1][0]}
                places = [place[i] for i in of.tolist()]
                offset = np.array([x[2] for x in part], np.int64)
                yield pa.RecordBatch.from_pydict({
                    "h": pa.array(h[maybe].view(np.int64)), "key": pa.array(np.array(keys, np.uint64).view(np.int64)), "context": pa.array(contexts, pa.binary()),
                    "s1": pa.array([p and p[0] for p in places], pa.int64()), "s2": pa.array([p and p[1] for p in places], pa.int64()),
                    "at": pa.array(first[maybe] - starts[of] + offset[of]), "windows": pa.array((last - first + 1)[maybe].astype(np.int32)),
                })

        return run

    for seed, bits in enumerate(KEY_BITS):
        found = written(texts.mapInArrow(lean(cut(seed, bits)), "h long, key long, context binary, s1 long, s2 long, at long, windows int"))
        keys = checkpoint(found.groupBy("h", "key").agg(F.count(F.lit(1)).alias("n")))
        # What tasks sent is merged by its bytes. A hash of more than one context would make two rows here.
        contexts = written(found.where(F.col("context").isNotNull()).select("h", "key", "context").distinct())
        if contexts.count() == keys.count():
            break
    else:
        raise ValueError("contexts that differ share a hash under every seed")
    many = checkpoint(keys.groupBy("h").agg(F.count(F.lit(1)).alias("distinct")).where("distinct > 1"))
    hot = checkpoint(many.where(F.col("distinct") > BUCKET).select("h", F.ceil(F.col("distinct") / (BUCKET // 2)).cast("int").alias("blocks")))
    hot = F.broadcast(hot) if hot.count() <= HOT_ROWS else hot
    mine, blocks = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), F.coalesce("blocks", F.lit(1)).alias("blocks")
    dealt = contexts.where(may_have(many, "h")("h")).join(hot, "h", "left").select("h", "key", "context", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("h", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "blocks", "key", "context")

    def sort(batches):
        group, keys_, texts_, size = None, [], [], 0

        def flush():
            if len(keys_) > 1:
                runs = [(k, _runs(w)) for k, w in zip(keys_, repeated_windows(texts_, length), strict=True)]
                runs = [(k, r) for k, r in runs if r]
                if runs:
                    yield pa.RecordBatch.from_pydict({"h": pa.array([k[0] for k, _ in runs], pa.int64()), "key": pa.array([k[1] for k, _ in runs], pa.int64()), "runs": pa.array([r for _, r in runs], pa.list_(pa.int32()))})

        for b in batches:
            for h, i, j, blocks_, k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (h, i, j) != group:  # a split anchor's blocks hold the same contexts, so each is sorted alone
                    if size >= SORT_CHARS or blocks_ > 1 or group and group[2] > 0:
                        yield from flush()
                        keys_, texts_, size = [], [], 0
                    group = (h, i, j)
                keys_.append((h, k))
                texts_.append(c)
                size += len(c)
        yield from flush()

    # Sorting costs far more than its bytes tell, so the number of tasks is stated rather than left to be merged by size.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(many.agg(F.sum("distinct")).first()[0] or 0) // TASK_CONTEXTS))
    ordered = dealt.repartition(tasks, "h", "i", "j").sortWithinPartitions("h", "i", "j", "key")
    partly = ordered.mapInArrow(lean(sort), "h long, key long, runs array<int>")
    whole = keys.where("n > 1").select("h", "key", F.array(F.lit(0), F.lit(1 << 30)).alias("runs"))
    runs = checkpoint(partly.union(whole).groupBy("h", "key").agg(F.flatten(F.collect_list("runs")).alias("runs")))
    hits = found.where(F.col("s1").isNotNull()).select("h", "key", "s1", "s2", "at", "windows").join(runs, ["h", "key"])
    ranges = F.transform("runs", lambda x, i: F.col("at") + F.least(x, F.col("windows")) + F.when(i % 2 == 1, length - 1).otherwise(0))
    sha = F.unhex(F.concat(F.lpad(F.hex("s1"), 16, "0"), F.lpad(F.hex("s2"), 16, "0")))
    return hits.select("s1", "s2", ranges.alias("r")).groupBy("s1", "s2").agg(F.flatten(F.collect_set("r")).alias("spans")).select(sha.alias("sha"), "spans")


def text_key(text):
    """The first 128 bits of a text's SHA-256, by which its spans are known."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def merge(flat: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges; ranges that touch are one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def trimmed(docs: DataFrame, text_col: str = "text", length: int = LENGTH):
    """A test (on xxhash64 of a text's key) of which texts may lose bytes, and (sha, n_removed, n_spans, kept_sha256, kept binary) of each distinct text that does."""
    own = docs.select(F.encode(text_of(text_col), "UTF-8").alias("text"))
    cuts = checkpoint(spans(own, length))
    may_lose = may_have(cuts.select(F.xxhash64("sha").alias("h")), "h")
    texts = own.withColumn("sha", text_key(F.col("text"))).where(may_lose(F.xxhash64("sha"))).groupBy("sha").agg(F.first("text").alias("text"))

    def run(batches):
        for b in slices(batches):
            rows = []
            for sha, text, flat in zip(*(c.to_pylist() for c in b.columns), strict=True):
                runs, kept, at = merge(flat), [], 0
                for a, z in runs:
                    kept.append(text[at:a])
                    at = z
                kept = b"".join([*kept, text[at:]])
                rows.append((sha, sum(z - a for a, z in runs), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["sha", "n_removed", "n_spans", "kept_sha256", "kept"]) if rows else b.slice(0, 0)

    schema = "sha binary, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return may_lose, texts.join(cuts, "sha").select("sha", "text", "spans").mapInArrow(lean(run), schema)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    A byte goes if a string of `length` bytes that covers it starts anywhere else too. Null and empty texts have no bytes;
    repeated rows repeat each other's strings, so their long texts go entirely; null ids stay null, an empty table gives no
    rows, other columns are ignored.
    """
    text = F.encode(text_of(text_col), "UTF-8")
    base = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("sha"))
    lost = trimmed(docs, text_col, length)[1].select(F.col("sha").alias("id"), "n_removed", "n_spans", "kept_sha256")
    return base.join(checkpoint(lost), F.substring("sha", 1, 16) == F.col("id"), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", F.lower(F.hex("sha"))).alias("kept_sha256")
    )


def remove(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars", length: int = LENGTH) -> DataFrame:
    """The rows with the repeated bytes cut out of their texts; other columns stay, a column `n_chars` counts again.

    What a cut leaves of a character is dropped with it. Rows whose text nothing is cut from are not shuffled.
    """
    sha, kept = fresh(docs, "sha"), fresh(docs, "kept")
    may_lose, lost = trimmed(docs, text_col, length)
    tagged = docs.withColumn(sha, text_key(F.encode(text_of(text_col), "UTF-8")))
    lost = lost.select(F.col("sha").alias(sha), F.col("kept").alias(kept))

    @F.pandas_udf("string")
    def text(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else bytes(x).decode("utf-8", "ignore"))

    hit = may_lose(F.xxhash64(sha))
    cut = tagged.where(hit).join(written(lost), sha, "left")
    cut = cut.withColumn(text_col, F.when(F.col(kept).isNull(), F.col(text_col)).otherwise(text(kept)))
    if count_col in docs.columns:
        cut = cut.withColumn(count_col, F.length(text_of(text_col)).cast(docs.schema[count_col].dataType))
    return tagged.where(~hit).select(*docs.columns).union(cut.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(load(spark, sf_dir, "documents"))
