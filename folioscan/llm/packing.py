"""Packing token ids into windows by non-negative least squares.

A document gives full windows and a remainder. The remainders' histogram is matched by shallow combinations of two or
three lengths that fill a window exactly: repeat counts solve a non-negative least squares problem, are rounded, and what
they leave is packed greedily end to end and cut at the windows' edges. The last partial window is cut at its binary
digits, so that no sequence needs padding.

Each task packs blocks of its own partition, so there is no shuffle, and memory holds one block of tokens.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import lean, load, slices, text_of
from folioscan.llm.tokens import byte_bpe, default_path

WINDOW, END_ID = 2048, 1
#: Tokens of one block (16 MB of ids), and the most frequent lengths that make up triples.
BLOCK_TOKENS, TRIPLE_LENGTHS = 4_000_000, 64


def combinations(hist: np.ndarray, window: int, frequent: int = TRIPLE_LENGTHS) -> np.ndarray:
    """Rows of up to three lengths (0: none) that occur in the histogram and fill the window exactly."""
    have = hist > 0
    a = np.flatnonzero(have[: window // 2 + 1])
    a = a[(a > 0) & have[window - a]]
    pairs = np.stack([a, window - a, np.zeros_like(a)], 1)
    top = np.argsort(-hist, kind="stable")[:frequent]
    top = np.sort(top[hist[top] > 0])
    x, y = np.meshgrid(top, top)
    z = window - x - y
    ok = (x <= y) & (z > 0)
    ok[ok] = have[z[ok]]
    triples = np.sort(np.stack([x[ok], y[ok], z[ok]], 1), axis=1)
    return np.concatenate([pairs, np.unique(triples, axis=0)]) if len(triples) else pairs


def solve_nnls(columns: np.ndarray, hist: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - hist|, by accelerated projected gradients; column j of A counts the lengths of columns[j]."""
    target = hist.astype(float)
    target[0] = 0
    use = columns > 0
    spread = lambda x: np.bincount(columns.ravel(), np.where(use, x[:, None], 0).ravel(), minlength=len(hist))
    gather = lambda r: np.where(use, r[columns], 0).sum(axis=1)
    step = 1 / max(1.0, float(gather(spread(np.ones(len(columns)))).max()))
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * gather(spread(y) - target))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan_block(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Pieces (doc, start, length, sequence, offset) of documents with these token counts; sequences count from 0."""
    lengths = np.asarray(lengths, np.int64)
    full, rest = lengths // window, lengths % window
    doc = np.repeat(np.arange(len(lengths)), full)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)) * window
    out = [(doc, start, np.full(len(doc), window), np.arange(len(doc)), np.zeros(len(doc), np.int64))]
    at, base = len(doc), full * window
    hist = np.bincount(rest, minlength=window + 1)
    order = np.argsort(rest, kind="stable")
    head = np.searchsorted(rest[order], np.arange(window + 1))
    left = hist.copy()
    left[0] = 0
    columns = combinations(left, window)
    if len(columns):
        x = np.rint(solve_nnls(columns, left)).astype(np.int64)
        for j in np.argsort(-x, kind="stable"):
            lens = [int(v) for v in columns[j] if v]
            t = min([int(x[j]), *(int(left[v]) // lens.count(v) for v in lens)])
            if t <= 0:
                continue
            offset = 0
            for v in lens:
                docs = order[head[v] : head[v] + t]
                head[v] += t
                left[v] -= t
                out.append((docs, base[docs], np.full(t, v), at + np.arange(t), np.full(t, offset)))
                offset += v
            at += t
    docs = np.concatenate([order[head[v] : head[v] + left[v]] for v in range(window - 1, 0, -1)] or [order[:0]])
    if len(docs):
        ends = np.cumsum(rest[docs])
        total = int(ends[-1])
        edges = list(range(window, total + 1, window))
        tail, here = total % window, total - total % window
        for bit in range(window.bit_length() - 1, -1, -1):
            if tail >> bit & 1:
                here += 1 << bit
                edges.append(here)
        edges = np.array(edges)
        cuts = np.union1d(ends, edges)
        begin = np.concatenate([[0], cuts[:-1]])
        which, seq = np.searchsorted(ends, begin, "right"), np.searchsorted(edges, begin, "right")
        out.append((docs[which], base[docs][which] + begin - (ends - rest[docs])[which], cuts - begin, at + seq, begin - np.concatenate([[0], edges])[seq]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


PIECE = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: where it starts, its sequence and its offset there; with_ids adds its ids.

    Null and empty texts are the end id alone. Repeated rows are packed each on their own, null ids stay null, an empty
    table gives no rows, other columns are ignored. The window must be a power of two.
    """
    path = tokenizer or default_path()
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = PIECE.format(id=id_type) + (", ids array<int>" if with_ids else "")

    def run(batches):
        bpe, end = byte_bpe(path), np.array([END_ID], "<u4").tobytes()
        next_id = TaskContext.get().partitionId() << 36
        ids: list = []
        toks: list[bytes] = []
        size = 0

        def flush():
            nonlocal next_id
            lengths = np.array([len(t) // 4 for t in toks], np.int64)
            doc, start, length, seq, offset = plan_block(lengths, window)
            views = [memoryview(t) for t in toks]
            parts = [views[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)]
            made = {
                "doc_id": pa.array(ids, arrow_id).take(pa.array(doc)), "start": pa.array(start), "length": pa.array(length), "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                "doc_tokens": pa.array(lengths[doc]), "sequence_id": pa.array(next_id + seq), "offset": pa.array(offset),
            }
            if with_ids:
                edges = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                made["ids"] = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            next_id += int(seq.max()) + 1
            yield pa.RecordBatch.from_pydict(made)

        arrow_id = None
        for b in slices(batches):
            arrow_id = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                toks.append(bpe.encode(t) + end)
                size += len(toks[-1]) // 4
                if size >= BLOCK_TOKENS:
                    yield from flush()
                    ids, toks, size = [], [], 0
        if ids:
            yield from flush()

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(lean(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))
