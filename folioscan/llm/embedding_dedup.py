"""Embedding near-duplicates by dual traversal of cover trees.

Unit vectors link when their cosine reaches a threshold, that is when their chord is at most sqrt(2 - 2 threshold). Vectors
are dealt to the nearest of a bounded number of centres and on to blocks of at most about BLOCK rows. Each block becomes a
cover tree, once: nested levels of nodes whose radii halve, every node with the true distance to its farthest member. Pairs
of blocks, and then pairs of nodes level by level, are dropped when the distance of their centres exceeds the threshold by
more than both covering radii; a pair of nodes whose members all lie within it is taken whole. Where vectors are scattered,
covering radii say little; there the nodes of two blocks are put in order along the line between the blocks' means, and pairs
that lie further apart on that line alone than the threshold are never formed. What remains is compared vector by vector in
double precision. Blocks that lie near each other form groups, and a task meets all pairs of blocks of
two groups: a tree is sent once for each group, not once for each block, and counts and a spanning forest are handed on,
never pairs of vectors.
"""

from __future__ import annotations

import functools
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import checkpoint, lean, load, may_have
from folioscan.llm.graph import components, settle

THRESHOLD = 0.95
#: Rows of a block, centres at most (a sample of 4 x as many rows is fetched for them), and bytes of a group of blocks.
BLOCK, CENTRES, GROUP_BYTES = 4096, 4096, 64_000_000
#: Rows for each centre, as long as there are fewer than CENTRES: the more cells, the wider the gap between two of them.
CELL = 2048
#: Share of a level's nodes that may be too wide for it to be the one to begin with.
FEW = 0.002
#: Rotated components that stand for a vector in the first comparison; the length of the rest goes with them.
SHADOW = 16
#: Nodes in the first run of those next to the other block; each run is twice as long as the one before.
EDGE = 32
#: Groups up to which the pairs of groups that are too far apart are left out before trees are sent.
PRUNED_GROUPS = 256
#: Nodes of one block that are compared with a run of another's at a time: their products stay in a core's cache.
TILE = 256
#: Guard of the bounds against rounding; pairs inside it are compared exactly.
SLACK = 1e-7


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def net(points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """A greedy net: places of centres more than `radius` apart, and for each point a centre within `radius`."""
    centres: list[int] = []
    of = np.full(len(points), -1)
    for at in range(0, len(points), 256):
        part = np.arange(at, min(at + 256, len(points)))
        if centres:
            dots = points[part] @ points[centres].T
            near = dots.argmax(axis=1)
            inside = 2.0 - 2.0 * dots[np.arange(len(part)), near] <= radius * radius
            of[part[inside]] = near[inside]
            part = part[~inside]
        if not len(part):
            continue
        close = _chord(points[part], points[part]) <= radius
        np.fill_diagonal(close, True)
        free = np.ones(len(part), bool)
        alone = close.sum(axis=1) == 1
        for i in range(len(part)):
            if alone[i]:
                of[part[i]] = len(centres)
                centres.append(int(part[i]))
            elif free[i]:
                mine = free & close[i]
                of[part[mine]] = len(centres)
                free &= ~mine
                centres.append(int(part[i]))
    return np.array(centres), of


@functools.cache
def _turn(dim: int) -> np.ndarray:
    """A fixed rotation, so that no component says more than another about all vectors."""
    return np.linalg.qr(np.random.default_rng(0).normal(size=(dim, dim)))[0]


class CoverTree:
    """Nodes by level; a level's node has a centre, a covering radius and a run of the level below (of rows at the last).

    Rows are reordered so that every node's members are one run: lo[k][i]:hi[k][i].
    """

    def __init__(self, points: np.ndarray, weights: np.ndarray | None = None, levels: int = 6):
        order, runs = np.arange(len(points)), [(0, len(points))]
        self.radius, self.lo, self.hi, self.kids, chosen_rows = [], [], [], [], []
        reach = 2.0
        split = [False] if len(points) else []
        for level in range(levels):
            kids, next_runs, centres = [], [], []
            for (lo, hi), done in zip(runs, split, strict=True):
                first = len(next_runs)
                if level and (done or hi - lo == 1):
                    next_runs.append((lo, hi))
                    centres.append(order[lo])
                else:
                    own = order[lo:hi].copy()
                    chosen, of = net(points[own], reach) if level else (np.array([0]), np.zeros(hi - lo, int))
                    by = np.argsort(of, kind="stable")
                    order[lo:hi] = own[by]
                    edges = np.searchsorted(of[by], np.arange(len(chosen) + 1)) + lo
                    next_runs += list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
                    centres += own[chosen].tolist()
                kids.append((first, len(next_runs)))
            self.kids.append(np.array(kids, np.int64).reshape(-1, 2))
            lo, hi = (np.array(x, np.int64) for x in zip(*next_runs, strict=True)) if next_runs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            centre = points[np.array(centres, np.int64)]
            apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", points[order], np.repeat(centre, hi - lo, axis=0)))) if len(lo) else np.zeros(0)
            radius = np.maximum.reduceat(apart, lo) if len(lo) else np.zeros(0)
            chosen_rows.append(np.array(centres, np.int64))
            self.radius.append(radius)
            self.lo.append(lo)
            self.hi.append(hi)
            runs, reach = next_runs, reach / 2
            split = [bool(r <= SLACK) for r in radius]
        self.order = order
        self.rows = points[order]
        #: How many equal vectors each row stands for.
        self.weights = np.ones(len(order), np.int64) if weights is None else weights[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        #: The row, in tree order, that is each node's centre.
        self.middle = [place[c] for c in chosen_rows]
        self.ready()

    def ready(self) -> None:
        """What is derived and not packed: the rows' mean, and centres in single precision once they are asked for."""
        self.mean = self.rows.mean(axis=0) if len(self.rows) else np.zeros(self.rows.shape[1])
        self.single: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def flat(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """A level's centres and their shadows: the product of two shadows is at least the product of the vectors (Cauchy-Schwarz)."""
        if level not in self.single:
            x = self.centre(level, slice(None))
            turned = x @ _turn(x.shape[1])
            rest = np.sqrt(np.einsum("ij,ij->i", turned[:, SHADOW:], turned[:, SHADOW:]))
            self.single[level] = x.astype(np.float32), np.column_stack([turned[:, :SHADOW], rest]).astype(np.float32)
        return self.single[level]

    def centre(self, level: int, nodes) -> np.ndarray:
        return self.rows[self.middle[level][nodes]]


def _tiles(a0, a1, b0, b1, large: int = 4096, most: int = 200_000):
    """The pairs of members of pairs of runs: whole rectangles (x0, x1, y0, y1) of large ones, lists (x, y) of small ones."""
    area = (a1 - a0) * (b1 - b0)
    for k in np.flatnonzero(area >= large):
        for x in range(int(a0[k]), int(a1[k]), TILE):
            yield (x, min(x + TILE, int(a1[k])), int(b0[k]), int(b1[k])), None
    few = np.flatnonzero((area < large) & (area > 0))
    ends = np.cumsum(area[few])
    at = 0
    while at < len(few):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most)))
        own = few[at:to]
        k = np.repeat(own, area[own])
        n = np.arange(len(k)) - np.repeat(np.cumsum(area[own]) - area[own], area[own])
        width = (b1 - b0)[k]
        yield None, (a0[k] + n // width, b0[k] + n % width)
        at = to


def _near(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of centres (single precision, with room for its error) whose chord may be at most `most` and both radii.

    Most nodes of scattered data hold one row, so their bound is one number; rows and columns with a radius get their own.
    """
    dots = a @ b.T
    limit = lambda r: (1 - (most + SLACK + r) ** 2 / 2 - 1e-5).astype(np.float32)
    keep = np.zeros((len(a), -(-len(b) // 8) * 8), bool)
    np.greater_equal(dots, limit(np.float64(1e-6)), out=keep[:, : len(b)])
    wide = np.flatnonzero(ra > 5e-7)
    if len(wide):
        keep[wide, : len(b)] = dots[wide] >= limit(ra[wide, None] + rb[None, :])
    wide = np.flatnonzero(rb > 5e-7)
    if len(wide):
        keep[:, wide] = dots[:, wide] >= limit(ra[:, None] + rb[None, wide])
    eights = np.flatnonzero(keep.reshape(-1).view(np.uint64) != 0)  # hits are few: they are looked for eight at a time
    k, bit = np.nonzero(keep.reshape(-1, 8)[eights])
    return np.divmod(eights[k] * 8 + bit, keep.shape[1])


def _start(a: CoverTree, b: CoverTree, most: float) -> int:
    """The level at which two trees begin to meet.

    A node whose radius bridges half the usual distance between the blocks' rows (the root of 2 - 2 times the product of
    their means) is hardly ever dropped, and hands on its pairs one by one: levels with more than a few are left out.
    Where a level has hardly more pairs of nodes than the one to begin with, testing that one would cost as much and drop less.
    """
    pairs = [len(x) * len(y) for x, y in zip(a.lo, b.lo, strict=True)]
    apart = float(np.sqrt(max(0.0, 2 - 2 * float(a.mean @ b.mean))))
    if apart <= most:  # near copies: whole nodes may be taken at once
        return max((k for k in range(2, len(pairs)) if pairs[k] <= 1.5 * pairs[1]), default=0)
    last = len(pairs) - 1
    half = (0.9 * apart - most) / 2
    wide = lambda t, k: np.count_nonzero(t.radius[k] > half) / max(1, len(t.lo[k]))
    start = next((k for k in range(1, last) if wide(a, k) + wide(b, k) <= FEW), last)
    return max(k for k in range(start, last + 1) if pairs[k] <= 1.5 * pairs[start])


def _facing(a: CoverTree, b: CoverTree, level: int, most: float):
    """Candidate pairs of a level's nodes, as `_near`, out of all pairs that are not too far apart along the line between both means.

    A chord is no shorter than its part along a line, whatever the line, so no link is lost. Nodes are taken in the order in
    which they lie next to the other block: a run of a's nodes meets b's only as far as its foremost node reaches.
    """
    line = a.mean - b.mean
    length = float(np.sqrt(line @ line))
    (x, x_shadow), (y, y_shadow), ra, rb = a.flat(level), b.flat(level), a.radius[level], b.radius[level]
    if length > SLACK:
        line = (line / length).astype(np.float32)
        behind, ahead = x @ line - ra, y @ line + rb
        reach = most + SLACK + 1e-5  # with room for the error of single precision
        own, other = np.flatnonzero(behind <= ahead.max() + reach), np.flatnonzero(ahead >= behind.min() - reach)
        own, other = own[np.argsort(behind[own])], other[np.argsort(-ahead[other])]
        ends = np.searchsorted(-ahead[other], reach - behind[own], "right")  # how many of b's nodes each of a's may reach
    else:
        own, other = np.arange(len(x)), np.arange(len(y))
        ends = np.full(len(x), len(y))
    if not len(own) or not ends[0]:
        return
    ra, rb = ra[own], rb[other]
    sides = [None, None]  # in order, as they are needed: shadows, whole centres
    at, run, whole = 0, EDGE if length > SLACK else TILE, x.shape[1] <= SHADOW + 8
    found, n = [], 0
    while at < len(own) and ends[at]:
        to, end = min(at + run, len(own)), ends[at]
        for kind in (False, True):
            if kind < whole:
                continue
            if sides[kind] is None:
                sides[kind] = (x[own], y[other]) if kind else (x_shadow[own], y_shadow[other])
            u, v = sides[kind]
            p, q = _near(u[at:to], v[:end], ra[at:to], rb[:end], most)
            if len(p) * 100 <= (to - at) * end:
                break
            whole = True  # shadows tell too little here
        if len(p):
            found.append((own[p + at], other[q]))
            n += len(p)
        if n > 200_000:
            yield tuple(np.concatenate(z) for z in zip(*found, strict=True))
            found, n = [], 0
        at, run = to, min(2 * run, TILE)
    if found:
        yield tuple(np.concatenate(z) for z in zip(*found, strict=True))


def _spread(lo: np.ndarray, hi: np.ndarray, mate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of runs, each with its run's mate."""
    n = hi - lo
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum())), np.repeat(mate, n)


def _below(a: CoverTree, b: CoverTree, level: int, i: np.ndarray, j: np.ndarray, most: float):
    """Candidate pairs of a level's nodes below pairs (i, j) of nodes of the level above."""
    held: tuple = (None, None)
    for box, pair in _tiles(*a.kids[level][i].T, *b.kids[level][j].T):
        if box:
            x, y = slice(*box[:2]), slice(*box[2:])
            if box[2:] != held[0]:
                held = box[2:], b.centre(level, y).astype(np.float32)
            p, q = _near(a.centre(level, x).astype(np.float32), held[1], a.radius[level][x], b.radius[level][y], most)
            yield p + box[0], q + box[2]
        else:
            yield pair


def pairs_within(a: CoverTree, b: CoverTree, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of each row of a and of b (in tree order) to the other block, by weight, and linked places (a's row, b's row) that span all of them.

    With `same`, a block meets itself: each pair counts for both its rows, a row not with itself.
    """
    most = float(np.sqrt(2 - 2 * threshold))
    count_a, count_b, own = np.zeros(len(a.rows) + 1, np.int64), np.zeros(len(b.rows) + 1, np.int64), np.zeros(len(a.rows) + 1, np.int64)
    sum_a, sum_b = np.concatenate([[0], np.cumsum(a.weights)]), np.concatenate([[0], np.cumsum(b.weights)])
    left, right = [], []
    first = _start(a, b, most)
    i = j = np.zeros(0, np.int64)
    for level in range(first, len(a.kids)):
        new_i, new_j = [], []
        for p, q in _facing(a, b, level, most) if level == first else _below(a, b, level, i, j, most):
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", a.centre(level, p), b.centre(level, q))))
            bound = a.radius[level][p] + b.radius[level][q]
            keep = d <= most + bound + SLACK
            if same:  # each pair of nodes once
                keep &= p <= q
            d, bound, p, q = d[keep], bound[keep], p[keep], q[keep]
            whole = d + bound <= most - SLACK
            u, v = p[whole], q[whole]
            s0, s1, t0, t1 = a.lo[level][u], a.hi[level][u], b.lo[level][v], b.hi[level][v]
            twice = (u == v) & same
            of_a, of_b = sum_a[s1] - sum_a[s0], sum_b[t1] - sum_b[t0]
            np.add.at(count_a, s0, of_b)
            np.add.at(count_a, s1, -of_b)
            np.add.at(own, s0[twice], 1)
            np.add.at(own, s1[twice], -1)
            np.add.at(count_b, t0[~twice], of_a[~twice])
            np.add.at(count_b, t1[~twice], -of_a[~twice])
            for x, y in (_spread(s0, s1, t0), _spread(t0, t1, s0)[::-1]):
                left.append(x)
                right.append(y)
            new_i.append(p[~whole])
            new_j.append(q[~whole])
        i, j = np.concatenate([*new_i, np.zeros(0, np.int64)]), np.concatenate([*new_j, np.zeros(0, np.int64)])
        if not len(i):
            break
    links_a, links_b = np.cumsum(count_a)[:-1] - np.cumsum(own)[:-1] * a.weights, np.cumsum(count_b)[:-1]
    last = len(a.kids) - 1
    for box, pair in _tiles(a.lo[last][i], a.hi[last][i], b.lo[last][j], b.hi[last][j]):
        if box:
            p, q = np.nonzero(a.rows[box[0] : box[1]] @ b.rows[box[2] : box[3]].T >= threshold)
            p, q = p + box[0], q + box[2]
        else:
            p, q = pair
            hit = np.einsum("ij,ij->i", a.rows[p], b.rows[q]) >= threshold
            p, q = p[hit], q[hit]
        if same:  # a node with itself gives its pairs both ways round, and each row with itself
            once = p < q
            p, q = p[once], q[once]
        np.add.at(links_a, p, b.weights[q])
        np.add.at(links_b, q, a.weights[p])
        left.append(p)
        right.append(q)
    return links_a, links_b, np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])


_PARTS = ("middle", "radius", "lo", "hi", "kids")


def _pack(tree: CoverTree, raw: np.ndarray, ids: np.ndarray) -> bytes:
    """The tree with its rows as they came, in single precision if that loses nothing."""
    out = io.BytesIO()
    flat = {f"{name}{k}": x if name == "radius" else x.astype(np.int32) for name in _PARTS for k, x in enumerate(getattr(tree, name))}
    single = raw.astype(np.float32)
    raw = single if (single == raw).all() else raw
    np.savez(out, rows=raw[tree.order], ids=ids[tree.order], weights=tree.weights, levels=len(tree.kids), **flat)
    return out.getvalue()


def _unpack(blob: bytes) -> tuple[CoverTree, np.ndarray]:
    x = np.load(io.BytesIO(blob), allow_pickle=False)
    tree = CoverTree.__new__(CoverTree)
    for name in _PARTS:
        setattr(tree, name, [x[f"{name}{k}"] if name == "radius" else x[f"{name}{k}"].astype(np.int64) for k in range(int(x["levels"]))])
    tree.rows, tree.weights = unit(x["rows"]), x["weights"]
    tree.ready()
    return tree, x["ids"]


def near_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Null, empty and zero vectors and those with null or non-finite components link with nothing, nor do vectors of another
    dimension with each other. Repeated rows are vectors of their own and link; null ids count as larger than all others,
    an empty table gives no rows, labels and other columns are ignored.
    """
    # Single precision stays as it is, at half the bytes wherever vectors are written or moved; all products are of doubles.
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    value = F.col(vector_col).cast(kind)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.monotonically_increasing_id().alias("row"), value.alias("v"))
    rows = rows.withColumn("top", F.array_max(F.transform("v", F.abs)))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.col("top") > 0)
    # Squares of very large or small components would leave the range of numbers; a direction has no size.
    extreme = (F.col("top") > 1e100) | (F.col("top") < 1e-100)
    rows = rows.withColumn("v", F.when(fine & extreme, F.transform("v", lambda x: x / F.col("top")).cast(kind)).otherwise(F.col("v")))
    rows = checkpoint(rows.select("vec_id", "row", F.when(fine, F.col("v")).alias("v")))
    good = rows.where("v is not null")
    sizes = [r.n for r in good.select(F.size("v").alias("n")).distinct().collect()]  # each dimension is an index of its own
    # Equal vectors go through the trees as one row that weighs as many, so copies cost nothing but their count.
    reps = checkpoint(good.groupBy("v").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("copies")))
    many = checkpoint(reps.where("copies > 1"))
    maybe = may_have(many.select(F.xxhash64("v").alias("h")), "h")
    owned = good.where(maybe(F.xxhash64("v"))).select("row", "v").join(many, "v").select("row", "rep", "copies")
    counts, edges = [], []
    for dim in sorted(sizes):
        c, e = _links(reps.where(F.size("v") == dim).select(F.col("rep").alias("row"), "v", "copies"), threshold)
        counts.append(c)
        edges.append(e)
    if not counts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    n_links, all_edges = counts[0], edges[0]
    for c, e in zip(counts[1:], edges[1:], strict=True):
        n_links, all_edges = n_links.union(c), all_edges.union(e)
    roots = components(all_edges).withColumnRenamed("node", "rep")
    of = rows.select("vec_id", "row").join(owned, "row", "left").select("vec_id", F.coalesce("rep", "row").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    joined = checkpoint(of.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep")))
    lowest = checkpoint(joined.groupBy("root").agg(F.min("vec_id").alias("component_id")))
    return joined.join(lowest, "root").join(n_links.withColumnRenamed("row", "rep"), "rep", "left").select(
        "vec_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def _links(good: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(row, n_links) and edges (a, b) between rows (row, v, copies), of distinct vectors of one dimension."""
    spark = good.sparkSession
    n = good.count()
    k = max(1, min(CENTRES, -(-n // min(CELL, BLOCK))))
    wanted = 4 * k
    sample = good.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(min(1.0, 4 * wanted / max(1, n)) * (1 << 30))).orderBy(F.xxhash64("row")).limit(wanted).select("v").toArrow().column("v").combine_chunks()
    points = unit(sample.flatten().to_numpy().reshape(len(sample), -1)) if len(sample) else unit(np.array([good.first().v]))
    chosen = [0]
    far = _chord(points, points[:1])[:, 0]
    while len(chosen) < k and far.max() > SLACK:  # farthest first
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _chord(points, points[chosen[-1:]])[:, 0])
    centres = spark.sparkContext.broadcast(points[chosen])

    def deal(batches):
        for b in batches:
            if b.num_rows:
                x = unit(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                d = _chord(x, centres.value)
                yield pa.RecordBatch.from_pydict({"row": b.column(0), "v": b.column(1), "copies": b.column(2), "cell": pa.array(d.argmin(axis=1).astype(np.int32)), "d": pa.array(d.min(axis=1))})

    dealt = checkpoint(good.mapInArrow(lean(deal), f"row long, v {dict(good.dtypes)['v']}, copies long, cell int, d double"))
    # A cell with more than BLOCK rows is dealt on by a hash; every part keeps its own tree. Cells are numbered so that
    # neighbours follow each other: by the nearest of the first centres, which lie far apart.
    cells = sorted(dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("r")).collect(), key=lambda c: c.cell)  # at most CENTRES rows
    centre = points[chosen][[c.cell for c in cells]]
    pivots = _chord(centre, points[chosen[: max(1, int(np.sqrt(len(chosen))))]])
    order = np.lexsort((pivots.min(axis=1), pivots.argmin(axis=1)))
    cells, centre = [cells[i] for i in order], centre[order]
    held = np.array([c.n for c in cells])
    parts = -(-held // BLOCK)
    first = np.cumsum(parts) - parts
    # Groups by rows, since cells differ in size: enough pairs of groups for the cluster's tasks, or more where the trees of a
    # group would not fit in memory. A group has at most one block's rows more.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(1, min(-(-n // int(np.ceil(np.sqrt(2 * tasks)))), GROUP_BYTES // (8 * points.shape[1])))
    before, height = np.cumsum(held) - held, -(-held // parts)
    shelves = F.broadcast(spark.createDataFrame([(int(c.cell), *map(int, x)) for c, *x in zip(cells, parts, first, before, height, strict=True)], "cell int, parts int, first int, before long, height long"))
    part = F.pmod(F.xxhash64("row"), F.col("parts"))
    shelved = dealt.join(shelves, "cell").select((F.col("first") + part).cast("int").alias("block"), F.floor((F.col("before") + part * F.col("height")) / size).cast("int").alias("own"), "row", "v", "copies")

    def build(table: pa.Table) -> pa.Table:
        raw = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        ids = table.column("row").to_numpy()
        by = np.argsort(ids)
        tree = CoverTree(unit(raw[by]), table.column("copies").to_numpy()[by])
        return pa.table({"block": table.column("block").slice(0, 1), "own": table.column("own").slice(0, 1), "tree": pa.array([_pack(tree, raw[by], ids[by])], pa.binary())})

    own = checkpoint(shelved.groupBy("block").applyInArrow(build, "block int, own int, tree binary"))
    most = float(np.sqrt(2 - 2 * threshold))
    lowest, highest = before // size, (before + (parts - 1) * height) // size  # a cell's first and last group
    groups = int(highest[-1]) + 1
    if groups <= PRUNED_GROUPS:
        radius = np.array([c.r for c in cells])
        near = _chord(centre, centre) <= most + radius[:, None] + radius[None, :] + SLACK
        span = [(int(np.searchsorted(highest, g, "left")), int(np.searchsorted(lowest, g, "right"))) for g in range(groups)]
        wanted_tiles = [(i, j) for i in range(groups) for j in range(i, groups) if near[span[i][0] : span[i][1], span[j][0] : span[j][1]].any()]
        tiles = spark.createDataFrame(wanted_tiles, "i int, j int")  # at most PRUNED_GROUPS squared
        met = own.join(F.broadcast(tiles.withColumn("own", F.explode(F.array_distinct(F.array("i", "j"))))), "own")
    else:
        met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")

    def meet(table: pa.Table) -> pa.Table:
        by = sorted(zip(table.column("block").to_pylist(), table.column("own").to_pylist(), range(table.num_rows)))
        blobs = table.column("tree")
        held = [(side, *_unpack(blobs[k].as_py())) for _, side, k in by]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        ids = np.concatenate([x for _, _, x in held])
        at = np.cumsum([0, *(len(x) for _, _, x in held)])
        n, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for p, (side_a, a, _) in enumerate(held):
            for q in range(p, len(held)):
                side_b, b, _ = held[q]
                apart = np.sqrt(max(0.0, 2 - 2 * float(a.centre(0, [0])[0] @ b.centre(0, [0])[0])))
                if (side_a, side_b) != (i, j) or apart > most + a.radius[0][0] + b.radius[0][0] + SLACK:
                    continue
                na, nb, left, right = pairs_within(a, b, threshold, p == q)
                n[at[p] : at[p + 1]] += na
                n[at[q] : at[q + 1]] += nb
                settle(labels, at[p] + left, at[q] + right)
        linked = np.flatnonzero(n > 0)
        return pa.table({"row": pa.array(ids[linked]), "n": pa.array(n[linked]), "root": pa.array(ids[labels[linked]])})

    found = checkpoint(met.groupBy("i", "j").applyInArrow(meet, "row long, n long, root long"))
    return found.groupBy("row").agg(F.sum("n").alias("n_links")), found.select(F.col("row").alias("a"), F.col("root").alias("b"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(load(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), ok AS (
  SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS n FROM v
  WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND list_inner_product(x, x) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.95
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id
"""
