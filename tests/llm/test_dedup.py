import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from xxhash import xxh64_intdigest

from folioscan.llm import embedding_dedup, exact_dedup, graph, simhash, suffix_dedup, winnow
from folioscan.llm.common import Bloom


def near_components(n, linked):
    """Smallest place that each place reaches; linked(i, j)."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(i):
                if linked(i, j) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


# Exact


@given(st.lists(st.integers(0, 2**40), max_size=300, unique=True))
def test_golomb_round_trip(values):
    x = np.array(sorted(values), np.uint64)
    assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(x, 1 << 40)) == x).all()


def test_golomb_is_small():
    x = np.unique(np.random.default_rng(0).integers(0, 2**58, 10_000, dtype=np.uint64))
    assert len(exact_dedup.golomb_encode(x, 1 << 58)) < 10_000 * 8 * 0.8


def exact_expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", t or ""), []).append(i)
    out = []
    for i, t in rows:
        n = re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
        known = [x for x in groups[n] if x is not None]
        keep = min(known) if known else None
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return out


def test_exact_groups(frame):
    texts = ["a  b", "a b", "a\tb", "A b", "", None, " ", "ü", "ü", "long " * 20_000, "long " * 20_000, "one"]
    rows = list(zip([5, 3, 9, 1, 20, 21, 22, None, 30, 40, 41, 50], texts, strict=True))
    got = exact_dedup.exact_groups(frame([t for _, t in rows], [i for i, _ in rows]).repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(exact_expected(rows), key=str)
    kept = exact_dedup.deduplicate(frame([t for _, t in rows], [i for i, _ in rows]))
    assert sorted((r.doc_id for r in kept.collect())) == sorted(i for i, keep, n, k, _ in exact_expected(rows) if k) and "sha" in kept.columns
    assert exact_dedup.exact_groups(frame(["x"]).where("false")).count() == 0 and exact_dedup.deduplicate(frame(["x"]).where("false")).count() == 0


def test_exact_repeated_rows(frame):
    d = frame(["same", "same", "same"], [1, 1, None])
    got = exact_dedup.exact_groups(d).collect()
    assert sum(r.kept for r in got) == 1 and all(r.keep_id == 1 and r.group_size == 3 for r in got)
    assert exact_dedup.deduplicate(d).count() == 1


# SimHash


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@given(st.text(alphabet="aB É\t\n.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@given(st.integers(0, 2**32), st.sampled_from([2, 3, 63, 64, 65, 130]), st.integers(1, 6))
@settings(max_examples=25, deadline=None)
def test_link_groups(seed, size, radius):
    rng = np.random.default_rng(seed)
    sizes = [size, 1, 2, size // 2 + 1]
    centre = rng.integers(0, 2**63, 3, dtype=np.uint64)
    words = centre[rng.integers(0, 3, sum(sizes))]
    for _ in range(5):
        words = words ^ np.where(rng.random(len(words)) < 0.6, np.uint64(1) << rng.integers(0, 64, len(words)).astype(np.uint64), np.uint64(0))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    got = simhash.link_groups(words, edges, radius)
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        own = [int(x) for x in words[a:z]]
        want = near_components(len(own), lambda i, j, own=own: (own[i] ^ own[j]).bit_count() <= radius)
        assert [x - a for x in got[a:z]] == want


def test_near_groups(spark, documents, frame, monkeypatch):
    for group in (4096, 4):  # the second splits every group into blocks
        monkeypatch.setattr(simhash.links, "__defaults__", (simhash.RADIUS, group))
        rows = [(r.doc_id, r.text) for r in documents.collect()] + [(9000, None), (9001, "")]
        got = simhash.near_groups(frame([t for _, t in rows], [i for i, _ in rows])).collect()
        prints = [slow_fingerprint(t) for _, t in rows]
        label = near_components(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
        first = {}
        for (i, _), c in zip(rows, label, strict=True):
            first[c] = min(first.get(c, i), i)
        assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{p:016x}", first[c]) for (i, _), p, c in zip(rows, prints, label, strict=True)}
    assert simhash.near_groups(frame(["x"]).where("false")).count() == 0
    assert {r.component_id for r in simhash.near_groups(frame(["q w e r", "q w e r", "q w e r"], [None, 7, 7])).collect()} == {7}


def word_sets(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_wide_links():
    rng = np.random.default_rng(5)
    words = np.repeat(rng.integers(0, 2**63, (6, 2), dtype=np.uint64), 30, axis=0)
    for _ in range(30):
        words ^= np.where(rng.random(words.shape) < 0.5, np.uint64(1) << rng.integers(0, 64, words.shape).astype(np.uint64), np.uint64(0))
    apart = lambda i, j: sum((int(a) ^ int(b)).bit_count() for a, b in zip(words[i], words[j], strict=True))
    for edges in ([0, 180], [0, 60, 61, 120, 180]):
        got = simhash.link_groups(words, np.array(edges), 35)
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            assert [x - a for x in got[a:z]] == near_components(z - a, lambda i, j, a=a: apart(a + i, a + j) <= 35)


@pytest.mark.parametrize("group,rows_", [(4096, 1024), (4, 3)])
def test_similar_groups(documents, frame, monkeypatch, group, rows_):
    """Against every pair of documents, also with all groups and clusters split into blocks."""
    monkeypatch.setattr(simhash, "NEAR_ROWS", rows_)
    random.seed(4)
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(9000, None), (9001, ""), (9002, "one two"), (9003, "One  two"), (9004, "one two three")]
    long = [f"w{random.randrange(10**6)}" for _ in range(160)]
    for k in range(40):  # copies of one text with more and more words changed
        own = list(long)
        for at in random.sample(range(160), k // 4):
            own[at] = f"x{k}"
        rows.append((9100 + k, " ".join(own)))
    rows += [(9200, "q w e r t y u i"), (9200, "q w e r t y u i"), (None, "q w e r t y u i")]
    ids, sets = [i for i, _ in rows], [word_sets(t) for _, t in rows]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9
    label = near_components(len(rows), alike)
    first = {}
    for i, c in zip(ids, label, strict=True):
        first[c] = min((x for x in (first.get(c), i) if x is not None), default=None)
    got = simhash.similar_groups(frame([t for _, t in rows], ids), group=group).collect()
    linked = {c for c, n in Counter(label).items() if n > 1}
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == sorted(((i, first[c]) for i, c in zip(ids, label, strict=True) if c in linked), key=str)
    if group == 4096:
        d = frame([t for _, t in rows], ids)
        kept = simhash.deduplicate(d)
        assert kept.columns == d.columns and sorted(r.doc_id for r in kept.dropDuplicates(["doc_id"]).collect()) == sorted(set(first.values()))
        assert simhash.similar_groups(d.where("false")).count() == 0 and simhash.deduplicate(d.where("false")).count() == 0


def test_components(spark):
    random.seed(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(200, 260)] + [(random.randrange(300, 400), random.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = sorted({x for p in pairs for x in p if p[0] != p[1]})
    linked = {frozenset(p) for p in pairs}
    label = near_components(len(nodes), lambda i, j: frozenset((nodes[i], nodes[j])) in linked)
    assert got == {n: nodes[c] for n, c in zip(nodes, label, strict=True)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Suffix arrays


@given(st.lists(st.integers(1, 3), min_size=1, max_size=200))
@settings(deadline=None)
def test_suffix_array(values):
    s = np.array(values)
    assert suffix_dedup.suffix_array(s, 9).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_wide_symbols():
    s = np.random.default_rng(0).integers(1, 2**25, 3000)
    s[1000:2000] = s[:1000]
    assert suffix_dedup.suffix_array(s, 26).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_equal_strings_choose_equal_anchors():
    rng = np.random.default_rng(1)
    part = rng.integers(97, 100, 400).astype(np.uint8).tobytes()
    texts = [b"x" * 50 + part, rng.integers(97, 100, 333).astype(np.uint8).tobytes() + part + b"tail", b"a" * 1000, b"short"]
    h, first, last, data, starts = winnow.anchors(texts, 200, 128)
    chosen = {}
    for a, z, k in zip(first.tolist(), last.tolist(), h.tolist(), strict=True):
        for i in range(a, z + 1):
            s = bytes(data[i : i + 200])
            assert chosen.setdefault(s, k) == k
    assert len(chosen) == len({t[i : i + 200] for t in texts for i in range(len(t) - 199)})


def removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("bucket,slice_bytes,bits", [(2048, 1_000_000, (64,)), (2, 300, (1, 64))])
def test_repeated_bytes(frame, monkeypatch, bucket, slice_bytes, bits):
    """The second run splits every anchor into blocks, cuts all longer texts into pieces, and has contexts that differ share a hash at first."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(suffix_dedup, "KEY_BITS", bits)
    random.seed(bucket)
    word = lambda: "".join(random.choices("abcdeé\n ", k=random.randrange(2, 7)))
    passage, other = " ".join(word() for _ in range(90)), " ".join(word() for _ in range(70))
    fill = lambda n: " ".join(word() for _ in range(n))
    texts = [None, "", "short", "short", passage, passage, "a" * 900, "ab" * 150, fill(300)]
    texts += [fill(random.randrange(5, 60)) + passage[random.randrange(80) :] + fill(20) for _ in range(8)] + [fill(30) + other + fill(9) + passage + fill(3) + other, other[:199], other[3:210] + "x"]
    texts += [passage[:i] + "#" + passage[i:] for i in (100, 250, 300)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated(frame(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == removed(texts, 200)
    assert suffix_dedup.repeated(frame(["x"]).where("false")).count() == 0


def test_colliding_contexts_are_not_taken_for_equal(frame, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "KEY_BITS", (0, 0))
    rng = random.Random(2)
    shared = "".join(rng.choices("abcdefgh", k=190))  # shorter than what counts, but with an anchor of its own
    texts = ["".join(rng.choices("ijklm", k=120)) + shared + "".join(rng.choices("ijklm", k=120)) for _ in range(60)]
    with pytest.raises(ValueError):
        suffix_dedup.repeated(frame(texts)).collect()
    monkeypatch.setattr(suffix_dedup, "KEY_BITS", (0, 64))
    assert all(r.n_removed == 0 for r in suffix_dedup.repeated(frame(texts)).collect())


def test_slices_of_long_texts():
    text = bytes(range(256)) * 20
    batch = pa.RecordBatch.from_pydict({"text": pa.array([b"", text, b"short", text[:700]], pa.binary())})
    parts = [x for part in suffix_dedup._slices([batch], 200, 512) for x in part]
    assert all(len(x[3]) <= 711 and bytes(x[3]) == bytes(x[1][x[2] : x[2] + len(x[3])]) for x in parts)
    starts = [(n, at + i) for n, _, at, piece in parts for i in range(len(piece) - 199)]
    assert len(starts) == len(set(starts)) == len(text) - 199 + 501


def test_remove_keeps_rows_and_columns(frame):
    long = "pässage " * 60
    d = frame([long + "one", "two " + long, "clean", None], [1, 2, None, 4])
    out = {r.doc_id: r for r in suffix_dedup.remove(d).collect()}
    assert suffix_dedup.remove(d).columns == d.columns and len(out) == 4
    assert out[None].text == "clean" and out[4].text is None and out[1].text.endswith("one") and len(out[1].text) < 60 and out[1].n_chars == len(out[1].text)


def test_short_length(frame):
    texts = ["abcdefghijklmnopqrst", "zzcdefghijklmnopzz", "mnop"]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated(frame(texts), length=6).collect()}
    assert [got[i] for i in range(3)] == removed(texts, 6)


# Embeddings


def vectors(seed=0, n=300):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    x[n // 2 :] = x[rng.integers(0, n // 2, n - n // 2)] + rng.normal(scale=0.08, size=(n - n // 2, 8))
    x[5] = x[6] = x[7] = x[8]
    x[9] = 3 * x[8]
    return x


def test_tree_pairs():
    for seed in range(3):
        x = embedding_dedup.unit(vectors(seed))
        w = np.random.default_rng(seed).integers(1, 5, len(x))
        a, b = embedding_dedup.CoverTree(x[:130], w[:130]), embedding_dedup.CoverTree(x[130:], w[130:])
        for p, q, same in ((a, b, False), (a, a, True)):
            na, nb, left, right = embedding_dedup.pairs_within(p, q, 0.95, same)
            hit = p.rows @ q.rows.T >= 0.95
            if same:
                np.fill_diagonal(hit, False)
                assert (na + nb == hit @ p.weights).all()
            else:
                assert (na == hit @ q.weights).all() and (nb == p.weights @ hit).all()
            assert all(hit[i, j] or same and i == j for i, j in zip(left, right, strict=True)) or same


def test_scattered_cells(monkeypatch):
    """Cells of scattered vectors with near copies across their border: all links, out of a small part of the products."""
    rng = np.random.default_rng(5)
    centres = embedding_dedup.unit(rng.normal(size=(60, 64)))
    x = embedding_dedup.unit(rng.normal(size=(40_000, 64)))
    x = np.concatenate([x, embedding_dedup.unit(x[:8000] + rng.normal(scale=0.03, size=(8000, 64)))])
    cell = (x @ centres.T).argmax(axis=1)
    a, b = (embedding_dedup.CoverTree(x[cell == c]) for c in np.argsort(-(centres @ centres[0]))[:2])
    near, products = embedding_dedup._near, []
    monkeypatch.setattr(embedding_dedup, "_near", lambda p, q, *rest: (products.append(p.size * len(q)), near(p, q, *rest))[1])
    na, nb, left, right = embedding_dedup.pairs_within(a, b, 0.95, False)
    hit = a.rows @ b.rows.T >= 0.95
    assert hit.any() and (na == hit.sum(axis=1)).all() and (nb == hit.sum(axis=0)).all() and hit[left, right].all()
    assert sum(products) < 0.2 * 64 * hit.size


def test_start_levels():
    """Bounds on any kind of rows lose no link: few dimensions, a common direction, dense clusters, mixtures."""
    rng = np.random.default_rng(6)
    scattered, tight = rng.normal(size=(400, 64)), rng.normal(size=(1, 64)) + rng.normal(scale=0.2, size=(400, 64))
    flat = np.concatenate([rng.normal(size=(400, 3)), np.zeros((400, 61))], axis=1)
    clusters = np.repeat(rng.normal(size=(8, 64)), 50, axis=0) + rng.normal(scale=0.25, size=(400, 64))
    lean = rng.normal(size=(400, 64)) + 2
    kinds = [scattered, tight, flat, clusters, lean, np.concatenate([scattered[:150], tight[:150], clusters[:100]]), rng.normal(size=(400, 2)), rng.normal(size=(400, 20))]
    for x in kinds:
        x = embedding_dedup.unit(x)[rng.permutation(400)]
        side = x @ x[0] > np.median(x @ x[0])
        for one, other in ((x[:200], x[200:]), (x[side], x[~side])):
            a, b = embedding_dedup.CoverTree(one), embedding_dedup.CoverTree(other)
            for threshold in (0.8, 0.95, 0.999):
                hit = a.rows @ b.rows.T >= threshold
                na, nb, left, right = embedding_dedup.pairs_within(a, b, threshold, False)
                assert (na == hit.sum(axis=1)).all() and (nb == hit.sum(axis=0)).all() and hit[left, right].all()


def test_embedding_groups(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    x = vectors(1, 200)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0, None] + [0.0] * 6), (903, [float("nan")] * 8), (904, [float("inf")] * 8), (905, []), (906, [1.0, 0.0]), (907, [2.0, 0.0]), (908, [1e-300, 0.0]), (909, [1e300, 1e299]), (None, x[0].tolist()), (0, x[0].tolist())]
    d = spark.createDataFrame([(i, v, 1, "n") for i, v in rows], "vec_id long, embedding array<double>, label int, norm string")
    fine = lambda v: v and None not in v and np.isfinite(v).all() and any(v)
    unit = [embedding_dedup.unit(np.array([v]) / max(map(abs, v)))[0] if fine(v) else None for _, v in rows]
    linked = lambda i, j: unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95
    label = near_components(len(rows), linked)
    low = {}
    for (i, _), c in zip(rows, label, strict=True):
        low[c] = min((x for x in (low.get(c), i) if x is not None), default=None)
    want = sorted(((i, sum(linked(k, j) for j in range(len(rows)) if j != k), low[c]) for k, ((i, _), c) in enumerate(zip(rows, label, strict=True))), key=str)
    got = embedding_dedup.near_groups(d).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.near_groups(d.where("false")).count() == 0
    assert embedding_dedup.near_groups(d.where("vec_id = 900")).first().n_links == 0


def test_bloom_loses_nothing():
    x = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64)
    b = Bloom(5000)
    b.add(x)
    assert b.test(x).all() and b.test(x + np.uint64(1)).mean() < 0.02
