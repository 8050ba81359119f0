import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscan.llm import chat, warc

TURNS = "conv_id long, turn long, role string, text string, source string"


@given(st.text(max_size=30), st.booleans())
def test_escape_round_trip(text, line):
    for t in (text, text + "<|im_end|>\\", "<<||\\n\n" + text):
        e = chat.escape(t, line)
        assert chat.unescape(e, line) == t and "<|" not in e and not (line and "\n" in e)


def expect(rows):
    """Digests of rows (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), r[1] or "", r[2] or ""))
    turns, loss = hashlib.sha256(), "".join(t or "" for _, r, t in rows if r == "assistant")
    for _, r, t in rows:
        turns.update(f"{r or ''}\n{t or ''}\n".encode())
    return len(rows), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def run(spark, rows, partitions=None):
    """The tree's rows, after every conversation was read back and every node's attention was held against brute force."""
    d = spark.createDataFrame([(*r, "x") for r in rows], TURNS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    trees = chat.format_chats(d)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    convs = {c: sorted((r[1:] for r in rows if r[0] == c), key=lambda r: ((r[0] is not None, r[0] or 0), r[1] or "", r[2] or "")) for c in {r[0] for r in rows}}
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(trees).collect()}
    assert got == {c: expect(rs) for c, rs in convs.items()}
    text = {r.conv_id: r for r in chat.read_back(trees).collect()}
    for c, rs in convs.items():
        assert text[c].formatted == "".join(f"{chat.START}{chat.escape(r or '', True)}\n{chat.escape(t or '')}{chat.END}\n" for _, r, t in rs)
        assert [chat.unescape(text[c].formatted[a:z]) for a, z in zip(text[c].loss[::2], text[c].loss[1::2], strict=True)] == [t for _, r, t in rs if r == "assistant" and t]
    out = trees.collect()
    check_attention(out, convs)
    return out


def check_attention(out, convs):
    """Every prefix of turns is written once; its tokens attend to those of its prefixes, at the positions that follow them."""
    nodes = {(r.stream, r.start): r for r in out if r.kind == "node"}
    refs = {}
    for r in out:
        if r.kind == "ref":
            refs.setdefault(r.stream, {})[r.depth] = (r.home, r.start, r.stop)
    prefixes = {tuple((r or "", t or "") for _, r, t in rs[: k + 1]) for rs in convs.values() for k in range(len(rs))}
    assert len(nodes) == len(prefixes) and len({r.key for r in nodes.values()}) == len(nodes)
    flat = lambda r: [x for k in range(r.carried) for x in [refs[r.stream][k]]] + [(r.stream, a.start, a.stop) for a in r.attends]

    def pieces(spans):
        """The nodes that intervals cover, in order."""
        found = []
        for s, a, z in spans:
            while a < z:
                found.append(nodes[(s, a)])
                a = found[-1].stop
            assert a == z
        return found

    for r in nodes.values():
        path = pieces(flat(r))
        assert len(path) == r.depth and [x.depth for x in path] == list(range(r.depth)) and r.position == sum(x.stop - x.start for x in path)
        assert len(r.ids) == 4 * (r.stop - r.start)
        for k, x in enumerate(path):  # an ancestor's own ancestors are the first of the path
            assert [(y.stream, y.start) for y in pieces(flat(x))] == [(y.stream, y.start) for y in path[:k]]
    leaves = {r.conv_id: r for r in out if r.kind == "leaf"}
    assert set(leaves) == set(convs) and all(len(pieces(flat(r))) == r.depth == len(convs[c]) for c, r in leaves.items())


def test_chats(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>"), (2, 0, "user", "hi"), (2, 1, "assistant", "other"), (3, 0, None, None), (4, 1, "a\nb\\", "日本"), (4, None, "assistant", ""), (5, 0, "user", "x"), (5, 0, "user", "x"), (None, 0, "assistant", "y" * 5000)]
    run(spark, rows)
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0 and chat.digest(chat.format_chats(spark.createDataFrame([], TURNS))).count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_long_chats_attend_to_all_their_turns(spark, partitions):
    long = lambda c, n, at: [(c, i, ("user", "assistant")[i % 2], f"turn {i}" if i < at else f"{c} {i}") for i in range(n)]
    run(spark, long(1, 100, 100) + long(2, 100, 60) + long(3, 100, 60) + long(4, 61, 100) + long(5, 120, 99) + long(6, 1, 0) + long(7, 100, 100), partitions)


def test_a_hot_first_turn_is_written_once(spark):
    rows = [(c, i, ("user", "assistant")[i % 2], "same first turn" if i == 0 else f"answer {c % 40}" if i == 1 else f"{c}") for c in range(5000) for i in range(3 if c % 5 else 2)]
    out = run(spark, rows, 9)
    assert len({r.stream for r in out}) == 9 and sum(r.kind == "node" and r.depth == 0 for r in out) == 1 and any(r.kind == "ref" for r in out)


PAGES = "page_id long, url string, html string, n int"


def audit(spark, rows):
    return {(r.page_id, r.n_bytes): r.corrupt for r in warc.audit_pages(spark.createDataFrame([(*r, 1) for r in rows], PAGES)).collect()}


def test_records_and_audit(spark, monkeypatch):
    monkeypatch.setattr(warc, "VOLUME_RECORDS", 16)
    monkeypatch.setattr(warc, "FANOUT", 4)
    rows = [(i, f"http://h/{i}\r\nX: y", f"<p>ü{i}</p>" * (i % 5)) for i in range(300)] + [(507, "u", "z"), (507, "u", "z"), (None, None, None)]
    got = warc.audit_pages(spark.createDataFrame([(*r, 1) for r in rows], PAGES)).collect()
    assert len(got) == len(rows) and sorted(r.page_id for r in got if r.corrupt) == [7, 507, 507]
    one = spark.createDataFrame([(*r, 1) for r in rows[:9]], PAGES).select("page_id", "html", warc.parse_record(warc.record_bytes(F.col("url"), F.col("html"), F.col("page_id"))).alias("r")).collect()
    assert all(r.r.record_id == str(r.page_id) and r.r.body == r.html and r.r.digest == hashlib.sha256(r.html.encode()).hexdigest() and "\r" not in r.r.url for r in one)
    assert warc.audit_pages(spark.createDataFrame([], PAGES)).count() == 0


def test_audit_finds_missing_and_reads_only_bad_branches(spark, monkeypatch):
    monkeypatch.setattr(warc, "VOLUME_RECORDS", 16)
    monkeypatch.setattr(warc, "FANOUT", 4)
    records = spark.range(100).select((F.col("id") / 16).cast("long").alias("volume"), (F.col("id") % 16).alias("n"), F.col("id").alias("record_id"), F.encode(F.concat(F.lit("r"), F.col("id").cast("string")), "UTF-8").alias("record"))
    good = warc.build_tree(warc.index_records(records))
    assert good[-1].count() == 1 and warc.audit(good, warc.build_tree(warc.index_records(records))).count() == 0
    less = warc.build_tree(warc.index_records(records.where("record_id <> 99")))
    assert {(r.volume, r.n) for r in warc.audit(good, less).collect()} == {(6, 3)}
    moved = records.withColumn("record", F.when(F.col("record_id") == 20, F.encode(F.lit("r20x"), "UTF-8")).otherwise(F.col("record")))
    bad = {(r.volume, r.n) for r in warc.audit(good, warc.build_tree(warc.index_records(moved))).collect()}
    assert bad == {(1, n) for n in range(4, 16)}  # a longer record moves the ranges after it in its volume, and no other volume's
    assert warc.audit(good, []).count() == 100
