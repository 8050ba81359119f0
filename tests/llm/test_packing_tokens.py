import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb
from tokenizers import Tokenizer

from folioscan.llm import packing, sentencepiece_ops, tokens

ODD = ["", "  ", " x", "hello  world\n a b ", "▁a ▁", "日本é\U0001f600", "<s> </s> <unk>", "a" * 300, "def f(x):\n    return  x+1\t\t☃☃", "a <|endoftext|> b", "'s 'll\r\n\x00 1234", " " * 3000 + "x"]


def test_byte_bpe_is_tokenizers(documents):
    t = Tokenizer.from_file(tokens.default_path())
    own = tokens.byte_bpe(tokens.default_path())
    assert own.fast is not None
    for text in ODD + [r.text for r in documents.limit(100).collect()]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
@settings(max_examples=150, deadline=None)
def test_sentencepiece_matches_the_library(text):
    own, lib = sentencepiece_ops.pieces(sentencepiece_ops.default_path()), _lib()
    ids = own.encode([text])[0]
    if "\x00" not in text:
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text)
    assert own.decode(ids) == text.replace("▁", " ")


_CACHE = {}


def _lib():
    if not _CACHE:
        _CACHE["m"] = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_ops.default_path())
    return _CACHE["m"]


def test_sentencepiece_on_documents(spark, documents, frame):
    lib = _lib()
    for r in sentencepiece_ops.round_trip(documents).join(documents.select("doc_id", "text"), "doc_id").collect():
        assert r.ids == lib.encode(r.text) and r.n_ids == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    odd = frame([*ODD[:-1], None, "a b", "a b"])
    ids = sentencepiece_ops.encode(odd)
    back = {r.doc_id: r.text for r in sentencepiece_ops.decode(ids).collect()}
    assert all(back[i] == t.replace("▁", " ") for i, t in enumerate(ODD[:-1])) and back[len(ODD) - 1] == ""
    assert sentencepiece_ops.encode(odd.where("false")).count() == 0
    assert sentencepiece_ops.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).where("text = ''").count() == 2


def test_unigram_scores(tmp_path):
    """A unigram model written by hand: the best sum of scores, as the library finds it."""
    m = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -3, 1), ("a", -2, 1), ("b", -2.5, 1), ("ab", -3, 1), ("▁a", -2.2, 1), ("ba", -4, 1), ("bab", -4.9, 1), ("▁abab", -9, 1)]:
        p = m.pieces.add()
        p.piece, p.score, p.type = piece, score, kind
    m.trainer_spec.model_type = 1
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", True, False, True
    path = tmp_path / "m.model"
    path.write_bytes(m.SerializeToString())
    own, lib = sentencepiece_ops.Pieces(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    for text in ["a", "abab", "babab aab", "abz zz b", "bbbbaaa abab"]:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == lib.encode(text), text


@given(st.lists(st.integers(1, 5000), min_size=1, max_size=200), st.sampled_from([64, 256, 2048]))
@settings(max_examples=60, deadline=None)
def test_plan_covers_every_token_once(lengths, window):
    doc, start, length, seq, offset = packing.plan_block(np.array(lengths), window)
    for i, n in enumerate(lengths):
        own = np.argsort(start[doc == i])
        s, z = start[doc == i][own], length[doc == i][own]
        assert s[0] == 0 and (s[1:] == (s + z)[:-1]).all() and s[-1] + z[-1] == n and (z > 0).all()
    for q in np.unique(seq):
        own = np.argsort(offset[seq == q])
        o, z = offset[seq == q][own], length[seq == q][own]
        total = int(z.sum())
        assert o[0] == 0 and (o[1:] == (o + z)[:-1]).all() and total <= window and total & (total - 1) == 0


def test_nnls_finds_exact_counts():
    hist = np.zeros(101, int)
    hist[[30, 70, 20, 80, 50]] = [40, 40, 10, 10, 6]
    columns = packing.combinations(hist, 100)
    x = packing.solve_nnls(columns, hist)
    found = {tuple(c): v for c, v in zip(columns.tolist(), x, strict=True)}
    assert found[(30, 70, 0)] == pytest.approx(40, abs=1) and (packing.solve_nnls(columns, hist) >= 0).all()
    doc, _, length, seq, _ = packing.plan_block(np.repeat(np.arange(101), hist), 128)
    assert length.sum() == (np.arange(101) * hist).sum()


def test_pack_query(spark, documents, frame, monkeypatch):
    texts = {r.doc_id: r.text for r in documents.collect()}
    t = Tokenizer.from_file(tokens.default_path())
    rows = packing.pack(documents, with_ids=True).collect()
    ids = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        ids.setdefault(r.doc_id, []).extend(r.ids)
    assert ids == {i: t.encode(x, add_special_tokens=False).ids + [1] for i, x in texts.items()}
    odd = packing.pack(frame(["", None, "a", "a"], [1, 2, None, 3])).collect()
    assert sorted(((r.doc_id or -1), r.doc_tokens) for r in odd) == [(-1, 2), (1, 1), (2, 1), (3, 2)]
    assert packing.pack(documents.where("false")).count() == 0
    many = packing.pack(documents.union(documents)).groupBy("sequence_id").sum("length").collect()
    assert all(r[1] <= 2048 for r in many)
