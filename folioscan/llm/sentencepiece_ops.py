"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

The distinct marked words of a batch are sorted, which lays them out as a trie in depth-first order; the forward column of
a word is kept up to the prefix that it shares with the next word, so a common prefix is scored once. For a unigram model
the forward score is the best sum of piece scores. For a BPE model the path's only admissible transitions are pairs of
pieces that its merges would leave apart: every prefix has then exactly one admissible path, and that path is what the
merges give (a pair of neighbours that stays apart alone stays apart in any text, since merges are chosen by priority).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import lean, load, slices, text_of

MARK = "▁"
#: Words that a worker's cache holds before it starts afresh, and the longest word (characters) that goes there.
CACHE_WORDS, CACHE_CHARS = 400_000, 48
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model file with identity normalisation. Encodes to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, trainer = model.normalizer_spec, model.trainer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or trainer.treat_whitespace_as_suffix or trainer.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models with identity normalisation and leading word marks are read")
        self.bpe, self.dummy = trainer.model_type == 2, spec.add_dummy_prefix
        plain = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in plain):
            raise ValueError("a piece goes across words")
        self.text, self.scores = [p.piece for p in model.pieces], [p.score for p in model.pieces]
        self.lengths = [len(p) for p in self.text]
        #: Every end of a piece: its id if it is a piece, else -1.
        self.look = {p[i:]: -1 for p in plain for i in range(len(p))} | plain
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == 2)
        self.unknown_score = min((self.scores[i] for i in plain.values()), default=0.0) - 10.0
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else " ⁇ ".encode() if p.type == 2 else p.piece.encode() for p in model.pieces]
        self.apart: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}

    def merges(self, text: str) -> list[str]:
        """The pieces that merging by priority leaves, leftmost first among equals; quadratic, for short strings."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.look.get(parts[i] + parts[i + 1], -1)
                if k >= 0 and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _may_follow(self, left: int, right: int) -> bool:
        """Whether merging leaves these two apart; left -1: whether the word may begin with the piece."""
        if len(self.apart) > 2_000_000:
            self.apart.clear()
        pair = [*([self.text[left]] if left >= 0 else [] if left == -1 else [chr(-2 - left)]), self.text[right]]
        free = self.apart[(left << 20) + right] = self.merges("".join(pair)) == pair
        return free

    def viterbi(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each of the sorted distinct marked words."""
        out: dict[str, bytes] = {}
        last: list[int] = [-1]  # the piece that ends at each depth of the trie's current branch; below -1: an unknown character
        best: list[float] = [0.0]
        look, apart, lengths, bpe = self.look, self.apart, self.lengths, self.bpe
        before = ""
        for word in words:
            n = min(len(word), len(before))
            shared = 0
            while shared < n and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                start, piece, score = end - 1, None, 0.0
                while start >= 0:
                    i = look.get(word[start:end])
                    if i is None:
                        break
                    if i >= 0:
                        if bpe:
                            before_it = last[start]
                            free = apart.get((before_it << 20) + i)
                            if free or free is None and self._may_follow(before_it, i):
                                piece = i
                                break
                        elif piece is None or best[start] + self.scores[i] > score:
                            piece, score = i, best[start] + self.scores[i]
                    start -= 1
                if piece is None or not bpe and look.get(word[end - 1], -1) < 0 and best[end - 1] + self.unknown_score > score:
                    piece, score = -2 - ord(word[end - 1]), best[end - 1] + self.unknown_score
                last.append(piece)
                best.append(score)
            path, at = [], len(word)
            while at:
                i = last[at]
                path.append(i)
                at -= lengths[i] if i >= 0 else 1
            path.reverse()
            out[word] = array("I", path if min(path) >= 0 else self._spelled(path)).tobytes()
            before = word
        return out

    def _spelled(self, path: list[int]) -> list[int]:
        """Unknown characters as bytes if the model has them, else runs of them as one unknown id."""
        ids: list[int] = []
        for i in path:
            if i >= 0:
                ids.append(i)
            elif len(self.bytes) == 256:
                ids += [self.bytes[x] for x in chr(-2 - i).encode()]
            elif not (ids and ids[-1] == self.unknown):
                ids.append(self.unknown)
        return ids

    def _words(self, text: str) -> list[str]:
        if self.dummy and text and text[0] != " " and MARK not in text and "  " not in text:
            return [MARK + w for w in text.split(" ")]
        marked = text.replace(" ", MARK)
        return _WORD.findall(MARK + marked if self.dummy and text else marked)

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        split = [self._words(t) for t in texts]
        cache = self.cache
        new = {w for words in split for w in words if w not in cache}
        made = self.viterbi(sorted(new))
        self.cache.update((w, i) for w, i in made.items() if len(w) <= CACHE_CHARS)
        for w in new:
            if len(w) > CACHE_CHARS:
                cache[w] = made[w]
        out = [b"".join(map(cache.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > CACHE_CHARS:
                del cache[w]
        return out

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.dummy and text.startswith(" ") else text


_LOADED: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def _sliced(batches, rows: int = 500, size: int = 4_000_000):
    """Runs of rows of a batch, up to so many rows or characters; only their texts are Python objects."""
    for b in slices(batches, rows):
        bytes_ = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy()
        at = 0
        while at < b.num_rows:
            end = at + max(1, int(np.searchsorted(np.cumsum(bytes_[at:]), size, "right")))
            yield b.column(0).slice(at, end - at), b.column(1).slice(at, end - at).to_pylist()
            at = end


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every row.

    Null and empty texts have no ids; a literal word mark in a text counts as a space, as the format defines; repeated
    rows give equal rows, an empty table none; other columns are ignored. Memory holds a slice of a batch.
    """
    path = model or default_path()

    def run(batches):
        m = pieces(path)
        for keys, texts in _sliced(batches):
            ids = m.encode(texts)
            edges = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"doc_id": keys, "ids": pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(ids), "<i4")))})

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {id_type}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids; null and empty ids are the empty text."""
    path = model or default_path()

    def run(batches):
        m = pieces(path)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [m.decode(np.array(x or [], "<u4").tobytes()) for x in part.column(1).to_numpy(zero_copy_only=False)] if part.column(1).null_count else _decoded(m, part.column(1))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "text": pa.array(texts, pa.string())})

    id_type = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(lean(run), f"doc_id {id_type}, text string")


def _decoded(m: Pieces, lists: pa.ListArray) -> list[str]:
    edges, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
    return [m.decode(values[a:b].tobytes()) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Encode and decode in one pass: doc_id, ids, n_ids, ids_crc32 (little-endian unsigned 32-bit ids) and decoded_sha256."""
    path = model or default_path()

    def run(batches):
        m = pieces(path)
        for keys, texts in _sliced(batches):
            ids = m.encode(texts)
            edges = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "doc_id": keys, "ids": pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(ids), "<i4"))),
                "n_ids": pa.array(np.diff(edges).astype(np.int64)), "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                "decoded_sha256": pa.array([hashlib.sha256(m.decode(x).encode()).hexdigest() for x in ids]),
            })

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {id_type}, ids array<int>, n_ids long, ids_crc32 long, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "documents"))
