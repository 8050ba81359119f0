"""Token ids of whole texts under a byte-level BPE file of the tokenizers library."""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: The pre-token pattern of byte-level BPE with use_regex, as published with its first vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs that only the library itself takes (the other engine's pattern matcher backtracks there).
_RUN = re.compile(r"\s{2000}|[^\s]{20000}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in such a file: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Ids as tokenizers gives them, as little-endian unsigned 32-bit bytes.

    If the file's ids follow the order of its merges, its vocabulary is a table of ranks and the several times faster
    tiktoken engine gives the same ids; otherwise, and for extreme runs, tokenizers itself encodes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, pre, added = file["model"], file.get("pre_tokenizer") or {}, file.get("added_tokens") or []
        made = [model["vocab"].get(m.replace(" ", "") if isinstance(m, str) else "".join(m), -1) for m in model.get("merges", [])]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not file.get("normalizer")
        if plain and made and made == sorted(made) and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added):
            to, special = _byte_of(), {x["content"]: x["id"] for x in added}
            ranks = {bytes(to[c] for c in k): v for k, v in model["vocab"].items() if k not in special}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or len(text) > 2000 and _RUN.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids that `encode` gave for whole strings."""
        if self.fast is not None:
            return self.fast.decode_bytes(ids.tolist()).decode("utf-8", "replace")
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)


_LOADED: dict[str, ByteBPE] = {}


def byte_bpe(path: str) -> ByteBPE:
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]
