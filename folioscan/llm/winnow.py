"""Content-chosen anchors: every string of `length` bytes holds one, chosen by its bytes alone."""

from __future__ import annotations

import numpy as np

#: Low bits of a hash that give way to its place; a slice of texts is shorter than this.
_PLACE = 28


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` (a power of two) bytes."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        step, power = 1, np.uint64(0x9E3779B97F4A7C15)
        while step < size:
            n = len(h) - step
            next_ = h[:n] * power
            next_ += h[step:]
            h, power, step = next_, power * power, step * 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def anchors(texts: list[bytes], length: int = 200, gram: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the texts laid end to end: (hash, first, last, data, starts).

    `first` and `last` are the first and last place where a string of `length` bytes starts that chose the anchor; such
    strings cross no text's end. The anchor is the string's run of `gram` bytes with the least hash, the leftmost of equals.
    """
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, data, starts
    if len(data) >= 1 << _PLACE:
        raise ValueError("a slice of texts is too long")
    h = gram_hashes(data, gram)
    mask = np.uint64((1 << _PLACE) - 1)
    least = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    width, window = 1, length - gram + 1
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    inside = np.zeros(len(least) + 1, np.int32)
    fit = np.diff(starts) >= length
    np.add.at(inside, starts[:-1][fit], 1)
    np.add.at(inside, (starts[1:] - length + 1)[fit], -1)
    here = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(here):
        return none.astype(np.uint64), none, none, data, starts
    at = (least[here] & mask).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return h[at[new]], here[new], here[np.append(new[1:], len(at)) - 1], data, starts
