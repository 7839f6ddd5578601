"""Word shingles of many texts at once, hashed to 64 bits with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from .shared import by_value

by_value()

_BASE = np.uint64(0x9E3779B97F4A7C15)
_NEXT = np.uint64(0xD6E8FEB86659FD93)
#: A-Z to a-z; the blanks \x20 and \x09-\x0D all to \x20.
LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
    values[32] = 0
    return values


_values = _byte_values()
_known: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The powers of the base and of its inverse up to the n-th at least; kept for the next texts."""
    if len(_known[0]) <= n:
        for i, base in enumerate((int(_BASE), pow(int(_BASE), -1, 1 << 64))):
            _known[i] = np.full(n + 1, base, dtype=np.uint64)
            _known[i][0] = 1
            np.multiply.accumulate(_known[i], out=_known[i])
    return _known


class Words(NamedTuple):
    """The words of some texts in order: where they are in `data`, their hashes, and the number of their text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    owner: np.ndarray


def words_in(texts: list[bytes], table: bytes = LOWER) -> Words:
    """`table` translates bytes, those between words to a space."""
    data = np.frombuffer(b" ".join([*texts, b""]).translate(table), dtype=np.uint8)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), none)
    solid = np.concatenate([[False], data != 32, [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[::2], edge[1::2]
    # A word's hash is its polynomial: a difference of prefix sums, moved back to position 0.
    powers, back = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.multiply(_values[data], powers[: len(data)], out=sums[1:])
    np.cumsum(sums, out=sums)
    hashes = mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    return Words(data, start, end, hashes, np.searchsorted(begins, start, side="right") - 1)


def runs(hashes: np.ndarray, first: np.ndarray | None, k: int) -> np.ndarray:
    """The hash of the k words from each place in `first`, or from every place that has so many."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n if first is None else len(first), dtype=np.uint64)
    factor = 1
    for j in range(k if len(out) else 0):
        out += (hashes[j : j + n] if first is None else hashes[first + j]) * np.uint64(factor)
        factor = factor * int(_NEXT) % (1 << 64)
    return mix(out)


def grouped(texts: list[bytes], size: int = 250_000) -> Iterator[list[bytes]]:
    """The texts in groups of about `size` bytes at most, but a text is not cut."""
    group: list[bytes] = []
    total = 0
    for text in texts:
        if group and total + len(text) > size:
            yield group
            group, total = [], 0
        group.append(text)
        total += len(text)
    if group:
        yield group


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; a shorter text is one shingle, an empty one none."""
    return [x for group in grouped(texts) for x in _sets(group, k)]


def _sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    words = words_in(texts)
    hashes = words.hash
    counts = np.bincount(words.owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)])
    combined = runs(hashes, None, k)
    out = []
    for i, n in enumerate(counts):
        at = first[i]
        if n >= k:
            out.append(np.unique(combined[at : at + n - k + 1]))
        elif n:
            total = int(n)
            for h in hashes[at : at + n]:
                total = (total * int(_NEXT) + int(h)) % (1 << 64)
            out.append(mix(np.array([total], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
