"""Hashes of a text's words, by whole arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
S29, S32 = np.uint64(29), np.uint64(32)
#: Longer words, which are few, are hashed one by one.
LONG = 256
#: Bytes of text that are hashed together.
GROUP = 512 << 10

_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
#: Masks that keep the first k bytes of eight.
_first = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words between ASCII white space, in order, and where they start."""
    size = len(text)
    padded = np.frombuffer(text + b" " + bytes(8), np.uint8)
    blank = _space[padded[: size + 1]]
    turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        turns = np.concatenate([[0], turns])
    start, end = turns[::2], turns[1::2]
    length = end - start
    eights = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (size + 1,), (1,))
    h = length.astype(np.uint64) * A
    many = np.flatnonzero(length > LONG)
    todo, at = np.arange(len(start)), start
    left = np.minimum(length, LONG)
    while len(todo):
        chunk = eights[at] & _first[np.minimum(left, 8)]
        x = (h[todo] ^ chunk) * B
        x ^= x >> S29
        x *= C
        h[todo] = x ^ (x >> S32)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for k in many.tolist():
        h[k] = xxhash.xxh3_64_intdigest(text[start[k] : end[k]])
    return h, start


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for every run of that many words."""
    n = len(words) - size + 1
    z = np.full(n, size, np.uint64)
    for k in range(size):
        z ^= words[k : k + n]
        z *= A
        z ^= z >> S29
    return z


def distinct(z: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    z = np.sort(z)
    keep = np.empty(len(z), bool)
    keep[:1] = True
    np.not_equal(z[1:], z[:-1], out=keep[1:])
    return z[keep]


def by_text(texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, int, int]]:
    """For each text the word hashes of its group, and where its own begin and end in them."""
    group: list[bytes] = []
    held = 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= GROUP:
            yield from _grouped(group)
            group, held = [], 0
    yield from _grouped(group)


def _grouped(group: list[bytes]) -> Iterator[tuple[np.ndarray, int, int]]:
    if not group:
        return
    h, start = word_hashes(b" ".join(group))
    ends = np.cumsum([len(t) + 1 for t in group])
    cuts = [0, *np.searchsorted(start, ends).tolist()]
    for k in range(len(group)):
        yield h, cuts[k], cuts[k + 1]


def window_sets(texts: Iterable[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of words; the whole of a shorter text is one."""
    of, windows = None, None
    for h, lo, hi in by_text(texts):
        if hi - lo < size:
            yield window_hashes(h[lo:hi], hi - lo) if hi > lo else h[:0]
            continue
        if of is not h:
            of, windows = h, window_hashes(h, size)
        yield distinct(windows[lo : hi - size + 1])
