"""Posts and stories of one time, compared where they share a name or a rare word (JOIN-7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Posts and stories that are compared at once.
POSTS, STORIES = 512, 2048
BEST = "post long, story long, score double"


class Side:
    """Rows (id, t, e, v, w) in order of time; their names, events and words as hashes."""

    def __init__(self, rows: pa.Table) -> None:
        rows = rows.take(pa.array(np.argsort(rows["t"].to_numpy(), kind="stable")))
        self.id, self.t = (rows[c].to_numpy() for c in ("id", "t"))
        self.lists = {c: pa.concat_arrays(rows[c].chunks) for c in "evw"}
        self.sizes = {c: np.diff(x.offsets.to_numpy()) for c, x in self.lists.items()}
        # rows that come several times share what they share as often
        self.times = np.ones(len(self.id), np.int64)
        if len(np.unique(self.id)) < len(self.id):
            _, at, n = np.unique(np.stack([self.id, self.t, *self.sizes.values()], 1), axis=0, return_inverse=True, return_counts=True)
            self.times = n[at.reshape(-1)]

    def hashes(self, c: str, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        part = self.lists[c].slice(low, high - low)
        return np.repeat(np.arange(high - low), self.sizes[c][low:high]), part.flatten().to_numpy()


def _shared(p: Side, s: Side, c: str, a: int, b: int, x: int, y: int) -> np.ndarray:
    """How many hashes each post of a..b has in common with each story of x..y."""
    (i, u), (j, v) = p.hashes(c, a, b), s.hashes(c, x, y)
    both = np.intersect1d(u, v)
    left, right = np.zeros((b - a, len(both)), np.float32), np.zeros((y - x, len(both)), np.float32)
    for rows, hashes, to in ((i, u, left), (j, v, right)):
        if len(both):
            at = np.minimum(np.searchsorted(both, hashes), len(both) - 1)
            hit = both[at] == hashes
            to[rows[hit], at[hit]] = 1
    return (left @ right.T).astype(np.float64)


def _best(p: Side, s: Side, earlier: int, later: int, least: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    found = []
    for a in range(0, len(p.id), POSTS):
        b = min(a + POSTS, len(p.id))
        low, high = np.searchsorted(s.t, p.t[a] - earlier), np.searchsorted(s.t, p.t[b - 1] + later, "right")
        for x in range(low, high, STORIES):
            y = min(x + STORIES, high)
            gap = p.t[a:b, None] - s.t[x:y]
            n = {c: (p.sizes[c][a:b, None], s.sizes[c][x:y]) for c in "evw"}
            often = p.times[a:b, None] * s.times[x:y]
            people, event = (_shared(p, s, c, a, b, x, y) * often / np.maximum(np.minimum(*n[c]), 1) for c in "ev")
            words = _shared(p, s, "w", a, b, x, y)
            text = words / np.maximum(n["w"][0] + n["w"][1] - words, 1)
            named = n["e"][0] + n["e"][1] + n["v"][0] + n["v"][1] > 0
            # parts add up to the same score in several ways; beyond nine digits they differ by chance
            score = np.floor(np.where(named, 0.45 * people + 0.25 * event + 0.30 * text, 0.85 * text) * 1e9 + 0.5) / 1e9
            good = (gap <= earlier) & (gap >= -later) & (score >= least)
            good &= ~((n["e"][0] > 0) & (n["e"][1] > 0) & (people == 0)) & ~((people == 0) & (event == 0) & (words < 3))
            score = np.where(good, score, -1.0)
            most = score.max(1)
            story = np.where(score == most[:, None], s.id[x:y], np.iinfo(np.int64).max).min(1)
            some = most >= 0
            found.append((p.id[a:b][some], story[some], most[some]))
    return found


def best_stories(earlier: int, later: int, least: float):
    """Of rows (side, key, id, t, e, v, w) of one stretch of time: each post's best story of those that share a key with it, for
    each key and block of stories.  Stories may be so many microseconds earlier or later."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("key").combine_chunks()
        keys, side = rows["key"].to_numpy(), rows["side"].to_numpy()
        ends = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        stories = np.r_[0, np.cumsum(side)]
        found = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if 0 < stories[b] - stories[a] < b - a:
                part, of = rows.slice(a, b - a), side[a:b]
                p, s = (Side(part.take(pa.array(np.flatnonzero(of == k)))) for k in (0, 1))
                found += _best(p, s, earlier, later, least)
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("post", "story", "score"), map(pa.array, columns), strict=True)))

    return run
