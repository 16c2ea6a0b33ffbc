"""Document fingerprints from closed syncmers.

A run of K code points is an anchor if the smallest hash of its inner runs of S code points is that of the
first or of the last one.  Whether a run is an anchor depends on that run alone, so an edit changes the
anchors that it touches and no others, and of K - S runs in a row one is an anchor at least.  A fingerprint
is the text's length and its anchors in order: 20 bits of hash and 4 of the distance from the one before.
A text without an anchor (all shorter than K, few others) has one over the whole of it, the empty text none.

Two fingerprints are likened by position: the n-th occurrence of a hash in one is paired with the n-th in the
other, the longest chain of pairs that keeps the order in both is taken, and the likeness is the share of all
anchors that it covers.  Two empty texts have likeness 1.

Texts that have to be seen in order of their key (`report`) are cut into ranges of keys.  The bounds come
from a narrow table, texts are shuffled once, by range, and the first text of each range goes to the range
before too, so every task sees the follower of its last row.  Tasks stream: they hold two texts at a time.

Null text counts as empty; a null key is the smallest; rows of one key are ordered by a hash of their texts, and of rows
that repeat both, the order doesn't matter (they meet in one task, which streams them).  A text's length has
no bound but memory.  An empty table gives no rows.  Only key and text are read, so columns of other names don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import json
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise

#: Code points of a run and of its inner runs; K is four inner runs long.
K, S = 20, 5
#: Bytes of text in a range of keys, and how many ranges there are at most: so many bounds reach the driver.
RANGE_BYTES, RANGES = 16 << 20, 16_384

_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)
_MIX = np.uint32(0x2C1B3C6D)
_TURNS = (np.uint32(15), np.uint32(12))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> _TURNS[0]
    h *= _MIX
    h ^= h >> _TURNS[1]
    return h


def anchors(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's anchors, ascending, and their hashes of 20 bits."""
    n = len(points) - S + 1
    if n < K - S + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    inner = points[:n] * _ODD[0]
    for k in range(1, S):
        inner += points[k : k + n] * _ODD[k]
    inner = _mixed(inner)
    least, width = inner, 1
    while 2 * width <= K - S + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if rest := K - S + 1 - width:
        least = np.minimum(least[:-rest], least[rest:])
    at = np.flatnonzero((inner[: len(least)] == least) | (inner[K - S :] == least))
    h = np.zeros(len(at), np.uint32)
    for k in range(0, K, S):
        h = (h * _ODD[1]) ^ inner[at + k]
    return at, _mixed(h) & np.uint32(0xFFFFF)


def whole(text: str) -> np.ndarray:
    """The one anchor of a text that has none."""
    return np.array([int.from_bytes(hashlib.sha256(text.encode()).digest()[:4], "little") & 0xFFFFF] if text else [], np.uint32)


def encoded(n_chars: int, at: np.ndarray, hashes: np.ndarray) -> str:
    """The fingerprint as text; an anchor takes four letters."""
    gaps = np.diff(at, prepend=0).astype(np.uint32) if len(at) else np.zeros(len(hashes), np.uint32)
    packed = (hashes << np.uint32(4) | gaps).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return f"{n_chars}:{base64.b64encode(packed.tobytes()).decode()}"


def decoded(fingerprint: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Length, places and hashes."""
    n_chars, _, body = fingerprint.partition(":")
    raw = np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, 3).astype(np.uint32)
    x = raw[:, 0] | raw[:, 1] << np.uint32(8) | raw[:, 2] << np.uint32(16)
    return int(n_chars), np.cumsum(x & np.uint32(15)).astype(np.int64), x >> np.uint32(4)


def _numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and occurrence number in one, sorted, and the place in the list of each."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order].astype(np.int64)
    first = np.concatenate([[True], h[1:] != h[:-1]])
    number = np.arange(len(h)) - np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    return h << 40 | number, order


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the anchors in the longest chain of pairs that keeps the order in both lists."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    total, most = len(a) + len(b), min(len(a), len(b))
    differ = np.flatnonzero(a[:most] != b[:most])
    head = int(differ[0]) if len(differ) else most
    a, b, most = a[head:], b[head:], most - head
    tail = 0
    if most:
        differ = np.flatnonzero(a[::-1][:most] != b[::-1][:most])
        tail = int(differ[0]) if len(differ) else most
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    chain: list[int] = []
    if len(a) and len(b):
        (x, at), (y, bt) = _numbered(a), _numbered(b)
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        i, j = at[i], bt[j]
        for place in j[np.argsort(i)].tolist():
            k = bisect_left(chain, place)
            chain[k : k + 1] = [place]
    return 2 * (head + tail + len(chain)) / total


class Text:
    """A text with its anchors."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.points = code_points(text)
        self.at, self.found = anchors(self.points)
        self.hashes = self.found if len(self.found) else whole(text)

    def fingerprint(self) -> str:
        return encoded(len(self.points), self.at, self.hashes)


def edited(own: Text, other: Text) -> tuple[str, np.ndarray, np.ndarray]:
    """The text whose second half is the other's beginning, with its anchors: those of the two parts, as they
    depend on nothing else, and those of the seam."""
    half = len(own.points) // 2
    kept, taken = len(own.points) - half, min(half, len(other.points))
    text = own.text[:kept] + other.text[:taken]
    lo, hi = max(0, kept - K + 1), min(taken, K - 1)
    before, after = np.searchsorted(own.at, kept - K, "right"), np.searchsorted(other.at, taken - K, "right")
    # runs that begin before the seam and end behind it, of which none is as a whole in either part
    seam, hashes = anchors(np.concatenate([own.points[lo:kept], other.points[:hi]]))
    at = np.concatenate([own.at[:before], seam + lo, other.at[:after] + kept])
    found = np.concatenate([own.found[:before], hashes, other.found[:after]])
    return text, at, found if len(found) else whole(text)


REPORT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _reported(own: Text, following: Text) -> tuple:
    text, at, hashes = edited(own, following)
    return len(own.points), hashlib.sha256(text.encode()).hexdigest(), own.fingerprint(), encoded(len(text), at, hashes), alike(own.hashes, hashes), alike(own.hashes, following.hashes)


def _streamed(batches: Iterator[pa.RecordBatch], key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows come by range and order; each is reported when its follower comes."""
    before: tuple | None = None  # range, whether it only follows, key, text
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            part, follows, key = (batch.column(c)[k].as_py() for c in range(3))
            if before is not None and before[0] == part and before[1]:
                continue  # an equal row at the bound
            now = (part, follows, key, Text(batch.column(3)[k].as_py()))
            if before is not None and before[0] == part:
                rows.append((before[2], *_reported(before[3], now[3])))
            before = now
        names = ["key", *(c.split()[0] for c in REPORT.split(", "))]
        kinds = [key_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names)


def _range_of(me: Column, bounds: Column, n: int) -> Column:
    """The last bound that isn't greater, from 1, by binary search."""
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(n.bit_length()))))
    up = lambda at, step: F.when((at + step <= n) & (F.element_at(bounds, F.least(at + step, F.lit(n))) <= me), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), up)


def with_followers(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(part, follows, key, text): the documents by ranges of keys, and after each range, with follows set, the
    first document of the next one (after the last range that of the first)."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    me = F.struct(F.col("key").alias("k"), F.xxhash64("text").alias("h"))
    narrow = materialise(rows.select(me.alias("me"), F.octet_length("text").cast("long").alias("size")), "keys")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    cut = narrow.select("me.k", "me.h").repartitionByRange(min(RANGES, total // RANGE_BYTES + 1), F.asc_nulls_first("k"), "h")
    found = cut.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.min(F.struct("k", "h")).alias("b")).orderBy("part").collect()
    n = max(1, len(found))
    kind = docs.schema[key].dataType.simpleString()
    bounds = F.from_json(F.lit(json.dumps([{"k": r.b.k, "h": r.b.h} for r in found])), f"array<struct<k:{kind},h:bigint>>")
    placed = rows.withColumn("me", me).withColumn("own", _range_of(F.col("me"), bounds, n))
    follows = F.when(F.element_at(bounds, F.greatest(F.col("own"), F.lit(1))) == F.col("me"), F.struct(F.when(F.col("own") > 1, F.col("own") - 1).otherwise(n).alias("part"), F.lit(1).alias("follows")))
    places = F.filter(F.array(F.struct(F.col("own").alias("part"), F.lit(0).alias("follows")), follows), lambda p: p.isNotNull())
    out = placed.select(F.explode(places).alias("place"), "key", "text", F.col("me.h").alias("h"))
    out = out.select("place.part", "place.follows", "key", "text", "h").repartition("part").sortWithinPartitions("part", "follows", F.asc_nulls_first("key"), "h")
    return out.select("part", "follows", "key", "text")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its text with the second half replaced by the next document's
    beginning, and how alike they and the next document's are.  The last is followed by the first."""
    kind = docs.schema[key].dataType.simpleString()
    key_type = pa.string() if kind == "string" else {"bigint": pa.int64(), "int": pa.int32()}[kind]
    out = arrow_map(with_followers(docs, key, text), lambda batches: _streamed(batches, key_type), f"key {kind}, {REPORT}")
    return out.withColumnRenamed("key", key)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint), without a shuffle."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Text(t.as_py() or "").fingerprint() for t in batch.column(1)], pa.string())], [key, "fingerprint"])

    return arrow_map(docs.select(key, text), made, f"`{key}` {docs.schema[key].dataType.simpleString()}, fingerprint string")


def likeness(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of fingerprints, in columns a and b, with their likeness."""

    def likened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [alike(decoded(x)[2], decoded(y)[2]) for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.float64())], [*batch.schema.names, "likeness"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return arrow_map(pairs, likened, f"{fields}, likeness double")


def positions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, hash): a row an anchor, for matching passages by position across documents."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, hashes = anchors(code_points(batch.column(1)[k].as_py() or ""))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(at), k))), pa.array(at, pa.int64()), pa.array(hashes.astype(np.int64))], [key, "place", "hash"])

    return arrow_map(docs.select(key, text), made, f"`{key}` {docs.schema[key].dataType.simpleString()}, place long, hash long")
