"""Importance resampling of a corpus towards a target: documents are drawn by the likeness of their hashed
n-grams to the target's.

Features are runs of words, hashed to buckets by CRC-32.  The corpus's most frequent words are broadcast with the state
that the CRC has after them, and its most frequent pairs with their bucket: features that begin with such a
word go on from its state, frequent pairs are looked up.  Words and pairs of the tail take the CRC directly.
Either way a feature gets the same bucket, so totals are exact whatever the sizes of the head, which bound
only what is broadcast.

Totals by bucket are added up in each task before they are shuffled (a row a bucket and task at most).  A
document's weight is the sum of its buckets' gains, its score adds Gumbel noise drawn from its key, and the
best scores are the draw: ranks come from sorted ranges and the counts of the ranges before, never from one
task that sees all rows.

Null and empty texts have no words: no features, weight 0.  A null key counts as an empty one for the noise
and is the smallest.  Ties go to the smaller key; rows that repeat a key tie by features and weight, and
are alike beyond that.  Texts are read whole, whatever their length.  No documents give no rows; an
empty target has equal shares in all buckets.  Only key and text are read, so columns of
other names don't matter; `drawn` gives them back.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialise

#: Words and pairs that are broadcast, and the bytes that one of them may have.
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 1 << 16, 1 << 16, 64
#: Words or pairs that a task counts before it passes them on.
HELD = 400_000
#: Rows in one Arrow batch of counts.
BATCH = 1 << 16

#: A-Z in lower case; digits, letters and all beyond ASCII stay; the rest are blanks.
_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEPT).split()


class Head:
    """What is broadcast: frequent words with the CRC after them, and buckets of frequent pairs of such words."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int) -> None:
        self.index = {w: k for k, w in enumerate(words)}
        self.states = [zlib.crc32(w) for w in words]
        self.buckets = np.array(self.states, np.int64) % buckets
        codes = np.array([self.index[a] << 32 | self.index[b] for a, b in pairs], np.int64)
        order = np.argsort(codes)
        self.pair_codes = codes[order]
        self.pair_buckets = np.array([zlib.crc32(a + b" " + b) % buckets for a, b in pairs], np.int64)[order]
        self.n_buckets = buckets

    def runs(self, words: list[bytes], orders: tuple[int, int]) -> np.ndarray:
        """Buckets of all runs of words of these lengths, repeats included."""
        index, size = self.index, self.n_buckets
        ids = np.fromiter((index.get(w, -1) for w in words), np.int64, len(words))
        out = []
        for n in range(orders[0], min(orders[1], len(words)) + 1):
            found = np.full(len(words) - n + 1, -1, np.int64)
            if n == 1:
                known = ids >= 0
                found[known] = self.buckets[ids[known]]
            elif n == 2 and len(self.pair_codes):
                code = ids[:-1] << 32 | ids[1:]
                at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
                known = (ids[:-1] >= 0) & (ids[1:] >= 0) & (self.pair_codes[at] == code)
                found[known] = self.pair_buckets[at[known]]
            for k in np.flatnonzero(found < 0).tolist():
                first = int(ids[k])
                if first >= 0:
                    found[k] = zlib.crc32(b"".join(b" " + w for w in words[k + 1 : k + n]), self.states[first]) % size
                else:
                    found[k] = zlib.crc32(b" ".join(words[k : k + n])) % size
            out.append(found)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _tally(batches: Iterator[pa.RecordBatch], index: dict[bytes, int] | None) -> Iterator[pa.RecordBatch]:
    """Counts of words, or of pairs of words of the index."""
    held: Counter = Counter()

    def flushed() -> Iterator[pa.RecordBatch]:
        keys = list(held)
        for k in range(0, len(keys), BATCH):
            part = keys[k : k + BATCH]
            firsts, seconds = (part, [None] * len(part)) if index is None else ([p[0] for p in part], [p[1] for p in part])
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.binary()), pa.array(seconds, pa.binary()), pa.array([held[p] for p in part], pa.int64())], ["a", "b", "n"])
        held.clear()

    for batch in batches:
        for text in batch.column(0):
            words = words_of(text.as_py())
            if index is None:
                for word, n in Counter(words).items():
                    if len(word) <= HEAD_BYTES:
                        held[word] += n
            else:
                held.update((a, b) for a, b in zip(words, words[1:], strict=False) if a in index and b in index)
            if len(held) >= HELD:
                yield from flushed()
    yield from flushed()


def _commonest(counts: DataFrame, limit: int) -> list:
    """Rows (.., n) with the largest n, at most that many, cut between classes of n.  The driver sees the classes'
    sizes, of which there are 16 to a doubling, and then the chosen rows alone."""
    size = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    classes = sorted(counts.groupBy(size.alias("c")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True)
    least, held = None, 0
    for c, k in classes:
        held += k
        if held > limit:
            break
        least = c
    return [] if least is None else counts.filter(size >= least).collect()


def head_vocabulary(docs: DataFrame, text: str = "text", orders: tuple[int, int] = (1, 1), buckets: int = 10_000, n_words: int = HEAD_WORDS, n_pairs: int = HEAD_PAIRS) -> Head:
    """The most frequent words of the corpus and, where runs of two are features, pairs of such words."""
    rows = docs.select(text)

    def most(index: dict[bytes, int] | None, limit: int) -> list:
        counts = arrow_map(rows, lambda batches: _tally(batches, index), "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
        return _commonest(materialise(counts, "counts"), limit)

    words = sorted(bytes(r.a) for r in most(None, n_words))
    index = {w: k for k, w in enumerate(words)}
    pairs = [(bytes(r.a), bytes(r.b)) for r in most(index, n_pairs)] if orders[0] <= 2 <= orders[1] and words else []
    return Head(words, pairs, buckets)


def bucket_totals(docs: DataFrame, head: Head, text: str = "text", orders: tuple[int, int] = (1, 1)) -> np.ndarray:
    """How many features of all texts fall into each bucket; there are as many numbers as buckets."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shared.value.n_buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(shared.value.runs(words_of(text.as_py()), orders), minlength=len(total))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    out = np.zeros(head.n_buckets, np.int64)
    for bucket, n in arrow_map(docs.select(text), added, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm by which a bucket is likelier in the target, with one more feature in each."""
    s, t, size = corpus.astype(float), target.astype(float), float(len(corpus))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weighed(docs: DataFrame, head: Head, gain: np.ndarray, key: str = "doc_id", text: str = "text", orders: tuple[int, int] = (1, 1)) -> DataFrame:
    """(key, n_words, n_features, weight)."""
    shared = docs.sparkSession.sparkContext.broadcast((head, gain))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, gain = shared.value
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                found = head.runs(words, orders)
                rows.append((len(words), len(found), int(gain[found].sum())))
            n_words, n_features, weight = (pa.array([r[k] for r in rows], pa.int64()) for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), n_words, n_features, weight], [key, "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), summed, f"`{key}` {kind}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int) -> Column:
    """Noise in thousandths, drawn from the key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """All rows with their rank in that order, from 1.  The order is cut into ranges, each sorted by a task
    of its own, and a rank is a row's place in its range after the counts of the ranges before."""
    # partition number and row number, in one
    placed = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place__", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("part__", F.shiftright("place__", 33))
    before = placed.groupBy("part__").agg(F.count(F.lit(1)).alias("n__"))  # a row a range
    before = before.select("part__", (F.sum("n__").over(Window.orderBy("part__")) - F.col("n__")).alias("before__"))
    place = F.col("place__").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(before, "part__").withColumn("rank", F.col("before__") + place + 1).drop("part__", "before__", "place__")


def resample(docs: DataFrame, target: DataFrame, share: int = 10, orders: tuple[int, int] = (1, 1), buckets: int = 10_000, seed: int = 2024, least: int = 20, key: str = "doc_id", text: str = "text", target_text: str = "text", head_words: int = HEAD_WORDS, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """(key, n_features, weight, score, rank): a row a document; rank is null where it isn't drawn.

    share: per cent of the documents with at least `least` words that are drawn."""
    head = head_vocabulary(docs, text, orders, buckets, head_words, head_pairs)
    gain = gains(bucket_totals(docs, head, text, orders), bucket_totals(target, head, target_text, orders))
    scored = weighed(docs, head, gain, key, text, orders).withColumn("score", F.col("weight") + gumbel(F.col(key), seed))
    scored = materialise(scored, "scores")
    able = F.col("n_words") >= least
    most = share * scored.filter(able).count() // 100
    order = [F.desc("score"), F.col(key).asc_nulls_first(), F.desc("weight"), F.col("n_features")]
    rank = F.when(F.col("rank") <= most, F.col("rank"))
    out = ranked(scored.filter(able), order).withColumn("rank", rank).unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select(key, "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options: object) -> DataFrame:
    """The drawn documents themselves, with all their columns; keys must be distinct and not null."""
    chosen = resample(docs, target, key=key, **options).filter(F.col("rank").isNotNull()).select(key)
    return docs.join(chosen, key, "left_semi")
