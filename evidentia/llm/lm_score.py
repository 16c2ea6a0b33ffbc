"""Stupid-backoff language-model scores, computed relationally.

1. Blocks: the documents' words become a table of blocks, each the words of some documents as
   numbers into the block's own vocabulary.  Written once, so a retry can't deal anew.
2. N-grams: every block is exploded into its distinct n-grams of orders 1 to `order` with how often
   it has them - counts are added up within a block before anything is shuffled - dealt by a
   hash of the n-gram.  A row holds a block's part of one hash partition, packed.
3. Counts: a hash partition adds up its n-grams over all blocks (its part of the count table) and
   joins the totals back to the rows that asked.
4. Scores: a block meets its totals again, looks up every n-gram of every document and sums.
   Blocks lie bucketed, so only the totals are shuffled for this join.

The commonest n-gram has one row a block, however many documents hold it, so no key is hot: a
partition's size depends on the number of its distinct n-grams in blocks alone.

Score of a word after the words before it, with c the counts of the corpus without the document
that is scored (its own n-grams would all be seen): c(abw) / c(ab) where abw was seen, else
backoff times the score with one word less; after none, c(w) / words, at least one occurrence.
The first words of a document have a shorter history.

Words are runs between ASCII white space, A-Z in lower case, known by 64-bit hashes; n-grams by as
many bits of theirs as make the odds of taking one for another 2 ** -EXACT_BITS at the corpus's size.
Null and empty texts and such without words have no words and score 0.  Every row is scored by
itself; rows that repeat an id or a text see each other.  Ids are whole numbers or null.  A text
is read whole and its words lie in one block, so a task holds the longest text at least.  Other
columns, whatever their names, aren't read.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, new_path, noted, utf8
from .words import by_text, distinct, window_hashes

ORDER, BACKOFF = 3, 0.4
#: Words of a block, and n-grams that a hash partition has on average.
BLOCK_WORDS, PARTITION_GRAMS = 1_000_000, 2_000_000
#: Bits of an n-gram's hash beyond those that number the corpus's n-grams.
EXACT_BITS = 24


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers by byte planes, which compress where the upper bytes are mostly nought."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(blob: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def _blocks(most: int):
    """Blocks of documents: their ids, numbers of words, the block's vocabulary, and the words by its numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[int | None] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            vocabulary, numbers = np.unique(np.concatenate(held), return_inverse=True)
            columns = [pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([_pack(np.diff(vocabulary, prepend=np.uint64(0)))]), pa.array([_pack(numbers.astype(np.uint32))])]
            keys.clear(), sizes.clear(), held.clear()
            return pa.RecordBatch.from_arrays(columns, ["keys", "sizes", "vocabulary", "numbers"])

        many = 0
        for batch in batches:
            texts = (t.lower() for t in batch.column(1).to_pylist())
            for key, (h, lo, hi) in zip(batch.column(0).to_pylist(), by_text(texts), strict=True):
                keys.append(key)
                sizes.append(hi - lo)
                held.append(h[lo:hi].copy())
                many += hi - lo
                if many >= most or len(keys) >= most:
                    yield block()
                    many = 0
        if keys:
            yield block()

    return run


def _words(vocabulary: bytes, numbers: bytes) -> np.ndarray:
    return np.cumsum(_unpack(vocabulary, "<u8"), dtype=np.uint64)[_unpack(numbers, "<u4")]


def _block_grams(words: np.ndarray, sizes: np.ndarray, order: int, drop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the hashes of a block's n-grams, without the last `drop` bits, and where their last words stand."""
    rank = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes)  # place of a word in its document
    for n in range(1, order + 1):
        if len(words) < n:
            yield np.empty(0, np.uint64), np.empty(0, np.int64)
            continue
        ends = np.flatnonzero(rank >= n - 1)
        yield window_hashes(words, n)[ends - n + 1] >> np.uint64(drop), ends


def _grams(order: int, partitions: int, drop: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, vocabulary, numbers in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                levels = _block_grams(_words(vocabulary, numbers), np.array(sizes), order, drop)
                grams, times = np.unique(np.concatenate([g for g, _ in levels]), return_counts=True)
                # partitions are ranges of the hash, so a block's n-grams stay in order
                p = ((grams << np.uint64(drop) >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)).astype(np.int64)
                cuts = np.searchsorted(p, np.arange(partitions + 1))
                found = np.flatnonzero(np.diff(cuts))
                for lo in range(0, len(found), 256):
                    some = found[lo : lo + 256].tolist()
                    gaps = [_pack(np.diff(grams[cuts[k] : cuts[k + 1]], prepend=np.uint64(0))) for k in some]
                    counts = [_pack(times[cuts[k] : cuts[k + 1]].astype(np.uint32)) for k in some]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array(gaps, pa.binary()), pa.array(counts, pa.binary())], ["p", "block", "grams", "times"])

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's part of the count table, joined to the rows that hold its n-grams."""

    def joined(p: int, rows: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        grams = [np.cumsum(_unpack(g, "<u8"), dtype=np.uint64) for _, g, _ in rows]
        times = [_unpack(t, "<u4") for _, _, t in rows]
        table = distinct(np.concatenate(grams))
        counts = np.zeros(len(table), np.int64)
        places = [np.searchsorted(table, g) for g in grams]
        for at, n in zip(places, times, strict=True):
            counts[at] += n  # a block has each n-gram once
        for lo in range(0, len(rows), 256):
            some = range(lo, min(lo + 256, len(rows)))
            yield pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in some], pa.int64()), pa.array([p] * len(some), pa.int32()), pa.array([_pack(counts[places[k]].astype(np.uint64)) for k in some], pa.binary())], ["block", "p", "totals"])

    now, rows = None, []
    for batch in batches:
        for p, *row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if p != now and rows:
                yield from joined(now, rows)
                rows = []
            now = p
            rows.append(tuple(row))
    if rows:
        yield from joined(now, rows)


def _block_scores(words: np.ndarray, sizes: np.ndarray, totals: np.ndarray, order: int, drop: int, backoff: float, corpus: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document the sum of its words' log scores, and how many of them backed off."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    levels = list(_block_grams(words, sizes, order, drop))
    table = distinct(np.concatenate([g for g, _ in levels]))
    score = np.zeros(len(words))
    backed = np.zeros(len(words), bool)
    below = None  # counts of the n-grams of the order below, by their last word
    for n, (grams, ends) in enumerate(levels, 1):
        at = np.searchsorted(table, grams)
        # what the document itself has of each of its n-grams
        _, which, own = np.unique(of[ends] * len(table) + at, return_inverse=True, return_counts=True)
        others = np.zeros(len(words), np.int64)
        others[ends] = totals[at] - own[which]
        with np.errstate(divide="ignore", invalid="ignore"):
            if n == 1:
                rest = np.maximum(corpus - sizes[of], 1)
                score = np.log(np.maximum(others, 1)) - np.log(rest)
                backed = others == 0
            else:
                seen = others[ends] > 0
                score[ends] = np.where(seen, np.log(others[ends]) - np.log(below[ends - 1]), math.log(backoff) + score[ends])
                backed[ends] = ~seen
        below = others
    return np.bincount(of, score, len(sizes)), np.bincount(of, backed, len(sizes)).astype(np.int64)


def _scores(order: int, drop: int, backoff: float, corpus: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, sizes, vocabulary, numbers, totals in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                sizes = np.array(sizes)
                score, backed = np.zeros(len(keys)), np.zeros(len(keys), np.int64)
                if totals:
                    counts = np.concatenate([_unpack(t["totals"], "<u8") for t in totals]).astype(np.int64)
                    score, backed = _block_scores(_words(vocabulary, numbers), sizes, counts, order, drop, backoff, corpus)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(backed), pa.array(score)], ["key", "n", "backed", "score"])

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF, block_words: int = BLOCK_WORDS) -> DataFrame:
    """id, n_tokens, n_backed_off, log_score (natural log, summed), mean_log_score; one row per row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("key"), utf8(F.col(f"`{text_col}`")).alias("text"))
    made = arrow_map(rows, _blocks(block_words), "keys array<long>, sizes array<long>, vocabulary binary, numbers binary")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, "blocks")
    table = f"blocks_{uuid4().hex}"
    noted("table", table)
    made.withColumn("block", F.monotonically_increasing_id()).write.bucketBy(buckets, "block").option("path", path).saveAsTable(table)
    blocks = spark.table(table)
    corpus = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
    drop = max(0, 64 - EXACT_BITS - (order * corpus).bit_length())
    partitions = max(buckets, order * corpus // PARTITION_GRAMS)
    grams = arrow_map(blocks.select("block", "sizes", "vocabulary", "numbers"), _grams(order, partitions, drop), "p int, block long, grams binary, times binary")
    totals = arrow_map(grams.repartition(partitions, "p").sortWithinPartitions("p"), _totals, "block long, p int, totals binary")
    # in the order of the block's n-grams; as many as it has
    by_block = totals.repartition(buckets, "block").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("p", "totals"))).alias("totals"))
    met = blocks.hint("merge").join(by_block, "block", "left").select("keys", "sizes", "vocabulary", "numbers", "totals")
    out = arrow_map(met, _scores(order, drop, backoff, corpus), "key long, n long, backed long, score double")
    return out.select(
        F.col("key").alias(id_col),
        F.col("n").alias("n_tokens"),
        F.col("backed").alias("n_backed_off"),
        F.round("score", 4).alias("log_score"),
        F.round(F.when(F.col("n") > 0, F.col("score") / F.col("n")).otherwise(0.0), 6).alias("mean_log_score"),
    )
